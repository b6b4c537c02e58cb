import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.functions.seq import in_context
from strandloom.operators import align, coding, design, reads, simulate
from strandloom.sources import flatfile


def plain_affine(a, b, match=2, mismatch=1, opening=4, extension=1, local=False):
    """All ways by three tables."""
    low = -math.inf
    m = [[[low] * 3 for _ in range(len(b) + 1)] for _ in range(len(a) + 1)]
    best = 0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == j == 0:
                m[0][0][0] = 0
                continue
            if i and j:
                before = max(m[i - 1][j - 1])
                m[i][j][0] = (max(before, 0) if local else before) + (match if a[i - 1] == b[j - 1] else -mismatch)
            if i:
                m[i][j][1] = max(max(m[i - 1][j]) - opening - extension, m[i - 1][j][1] - extension)
            if j:
                m[i][j][2] = max(max(m[i][j - 1]) - opening - extension, m[i][j - 1][2] - extension)
            best = max(best, *m[i][j])
    return best if local else max(m[-1][-1])


@pytest.mark.parametrize("local", [False, True])
def test_alignment_scores(spark, local):
    r = random.Random(5)
    pairs = [("", ""), ("ACGT", ""), (None, "A"), ("acgt", "ACGT"), ("AAAACCCC", "AAAATTCCCC")]
    pairs += [("".join(r.choices("AC", k=r.randint(0, 9))), "".join(r.choices("AC", k=r.randint(0, 9)))) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b, "kept") for i, (a, b) in enumerate(pairs)], "i int, a string, b string, score_note string")
    for row in align.align_pairs(df, "a", "b", local=local).collect():
        if row["a"] is None:
            assert row["score"] is None and row["identity"] is None
        else:
            assert row["score"] == plain_affine(row["a"].upper(), row["b"].upper(), local=local)
            assert row["n_matches"] <= row["n_columns"]
    if not local:
        got = align.align_pairs(df.where("i = 4"), "a", "b").first()
        assert (got["n_matches"], got["n_columns"], got["identity"]) == (8, 10, 0.8)
    assert align.align_pairs(df.where("i < 0"), "a", "b").count() == 0


def test_off_targets(spark):
    r = random.Random(3)
    texts = ["".join(r.choices("ACGT", k=20)) for _ in range(10)]
    near = []
    for t in texts:
        for n in (0, 1, 2, 3):
            s = list(t)
            for at in r.sample(range(20), n):
                s[at] = r.choice([c for c in "ACGT" if c != s[at]])
            near += ["".join(s)] * 2
    q, t = spark.createDataFrame([(x,) for x in [*texts, texts[0]]], "guide string"), spark.createDataFrame([(x,) for x in [*near, None]], "guide string")
    expected = Counter()
    for x in set(texts):
        for y in near:
            n = sum(a != b for a, b in zip(x, y, strict=True))
            if n <= 2:
                expected[x, n] += 1
    assert {(g["guide"], g["n_mismatches"]): g["n_sites"] for g in design.off_targets(q, t).collect()} == expected
    assert design.off_targets(q, t.where("guide = ''")).count() == 0


def test_off_targets_meet_few(spark):
    """Only targets that share three pieces at their places are moved; other lengths and limits are found too."""
    r = random.Random(11)
    many = ["".join(r.choices("ACGT", k=20)) for _ in range(4000)]
    q, t = (spark.createDataFrame([(x,) for x in texts], "guide string") for texts in (many[:40], many))
    found = design.off_targets(q, t)
    assert {(x["guide"], x["n_mismatches"]): x["n_sites"] for x in found.collect()} == Counter((x, n) for x in many[:40] for y in many if (n := sum(map(str.__ne__, x, y))) <= 2)
    h = design.hashed_pieces(many, 5, [(0, 1, 2), (1, 2, 3)])
    shifted = design.hashed_pieces([x[4:] + "ACGT" for x in many], 5, [(0, 1, 2), (1, 2, 3)])
    assert not set(h[1].tolist()) & set(shifted[0].tolist())  # the same letters in other pieces
    for m in (0, 1, 3):
        few = [many[0][:11], many[0][:8] + many[1][:3], many[2][:11], "A" + many[0][1:11]]
        df = spark.createDataFrame([(x,) for x in few], "guide string")
        assert {(x["guide"], x["n_mismatches"]): x["n_sites"] for x in design.off_targets(df, df, m).collect()} == Counter((x, n) for x in set(few) for y in few if (n := sum(map(str.__ne__, x, y))) <= m)


def test_diagonals(spark, tmp_path):
    r = random.Random(7)
    texts = ["".join(r.choices("ACgt", k=90)) for _ in range(6)]
    a = [*texts, texts[0][10:50] + "é😀" + texts[1][:30], "A" * 25, "ACG", "", None]
    b = [texts[0][5:40], texts[0][5:40].upper(), texts[2][30:60] + texts[3][:20], "é😀" + texts[1][:9], "a" * 9, "ACG", None]
    for name, x in (("a", a), ("b", b)):
        spark.createDataFrame(list(enumerate(x)), "key int, sequence string").write.parquet(str(tmp_path / name))  # of known, small size
    left, right = (spark.read.parquet(str(tmp_path / name)) for name in "ab")
    got = align.diagonals(left, right, 8)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    expected = Counter()
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            equal = {(p, q) for p in range(len(x or "")) for q in range(len(y or "")) if x[p].upper() == y[q].upper()}
            for p, q in equal:
                if (p - 1, q - 1) not in equal:
                    n = next(n for n in range(1, 99) if (p + n, q + n) not in equal)
                    if n >= 8:
                        expected[i, j, p + 1, q + 1, n] += 1
    assert Counter(tuple(x) for x in got.collect()) == expected
    for k in (1, 5, 8):
        cut = [(i, at + place) for block in align.stretches(b, k, 11) for s, place in zip(*(x.tolist() for x in align.words_in(block, k)[:2]), strict=True) for i, at, _ in [block[s]]]
        assert sorted(cut) == [(i, p) for i, y in enumerate(b) for p in range(len(y or "") - k + 1)]


def test_circular_fragments(spark):
    found = spark.createDataFrame([(1, 3), (1, 8), (1, 8), (2, 5)], "record_id long, start long")
    lengths = spark.createDataFrame([(1, 10), (2, 9), (3, 7), (4, 0)], "record_id long, length long")
    got = {tuple(r) for r in design.circular_fragments(found, lengths).select("record_id", "start", "end", "length").collect()}
    assert got == {(1, 9, 3, 5), (1, 4, 8, 5), (2, 6, 5, 9), (3, 1, 7, 7)}


def test_coding(spark):
    usage = spark.createDataFrame([("TTT", "F", 8), ("TTC", "F", 2), ("AAA", "K", 3), ("AAG", "K", 3), ("TAA", "*", 9)], "codon string, amino_acid string, n long")
    rows = spark.createDataFrame([(1, "TTTTTCAAAT"), (2, "TAANNN"), (3, ""), (4, None)], "id int, s string")
    got = {r["id"]: (r["n_scored"], r["n_ignored"], r["cai"]) for r in coding.adaptation_index(rows, ["id"], "s", coding.relative_adaptiveness(usage)).collect()}
    assert got == {1: (3, 0, round(0.25 ** (1 / 3), 6)), 2: (0, 2, None), 3: (0, 0, None)}
    choice = coding.favoured_codons(usage)
    back = coding.reverse_translate(spark.createDataFrame([("fKX*",), ("",), (None,)], "p string"), "p", choice)
    assert [r["coding"] for r in back.collect()] == ["TTTAAANNNTAA", "", None]
    profile = coding.hydropathy_profile(spark.createDataFrame([(1, "AIX"), (2, ""), (3, None)], "id int, s string"), ["id"], "s", 2).orderBy("start").collect()
    assert [(r["id"], r["position"], r["n_known"], r["hydropathy"]) for r in profile] == [(1, 1.5, 2, 3.15), (1, 2.5, 1, 4.5)]


def test_simulation(spark):
    r = random.Random(1)
    texts = ["".join(r.choices("ACGT", k=400)), "AC", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    changed = df.select("s", simulate.shuffle_letters(F.col("s"), F.col("id")).alias("t"), simulate.mutate(F.col("s"), F.col("id"), 0.1).alias("m"), simulate.mutate(F.col("s"), F.col("id"), 0, 0, 1.0).alias("none")).collect()
    for row in changed:
        if row["s"] is None:
            assert row["t"] is None and row["m"] is None
        else:
            assert Counter(row["s"]) == Counter(row["t"]) and len(row["m"]) == len(row["s"]) and row["none"] == ""
    assert changed[0]["t"] != texts[0] and 15 < sum(a != b for a, b in zip(texts[0], changed[0]["m"], strict=True)) < 70
    source, start, end, _, mate = simulate.true_place(F.col("title"))
    simulated = simulate.paired_reads(df, "id", "s", 30, 100, 6, 0).select("*", source.alias("source"), start.alias("a"), end.alias("b"), mate.alias("mate")).collect()
    assert len(simulated) == 80
    turn = str.maketrans("ACGT", "TGCA")
    for row in simulated:
        whole = texts[int(row["source"])][row["a"] - 1 : row["b"]]
        assert len(whole) == 100 and len(row["quality"]) == 30
        assert row["sequence"] in (whole[:30], whole.translate(turn)[::-1][:30])
    wrapped = simulate.fragments(df.where("id = 1"), "id", "s", 2, 1, circular=True).collect()
    assert {x["start"] for x in wrapped} <= {1, 2} and all(x["end"] == 3 - x["start"] for x in wrapped)


def test_trimming(spark):
    rows = [("A" * 30, "!" * 5 + "I" * 22 + "!" * 3), ("ACGT", "IIII"), ("", ""), (None, None), ("ACGTN", "IIII")]
    df = spark.createDataFrame(rows, "sequence string, quality string")
    kept = [(r["sequence"], r["kept_start"], r["kept_end"]) for r in reads.trim_best(df).collect()]
    assert kept[0] == ("A" * 22, 6, 27) and kept[1][0] == "ACGT" and kept[2][0] == "" and kept[3][0] is None and kept[4][0] == "ACGT"
    tail = [r["sequence"] for r in reads.trim_tail(df).collect()]
    assert tail[0] == "A" * 29 and tail[1] == "ACGT" and tail[2] == ""
    faults = [r[0] for r in df.select(reads.read_faults(F.col("sequence"), F.col("quality"), 4, 0)).collect()]
    assert faults == [[], [], ["too short"], ["too short"], ["too many N"]]


GENBANK = '''LOCUS       AB1  20 bp DNA
DEFINITION  A made-up
            record.
ACCESSION   AB000001
SOURCE      x
  ORGANISM  Madeup exemplum
FEATURES             Location/Qualifiers
     source          1..20
     CDS             complement(join(2..4,
                     8..9))
                     /gene="x"
                     /note="two
                     lines ""quoted"""
                     /pseudo
ORIGIN
        1 aaccggttac gtacgtacgt
//
'''
EMBL = '''ID   X9; SV 1; linear; DNA; 12 BP.
DE   Another
DE   record
OS   Madeup alter
FT   gene            join(1..3,complement(5))
FT                   /gene="y"
SQ   Sequence 12 BP;
     acgtacgtac gt                                                            12
//
'''


def test_flatfiles(spark, tmp_path):
    (tmp_path / "a.gb").write_text(GENBANK + EMBL)
    records = flatfile.read_flatfiles(spark, str(tmp_path / "a.gb"))
    got = {r["accession"]: r for r in records.collect()}
    assert set(got) == {"AB000001", "X9"}
    assert got["AB000001"]["definition"] == "A made-up record." and got["AB000001"]["organism"] == "Madeup exemplum" and got["AB000001"]["sequence"] == "AACCGGTTACGTACGTACGT"
    assert got["X9"]["definition"] == "Another record" and got["X9"]["sequence"] == "ACGTACGTACGT" and got["X9"]["organism"] == "Madeup alter"
    rows = {(r["accession"], r["type"]): r for r in flatfile.feature_rows(records).collect()}
    cds = rows["AB000001", "CDS"]
    assert (cds["location"], cds["start"], cds["end"], cds["strand"], cds["letters"]) == ("complement(join(2..4,8..9))", 2, 9, "-", "TAGGT")
    assert [(q["name"], q["value"]) for q in cds["qualifiers"]] == [("gene", "x"), ("note", 'two lines "quoted"'), ("pseudo", "")]
    assert rows["X9", "gene"]["letters"] == "ACGT" and rows["AB000001", "source"]["letters"] == "AACCGGTTACGTACGTACGT"


def test_locations(spark):
    texts = ["5", "<1..>9", "3^4", "join(1..2,complement(join(4..5,7)))", "order(1..2,9)", "J00194.1:1..5", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(flatfile.location_ranges(F.col("t"))).collect()]
    flat = [None if x is None else [tuple(y) for y in x] for x in got]
    assert flat == [[(5, 5, "+")], [(1, 9, "+")], [(3, 4, "+")], [(1, 2, "+"), (4, 5, "-"), (7, 7, "-")], [(1, 2, "+"), (9, 9, "+")], [], [], None]


def test_context(spark):
    df = spark.createDataFrame([("ACGTACGT", 3, 4), ("ACGT", 1, 4)], "s string, a int, b int")
    assert [r[0] for r in df.select(in_context(F.col("s"), F.col("a"), F.col("b"), 3)).collect()] == ["acGTacg", "ACGT"]
