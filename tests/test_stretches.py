import random
import re

import pytest
from pyspark.sql import functions as F

from strandloom.functions import seq
from strandloom.operators import align, blocks, records
from strandloom.sources import readers

TURN = str.maketrans("ACGTN", "TGCAN")


def by_seeds(s, t, k, penalty, drop):
    """Every equal word of nucleotides extended by itself."""
    out = set()
    for i in range(len(s) - k + 1):
        for j in range(len(t) - k + 1):
            if s[i : i + k] == t[j : j + k] and re.fullmatch("[ACGT]+", s[i : i + k]):
                a, b, best, total = i, i + k - 1, 0, 0
                for n in range(1, min(i, j) + 1):
                    total += 1 if s[i - n] == t[j - n] else -penalty
                    if total > best:
                        best, a = total, i - n
                    if best - total > drop:
                        break
                best = total = 0
                for n in range(1, min(len(s) - i, len(t) - j) - k + 1):
                    total += 1 if s[i + k - 1 + n] == t[j + k - 1 + n] else -penalty
                    if total > best:
                        best, b = total, i + k - 1 + n
                    if best - total > drop:
                        break
                out.add((a, b, j - i + a))
    return out


def expected(rows, targets, k, least, identity, penalty=5, drop=12):
    out = set()
    for key, s in rows:
        for ref, t in targets:
            for strand, q in (("+", s), ("-", s.translate(TURN)[::-1])):
                rated = []
                for a, b, at in by_seeds(q, t, k, penalty, drop):
                    n = b - a + 1
                    wrong = sum(x != y for x, y in zip(q[a : b + 1], t[at : at + n], strict=True))
                    if n >= least and round((n - wrong) / n * 100, 2) >= identity:
                        x, y = (a + 1, b + 1) if strand == "+" else (len(q) - b, len(q) - a)
                        rated.append((-(n - penalty * wrong), -n, x, y, at + 1, wrong))
                kept = []
                for r in sorted(rated):
                    if all(min(r[3], o[3]) - max(r[2], o[2]) + 1 < 0.8 * (min(r[3] - r[2], o[3] - o[2]) + 1) for o in kept):
                        kept.append(r)
                out |= {(key, ref, strand, r[2], r[3], r[4], r[5]) for r in kept}
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_similar_stretches(spark, seed):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    targets = [(f"t{i}", letters(40)) for i in range(3)] + [("n", letters(12) + "N" * 8 + letters(12))]
    rows = []
    for i in range(12):
        t = rng.choice(targets)[1][rng.randrange(8) :]
        t = "".join(rng.choice("ACGT") if rng.random() < 0.06 else c for c in t)
        rows.append((i, letters(rng.randrange(15)) + rng.choice([t, t.translate(TURN)[::-1]]) + letters(rng.randrange(15))))
    rows.append((50, "AC" * 30))
    targets.append(("ac", "CACA" * 6))
    df = spark.createDataFrame([*rows, (90, None), (91, "")], "key long, sequence string")
    got = align.similar_stretches(df, spark.createDataFrame([*targets, ("none", None)], "key string, sequence string"), 6, 12, 85.0)
    found = [(r["key"], r["reference"], r["strand"], r["start"], r["end"], r["reference_start"], r["mismatches"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == expected(rows, targets, 6, 12, 85.0) and found


def test_sequence_forms(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(seq.grouped(F.lit("ACGTACGTACG"), 3, 2)) == "ACG TAC\nGTA CG" and one(seq.grouped(F.lit(""))) == ""
    assert [one(seq.auto_window(F.lit(n))) for n in (0, 10, 100, 121, 1000, 1001, 100_000, 10_000_000)] == [1, 6, 13, 25, 25, 25, 100, 10_000]
    assert one(seq.codon_alignment(F.lit("-MK-X"), F.lit("ATGAA"))) == "---ATG---------"
    assert [tuple(x) for x in one(seq.aligned_bases(F.lit(5), F.lit("1S2M1I1D2M"), F.lit("acgtac")))] == [(5, "C"), (6, "G"), (8, "A"), (9, "C")]
    assert [tuple(x) for x in one(seq.aligned_bases(F.lit(5), F.lit("*"), F.lit("ac")))] == [(5, "A"), (6, "C")]
    assert [tuple(x) for x in one(seq.aligned_bases(F.lit(1), F.lit("3M"), F.lit("a")))] == [(1, "A"), (2, "N"), (3, "N")]
    assert one(seq.isoelectric_point(F.lit("***"))) is None and 10 < one(seq.isoelectric_point(F.lit("KKK"))) < 12 and one(seq.protein_charge(F.lit("DDD"), F.lit(7.0))) < -2.5
    codes = {n: seq.genetic_code(n) for n in seq.CODES}
    assert all(len(c) == 64 for c in codes.values()) and ("TGA", "W", False, False) in codes["2"] and ("TAA", "Q", False, False) in codes["6"]


def test_record_lists(spark):
    df = spark.createDataFrame([("b2", "GC"), ("b10", "AT"), (None, None), ("a", "ACGTN")], "title string, sequence string")
    order = lambda mode: [r["title"] for r in records.sort_records(df, mode).collect()]
    assert order("length-desc") == ["a", "b2", "b10", None] and order("gc-desc") == ["b2", "a", "b10", None] and order("title-asc") == [None, "a", "b2", "b10"] and order("ambiguous-desc")[0] == "a"
    with pytest.raises(ValueError, match="unknown order"):
        records.sort_records(df, "x-asc")
    assert records.id_list("# no\n>a, b\r\nc;;\t d ") == ["a", "b", "c", "d"]


def test_blocks(spark):
    rows = [("c", "r", "+", 1, 10, 5, 14, 90.0, 10, 60), ("c", "r", "+", 1, 10, 5, 14, 95.0, 10, None), ("c", "r", "-", 8, 20, 1, 13, 99.0, 13, 5), ("c", None, "+", 1, 2, 1, 2, 99.0, 2, 5)]
    df = spark.createDataFrame(rows, "comparison string, reference string, strand string, start long, end long, query_start long, query_end long, identity double, block_length long, mapq int")
    assert blocks.filter_blocks(df, 95, 3, 30).count() == 1 and blocks.filter_blocks(df, both_strands=False).count() == 3
    assert {(r["reference"], r["covered"]) for r in blocks.reference_coverage(df).collect()} == {("r", 20)}
    assert sorted((r["n_copies"], r["identity"]) for r in blocks.exact_block_copies(df).collect()) == [(1, 99.0), (1, 99.0), (2, 95.0)]


def test_fasta_index(spark, tmp_path):
    text = ">a one\nACGT\nACGT\nAC\n>b\n\n>c x\nACG\nACGTA\nAC\n>d\r\nAC\r\nA\r\n"
    (tmp_path / "x.fa").write_bytes(text.encode())
    (tmp_path / "y.fa").write_text(">e\nACGTACGT")
    got = {r["name"]: (r["length"], r["offset"], r["line_bases"], r["line_width"], r["uniform"]) for r in readers.fasta_index(spark, str(tmp_path)).collect()}
    at = lambda name: text.index("\n", text.index(f">{name}")) + 1
    assert got == {"a": (10, at("a"), 4, 5, True), "b": (0, at("b"), 0, 0, True), "c": (10, at("c"), 3, 4, False), "d": (3, at("d"), 2, 4, True), "e": (8, 3, 8, 9, True)}
