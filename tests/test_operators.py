import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.functions import exprs, seq, special
from strandloom.operators import genomics, intervals, plotdata, profile, scan, sets_text, stats, tables
from strandloom.plans import workflow
from strandloom.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "value"), [("1", 1.0), (" -2.5e3 ", -2500.0), ("1d", None), ("NaN", None), ("Infinity", None), ("", None), (".5", 0.5), ("5.", 5.0), ("1e999", None), ("0x10", None)])
def test_to_num(spark, text, value):
    assert one(spark, exprs.to_num(F.lit(text))) == value


def test_natural_order(spark):
    names = ["chr10", "chr2", "Chr1", "chr02", "x", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in df.orderBy(exprs.natural_key(F.col("n")), F.desc("n")).collect()] == ["", "Chr1", "chr2", "chr02", "chr10", "x"]


def test_blank_policies(spark):
    assert one(spark, exprs.to_num_sql(F.lit(" "))) == 0.0
    df = spark.createDataFrame([("", "2"), ("3", ""), (None, "x")], "a string, b string")
    assert [r["s"] for r in tables.calculate(df, "s", "add", "a", "b").collect()] == [2.0, 3.0, None]
    assert [r["s"] for r in tables.calculate(df, "s", "divide", "b", "a").collect()] == [None, 0.0, None]
    assert [r["s"] for r in tables.calculate(df, "s", "add", "a", 5).collect()] == [5.0, 8.0, 5.0]


def test_join_blank_keys_and_clashing_names(spark):
    a = spark.createDataFrame([("A ", 1, "x"), ("", 2, "y"), (None, 3, "z"), ("b", 4, "w")], "k string, v int, s string")
    b = spark.createDataFrame([("a", "p"), ("a", "q"), (" ", "r"), ("c", "t")], "k string, s string")
    inner = tables.join_tables(a, b, [("k", "k")])
    assert inner.columns == ["k", "v", "s", "s_right"]
    assert sorted((r["v"], r["s_right"]) for r in inner.collect()) == [(1, "p"), (1, "q")]
    assert tables.join_tables(a, b, [("k", "k")], "left").count() == 5
    full = tables.join_tables(a, b, [("k", "k")], "full").collect()
    assert len(full) == 7 and "c" in {r["k"] for r in full}


def test_cleaner_order_and_ties(spark):
    df = spark.createDataFrame([(3, " a  b", "NA"), (1, "a b", "."), (2, None, "null"), (4, "c", "1")], "id int, x string, y string")
    out = tables.clean_table(df, ties=["id"]).collect()
    assert sorted((r["id"], r["x"], r["y"]) for r in out) == [(1, "a b", ""), (4, "c", "1")]


def test_rules(spark):
    df = spark.createDataFrame([("10", "Ab"), ("9", ""), ("x", None)], "n string, t string")
    count = lambda *r: df.where(tables.row_rule(df, *r)).count()
    assert [count("N", "gt", "9"), count("n", "lte", "9"), count("t", "contains", "B"), count("t", "not_contains", "b"), count("t", "empty"), count("n", "not_equals", "9")] == [1, 1, 1, 2, 2, 2]
    assert tables.rule_lines("a|gt|5\n# no\n\nb|empty", 3) == [["a", "gt", "5"], ["b", "empty", ""]]


def test_pivot_and_back(spark):
    df = spark.createDataFrame([(1, "a", "5"), (1, "a", "7"), (1, "b", ""), (2, "b", "1"), (2, "", "9")], "id int, n string, v string")
    wide = {r["id"]: (r["a"], r["b"]) for r in tables.long_to_wide(df, ["id"], "n", "v", "sum", columns=["a", "b"]).collect()}
    assert wide == {1: (12.0, 0.0), 2: (None, 1.0)}
    assert tables.wide_to_long(spark.createDataFrame([(1, 2, 3)], "id int, a int, b int"), ["id"], ["a", "b"]).count() == 2


def test_samples_repeat(spark):
    df = spark.range(2000).toDF("id")
    a, b = (sorted(r["id"] for r in tables.sample_rows(df.repartition(n), 50, ["id"]).collect()) for n in (3, 7))
    assert a == b and len(a) == 50
    drawn = tables.sample_with_replacement(df, 6000, ["id"]).collect()
    assert len(drawn) == 6000 and sorted(r["draw"] for r in drawn) == list(range(6000)) and 1850 < len({r["id"] for r in drawn}) < 1950
    assert tables.sample_with_replacement(df.where("id = 3"), 100, ["id"]).count() == 100
    assert tables.sample_with_replacement(df.where("id < 0"), 5, ["id"]).count() == 0


def test_average_ranks_and_ties(spark):
    rng = random.Random(1)
    values = [rng.choice([-1e9, -2.5, -0.25, 0.0, 0.5, 3.0, 1e12]) for _ in range(200)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, x double")
    order = sorted(values)
    expected = {v: (order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in set(values)}
    got = {r["x"]: r["r"] for r in profile.average_ranks(df, ["g"], "x", "r").collect()}
    assert got == expected


def test_tails():
    assert math.isclose(special.t_two_sided(2.0, 10), 0.07338803477, abs_tol=1e-9)
    assert math.isclose(special.f_tail(4.0, 2, 10), (1 + 2 * 4 / 10) ** -5, abs_tol=1e-12)
    assert math.isclose(special.gamma_tail(1, 2.5), math.exp(-2.5), abs_tol=1e-12)
    assert math.isclose(special.normal_quantile(0.975), 1.959963984540054, abs_tol=1e-9)
    assert math.isclose(special.beta_inc(2, 3, 0.4), 0.5248, abs_tol=1e-9)


def test_fisher_against_enumeration(spark):
    df = spark.createDataFrame([(True, True)] * 3 + [(True, False)] + [(False, True)] + [(False, False)] * 3, "a boolean, b boolean")
    assert stats.fisher_exact(df, F.col("a"), F.col("b")).first()["p"] == pytest.approx(0.485714, abs=1e-6)


def test_regression_recovers_a_plane(spark):
    rng = random.Random(2)
    rows = [(x := rng.random(), z := rng.random(), 1 + 2 * x - 3 * z) for _ in range(50)]
    out = {r["term"]: r["coefficient"] for r in stats.multiple_regression(spark.createDataFrame(rows, "x double, z double, y double"), "y", ["x", "z"]).collect()}
    assert out == pytest.approx({"intercept": 1, "x": 2, "z": -3}, abs=1e-4)


def test_holm_is_monotone(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "i int, p double")
    assert [round(r["p_adjusted"], 4) for r in stats.adjusted(df).orderBy("i").collect()] == [0.03, 0.06, 0.06, 0.02]


def test_pca_orientation(spark):
    df = spark.createDataFrame([(i, float(i), -2.0 * i, 1.0) for i in range(20)], "id int, a double, b double, c double")
    out = stats.principal_components(df, [F.col("a"), F.col("b"), F.col("c")], ["id"], 1).orderBy("id").collect()
    assert abs(out[0]["pc1"]) == pytest.approx(abs(out[-1]["pc1"]), abs=1e-6)


def brute_pairs(a, b):
    return {(i, j) for i, r, s, e in a for j, q, t, f in b if r == q and s <= f and t <= e}


def test_interval_operations_against_loops(spark):
    rng = random.Random(4)
    make = lambda n: [(i, rng.choice("xy"), s := rng.randrange(1, 30_000), s + rng.choice([0, 5, 50, 9000])) for i in range(n)]
    a, b = make(60), make(50) + [(99, "z", 1, 2)]
    schema = "id long, record string, start long, end long"
    qa, rb = spark.createDataFrame([*a, (500, "w", 5, 6)], schema), spark.createDataFrame(b, schema)
    a = [*a, (500, "w", 5, 6)]
    assert {(r["id"], r["ref_id"]) for r in intervals.intersect(qa, rb).collect()} == brute_pairs(a, b)
    assert intervals.intersect(qa, rb).count() == len(brute_pairs(a, b))
    near = {r["id"]: r["distance"] for r in intervals.nearest(qa, rb, ["id"]).collect()}
    assert near == {i: min((max(0, t - e, s - f) for _, q, t, f in b if q == r), default=None) for i, r, s, e in a}
    left = Counter()
    for r in intervals.subtract(qa, rb, ["id"]).collect():
        left[r["id"]] += r["end"] - r["start"] + 1
    covered = {r: set().union(*(range(t, f + 1) for _, q, t, f in b if q == r)) for r in "xyw"}
    assert left == Counter({i: n for i, r, s, e in a if (n := len(set(range(s, e + 1)) - covered[r]))})
    depth = {(r["record"], p): r["depth"] for r in intervals.depth(rb, ["record"]).collect() for p in range(r["start"], r["end"] + 1)}
    assert depth == Counter((q, p) for _, q, t, f in b for p in range(t, f + 1))


def test_cigar(spark):
    assert one(spark, seq.reference_span(F.lit("5S10M2I3D4N1=1X2H"))) == 19
    assert one(spark, seq.query_length(F.lit("5S10M2I3D4N1=1X2H"))) == 19
    assert [tuple(x) for x in one(spark, seq.covered_blocks(F.lit(100), F.lit("2S5M3D2M")))] == [(100, 104), (108, 109)]
    assert one(spark, seq.reference_span(F.lit("*"))) == 0
    assert one(spark, seq.reference_span(F.lit(None).cast("string"))) == 0


def test_sequence_functions(spark):
    assert one(spark, seq.reverse_complement(F.lit("AaRN-u"))) == "a-NYtT"
    assert one(spark, seq.translate(F.lit("ATGAARTAA"))) == "MX*"
    assert one(spark, seq.translate(F.lit("AT"))) == ""
    assert one(spark, seq.wrapped(F.lit("A" * 5), 2)) == "AA\nAA\nA"
    rows = spark.createDataFrame([(1, "GAATTCGAATTC"), (2, None), (3, "")], "record_id long, s string")
    assert sorted(r["start"] for r in scan.find_motifs(rows, "record_id", "s", {"e": "GAATTC"}).collect()) == [1, 7]
    orf = spark.createDataFrame([(1, "CC" + "ATG" + "GCA" * 5 + "TAA" + "G")], "record_id long, s string")
    assert [(r["strand"], r["frame"], r["start"], r["end"], r["n_codons"]) for r in scan.find_orfs(orf, "record_id", "s", 6).collect()] == [("+", 3, 3, 23, 6)]


def test_variants(spark):
    lines = ["##x", "#CHROM\tPOS", "1\t10\t.\tA\tG\t50\tPASS\tDP=3;DB;DP=4\tGT:DP\t0/1:3\t./.", "1\t20\t.\tAT\tA\t.\tq10\tEND=30", "1\t0\t.\tA\tG\t.\t.\t.", "short"]
    vcf = genomics.parse_vcf(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r["pos"]: r for r in vcf.collect()}
    assert set(got) == {10, 20} and got[10]["info"] == {"DP": "4", "DB": ""} and got[20]["end"] == 30 and got[20]["kind"] == "deletion"
    calls = genomics.genotypes(vcf, ["s1", "s2"]).withColumn("c", genomics.genotype_class(F.col("gt")))
    assert sorted((r["sample"], r["c"]) for r in calls.collect()) == [("s1", "het"), ("s2", "missing")]
    assert genomics.filter_variants(vcf, "1", 25, 40, passed=False).count() == 1


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Sample ID,Sample ID,x\n1,"a,b\n""c""",\n,,\n2,z\n')
    df = readers.read_delimited(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["sample_id", "sample_id_2", "x"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", 'a,b\n"c"', ""), ("2", "z", "")]
    assert tables.find_column(df, "Sample ID") == "sample_id"
    (tmp_path / "s.fasta").write_text(">a one\nAC\nGT\n>b\n\n>c\nTT\n")
    assert sorted(tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "s.fasta")).collect()) == [("a one", "ACGT"), ("b", ""), ("c", "TT")]
    writers.write_fasta(spark.createDataFrame([("x", "ACGTACGT")], "title string, sequence string"), str(tmp_path / "out"), width=4)
    assert [tuple(r) for r in readers.read_fasta(spark, str(tmp_path / "out")).collect()] == [("x", "ACGTACGT")]
    (tmp_path / "r.fastq").write_text("@r1\nACGT\n+\n@III\n@r2\nAC\n+\nI\n")
    reads = readers.read_fastq(spark, str(tmp_path / "r.fastq"))
    assert [(r["title"], r["quality"], r["problem"]) for r in reads.orderBy("read_no").collect()] == [("r1", "@III", None), ("r2", "I", "length")]
    assert genomics.read_summary(reads.where("problem IS NULL")).first()["q30_percent"] == 100.0
    assert genomics.position_qualities(reads).count() == 4
    (tmp_path / "f.gff").write_text("##gff\nc\ts\texon\t5\t9\t.\t+\t.\tID=e1;Parent=t1,t2;Note=a%20b\nc\ts\texon\t9\t5\t.\t+\t.\tID=x\n")
    features = readers.read_features(spark, str(tmp_path / "f.gff"))
    assert features.first()["attributes"]["Note"] == "a b" and genomics.transcript_parts(features).count() == 2
    (tmp_path / "b.bed").write_text("track\nc\t0\t5\tn\nc\t7\t7\tz\n")
    bed = readers.read_bed(spark, str(tmp_path / "b.bed"))
    assert [(r["start"], r["end"]) for r in bed.collect()] == [(1, 5)]
    assert writers.bed_lines(bed).first()["value"].startswith("c\t0\t5\tn")
    (tmp_path / "a.sam").write_text("@HD\nq\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\tNM:i:2\n")
    assert readers.read_sam(spark, str(tmp_path / "a.sam")).first()["tags"] == {"NM": "2"}
    (tmp_path / "j.json").write_text('[{"a": 1, "b": {"c": 2}}, {"a": "x"}]')
    assert sorted(tuple(r) for r in readers.read_json_table(spark, str(tmp_path / "j.json")).collect()) == [("1", '{"c":2}'), ("x", "")]
    assert readers.detect_delimiter(["a;b;c", "1;2;3"])[0] == "semicolon" and readers.detect_delimiter(["x"]) == ("tab", 0.0)
    assert writers.markdown(spark.createDataFrame([("a|b",)], "x string")).endswith("| a\\|b |")


def test_text_and_lists(spark):
    df = spark.createDataFrame([(1, "Don't stop\nGo"), (2, None), (3, "")], "id int, t string")
    assert [r["word"] for r in sets_text.word_counts(df, "t", ["go"], 2).orderBy("word").collect()] == ["don't", "stop"]
    assert [(r["line"], r["matched"]) for r in sets_text.text_matches(df, ["id"], "t", "o").collect()] == [(1, "o"), (1, "o"), (2, "o")]
    lists = [("a", spark.createDataFrame([("X ",), ("y",), ("",)], "v string")), ("b", spark.createDataFrame([("x",), ("x",), (None,)], "v string"))]
    assert sorted((r["key"], r["in_a"], r["in_b"], r["membership"]) for r in sets_text.compare_lists(lists).collect()) == [("x", 1, 2, "a&b"), ("y", 1, 0, "a")]


def test_levels_of_a_cycle_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string")
    assert plotdata.node_levels(edges, most=3).count() == 2


def test_workflow_is_checked_before_it_runs(spark):
    with pytest.raises(ValueError, match="takes records"):
        workflow.check([{"op": "translate"}])
    with pytest.raises(ValueError, match="unknown"):
        workflow.check([{"op": "nope"}])
    assert workflow.check([{"op": "to_records"}, {"op": "find_orfs"}]) == "table"
    with pytest.raises(ValueError, match="map takes records"):
        workflow.check([{"op": "map", "steps": []}])


def test_workflow_maps_items(spark):
    df = spark.createDataFrame([(1, "ACGAATTC"), (2, "AC")], "record_id long, sequence string")
    steps = [{"op": "to_records"}, {"op": "split"}, {"op": "map", "steps": [{"op": "min_length", "n": 3}, {"op": "find_motifs", "motifs": {"e": "GAATTC"}}]}]
    assert workflow.check(steps) == "table"
    assert [(r["record_id"], r["start"]) for r in workflow.run(df, steps).collect()] == [(1, 3)]


@pytest.mark.parametrize("make", [lambda d: tables.summarize_groups(d, ["g"], ["x"]), lambda d: profile.column_profile(d, ["g", "x"]), lambda d: profile.outliers(d, "g", "x"), lambda d: plotdata.histogram(d, "x"), lambda d: plotdata.box(d, ["g"], "x"), lambda d: plotdata.density(d, ["g"], "x"),
                                  lambda d: stats.anova(d, "g", "x"), lambda d: stats.kruskal_wallis(d, "g", "x"), lambda d: stats.linear_regression(d, "x", "x"), lambda d: profile.describe(d, ["x"]), lambda d: stats.multiple_regression(d, "x", ["x"]), lambda d: stats.chi_square(d, "g", "x")])
def test_empty_and_null_tables(spark, make):
    for rows in ([], [(None, None)], [("a", None), (None, 1.0)]):
        make(spark.createDataFrame(rows, "g string, x double")).collect()
