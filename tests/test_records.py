import pytest
from pyspark.sql import functions as F

from strandloom.operators import records, stats


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, ">a one", "ACGT"), (2, "a two", "AC GT\n"), (3, None, "AC!T"), (4, " ", None), (5, "b", "")]
    return spark.createDataFrame([(*r, "x") for r in rows], "record_id long, title string, sequence string, reasons string")


def test_validate(df):
    got = sorted((r["record_id"], r["problem"]) for r in records.validate(df, "record_id").collect())
    assert got == [(1, "repeated name"), (2, "repeated name"), (3, "illegal letters"), (3, "no name"), (4, "empty sequence"), (4, "no name"), (5, "empty sequence")]


def test_extract(spark, df):
    ids = spark.createDataFrame([("a ",), ("",), (None,), ("a",)], "title string")
    assert sorted(r["record_id"] for r in records.extract_by_id(df, ids).collect()) == [1, 2]
    assert sorted(r["record_id"] for r in records.extract_by_id(df, ids, keep=False).collect()) == [3, 4, 5]


def test_reasons_and_titles(spark, df):
    got = {r["record_id"]: r["reasons"] for r in records.with_reasons(df, least=4, max_gc=40.0).collect()}
    assert got == {1: "GC too high", 2: "GC too high", 3: "", 4: "too short", 5: "too short"} or got[3] == "GC too high"
    assert {r["record_id"]: r["title"] for r in records.rename(df, "title", "^>", "", "x_").collect()}[1] == "x_a one"


def test_weights(spark):
    rows = spark.createDataFrame([(1, "TTACGTAC"), (2, None), (3, "AC"), (4, "ac gné")], "record_id long, s string")
    w = {"A": [1, 0, 0], "C": [0, 1, 0], "G": [0, 0, 1], "T": [0, 0, 0]}
    assert sorted((r["record_id"], r["start"], r["end"]) for r in records.scan_weights(rows, "record_id", "s", w, 1.0).collect()) == [(1, 3, 5), (4, 1, 3)]


def test_two_way_balanced(spark):
    cells = {("p", "u"): [1.0, 2.0], ("p", "v"): [3.0, 4.0], ("q", "u"): [5.0, 6.0], ("q", "v"): [11.0, 12.0]}
    df = spark.createDataFrame([(a, b, x) for (a, b), xs in cells.items() for x in xs], "a string, b string, x double")
    got = {r["term"]: (r["ss"], r["df"], r["f"]) for r in stats.two_way_anova(df, "a", "b", "x").collect()}
    assert got["a"] == pytest.approx((72.0, 1, 144.0)) and got["b"] == pytest.approx((32.0, 1, 64.0)) and got["a x b"] == pytest.approx((8.0, 1, 16.0)) and got["residual"][:2] == pytest.approx((2.0, 4))
    assert stats.two_way_anova(df.where("false"), "a", "b", "x").count() == 0


def test_repeated_measures(spark):
    rows = [(s, c, float(x)) for s, xs in ((1, (1, 2, 4)), (2, (2, 4, 5)), (3, (3, 3, 7))) for c, x in zip("abc", xs)] + [(4, "a", 9.0)]
    r = stats.repeated_measures_anova(spark.createDataFrame(rows, "s long, c string, x double"), "s", "c", "x").first()
    means = [2.0, 3.0, 16 / 3]
    grand = sum(means) / 3
    ssc = 3 * sum((m - grand) ** 2 for m in means)
    inner = sum((x - sum(xs) / 3) ** 2 for xs in ((1, 2, 4), (2, 4, 5), (3, 3, 7)) for x in xs)
    assert (r["n_subjects"], r["df_condition"], r["df_error"]) == (3, 2, 4)
    assert r["f"] == pytest.approx((ssc / 2) / ((inner - ssc) / 4), abs=1e-3)


def test_regions(spark):
    regions = records.parse_regions(spark.createDataFrame([("a:2-3",), ("a",), ("b:1,0-99",), ("c:9",), (" ",), (None,)], "region string"))
    rows = spark.createDataFrame([("a", "AC GT"), ("b", "A" * 12), ("c", "ACGT"), (None, "A"), ("a", None)], "name string, sequence string")
    got = {tuple(r) for r in records.fetch_regions(rows, regions).collect()}
    assert got == {("a", 2, 3, "CG"), ("a", 1, 4, "ACGT"), ("b", 10, 12, "AAA")}


def test_changes(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3), ("w", None)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("y", 5), (None, 3), ("z", 1), ("w", None)], "k string, v int")
    assert {tuple(r) for r in records.changes(a, b, ["k"], ["v"]).collect()} == {("x", "same", ""), ("y", "changed", "v"), (None, "same", ""), ("z", "added", ""), ("w", "same", "")}
    assert {r["change"] for r in records.changes(a, b.where("k = 'q'"), ["k"], ["v"]).collect()} == {"removed"}


def test_edits(spark):
    df = spark.createDataFrame([("ACGTAC", 3, 4, "T"), ("ACGTAC", 3, 2, "TT"), ("ACGTAC", 7, 6, "G"), ("ACGTAC", 6, 9, "G"), ("", 1, 0, "A")], "s string, a int, b int, t string")
    c = [F.col(x) for x in "sabt"]
    assert [r[0] for r in df.select(records.edit_letters(*c)).collect()] == ["ACTAC", "ACTTGTAC", "ACGTACG", "ACGTAC", "A"]
    places = spark.createDataFrame([(1, 2), (5, 6), (2, 5), (3, 4), (2, 3), (4, 6)], "x int, y int")
    moved = places.select(records.moved_place(F.col("x"), F.col("y"), F.lit(3), F.lit(4), F.lit("T")).alias("m")).collect()
    assert [m["m"] and tuple(m["m"]) for m in moved] == [(1, 2), (4, 5), (2, 4), None, (2, 2), (4, 5)]
