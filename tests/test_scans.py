import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import genomics, plotdata, scan

TURN = str.maketrans("ACGT", "TGCA")


def turned(s):
    return s.translate(TURN)[::-1]


def make(seed, n=25):
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    patterns = [("p1", letters(30)), ("p2", letters(18)), ("p3", letters(7)), ("p4", letters(5)), ("p5", letters(14))]
    rows = []
    for i in range(n):
        p = rng.choice(patterns)[1]
        p = rng.choice([p, turned(p)])
        at = rng.randrange(len(p))
        changed = p[:at] + rng.choice("ACGT") + p[at + 1 :]
        rows.append((i, letters(rng.randrange(0, 20)) + rng.choice([p, changed, changed[3:], ""]) + letters(rng.randrange(0, 20))))
    return rows + [(100, None), (101, ""), (102, "AC")], patterns


def frames(spark, rows, patterns):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "record_id long, s string, id string, start int"), spark.createDataFrame([*patterns, ("empty", ""), ("none", None)], "id string, pattern string")


def places(rows, patterns, most):
    out = set()
    for i, s in rows:
        for name, p in patterns:
            for strand, q in (("+", p), ("-", turned(p))):
                for a in range(len(s or "") - len(q) + 1):
                    n = sum(x != y for x, y in zip(s[a : a + len(q)], q, strict=True))
                    if n <= most:
                        out.add((i, name, strand, a + 1, a + len(q), n))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_patterns_of_all_lengths(spark, seed):
    rows, patterns = make(seed)
    df, pats = frames(spark, rows, patterns)
    got = {tuple(r) for r in scan.find_patterns(df, "record_id", "s", pats).select("record_id", "id", "strand", "start", "end").collect()}
    assert got == {x[:5] for x in places(rows, patterns, 0)}


@pytest.mark.parametrize("most", [1, 2])
def test_near_patterns(spark, most):
    rows, patterns = make(2)
    df, pats = frames(spark, rows, patterns)
    got = [tuple(r) for r in scan.find_near_patterns(df, "record_id", "s", pats, most).select("record_id", "id", "strand", "start", "end", "n_mismatches").collect()]
    assert len(got) == len(set(got)) and set(got) == places(rows, patterns, most)


def partial(rows, patterns, least):
    out = set()
    for i, s in rows:
        for name, p in patterns:
            for strand, t in (("+", s or ""), ("-", turned(s or ""))):
                for k in range(min(len(p) - 1, len(t)), least - 1, -1):
                    side = "5" if t[:k] == p[-k:] else "3" if t[-k:] == p[:k] else None
                    if side:
                        a = 1 if (side == "5") == (strand == "+") else len(t) - k + 1
                        out.add((i, name, strand, side, a, a + k - 1))
                        break
    return out


def test_partial_ends(spark):
    rng = random.Random(7)
    letters = lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    patterns = [(f"p{i}", letters(rng.randrange(8, 20))) for i in range(4)]
    rows = []
    for i in range(40):
        p, k = rng.choice(patterns)[1], rng.randrange(4, 12)
        s = rng.choice([p[-k:] + letters(9), letters(9) + p[:k], p[-k:], letters(12)])
        rows.append((i, rng.choice([s, turned(s)])))
    rows += [(90, None), (91, ""), (92, "ACG")]
    df, pats = frames(spark, rows, patterns)
    got = {tuple(r) for r in scan.find_partial_ends(df, "record_id", "s", pats, 5).select("record_id", "id", "strand", "side", "start", "end").collect()}
    expected = partial(rows, patterns, 5)
    assert got == expected and {x[3] for x in expected} == {"5", "3"}


def test_products_in_bins(spark):
    rng = random.Random(3)
    sites = lambda n: [(rng.randrange(3), a := rng.randrange(1, 3000), a + 5) for _ in range(n)]
    f, r = sites(80), sites(80)
    schema = "record_id long, start long, end long"
    got = sorted(tuple(x) for x in scan.products(spark.createDataFrame(f, schema), spark.createDataFrame(r, schema), 50, 400).select("record_id", "start", "end").collect())
    assert got == sorted((i, a, e) for i, a, b in f for j, c, e in r if i == j and c > b and 50 <= e - a + 1 <= 400)


def test_matches_and_classes(spark):
    a = spark.createDataFrame([(1, "ABCDEFGHIJ"), (2, "abcdefghij"), (3, "ZZZZZZZZZZ"), (4, None), (9, "ABCDEFGHXX")], "key long, sequence string")
    b = spark.createDataFrame([(5, "XABCDEFGHIJ"), (6, "QQQQQQQQQQ")], "key long, sequence string")
    found = scan.reciprocal_best(a, b)
    assert [tuple(r) for r in found.select("key_a", "key_b", "shared").collect()] == [(1, 5, 3)]
    assert {tuple(r) for r in scan.equal_classes(a).select("key", "class_key").collect()} == {(1, 1), (2, 1), (3, 3), (9, 9)}
    pairs = spark.createDataFrame([(1, 5, 3), (9, 5, 1)], "key_a long, key_b long, shared long")
    left = scan.best_unmatched(pairs, found, spark.createDataFrame([(1,), (3,), (9,)], "key_a long"))
    assert {tuple(r) for r in left.collect()} == {(3, None, None), (9, 5, 1)}


@pytest.mark.parametrize("gap", [0, 3])
def test_lanes_against_loops(spark, gap):
    rng = random.Random(gap)
    rows = [(i, rng.choice("xy"), a := rng.randrange(1, 200), a + rng.randrange(0, 15)) for i in range(120)]
    df = spark.createDataFrame([*rows, (500, None, 1, 2), (501, "x", 9, 3), (502, "x", None, 3)], "id long, g string, start long, end long")
    expected = {}
    for g in "xy":
        ends = []
        for a, b, i in sorted((a, b, i) for i, h, a, b in rows if h == g):
            lane = next((k for k, e in enumerate(ends) if e + gap < a), len(ends))
            ends[lane : lane + 1] = [b]
            expected[i] = lane
    assert {r["id"]: r["lane"] for r in genomics.assign_lanes(df, "g", "start", "end", ["id"], gap).collect()} == expected
    assert genomics.assign_lanes(df.where("id < 0"), "g", "start", "end").count() == 0


def test_levels(spark):
    level = lambda edges, **k: {r["node"]: r["level"] for r in plotdata.node_levels(spark.createDataFrame(edges, "source string, target string"), **k).collect()}
    assert level([("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"), (None, "x"), ("a", "b")]) == {"a": 0, "b": 1, "c": 2, "d": 0}
    path = [(str(i), str(i + 1)) for i in range(6)]
    assert level(path, most=6) == {str(i): i for i in range(7)}
    with pytest.raises(ValueError, match="more than 4"):
        level(path, most=4)
    assert level([("a", "b"), ("b", "a"), ("s", "a")]) == {"s": 0, "a": 1, "b": 1}
    assert level([]) == {}


def test_even_spacing(spark):
    df = spark.createDataFrame([(i**3, "r") for i in range(101)], "v long, place string")
    got = sorted(r["v"] for r in plotdata.evenly_spaced(df, "v", 8).collect())
    assert got == [int(i * 100 / 7 + 0.5) ** 3 for i in range(8)]
    assert plotdata.evenly_spaced(df, "v", 500).count() == 101 and plotdata.evenly_spaced(df, "v", 1).count() == 1 and plotdata.evenly_spaced(df.where("v < 0"), "v", 5).count() == 0


def test_point_tables(spark):
    df = spark.createDataFrame([("b", "2", "1"), ("a", "1", "3"), ("a", "x", "3"), (None, "0", "5"), (" ", "7", "1")], "g string, x string, y string")
    assert [tuple(r) for r in plotdata.line_points(df, "x", "y", "g").collect()] == [("", 0.0, 5.0), (" ", 7.0, 1.0), ("a", 1.0, 3.0), ("b", 2.0, 1.0)]
    assert plotdata.scatter_points(df, "x", "y").count() == 4
    assert sorted((r["category"], r["value"]) for r in plotdata.bar_values(df, "g", "x").collect()) == [("a", 1.0), ("b", 2.0)]
    with pytest.raises(ValueError, match="cells"):
        plotdata.heatmap(spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("v")), "a", "b", "v")
