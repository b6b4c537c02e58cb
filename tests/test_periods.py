import random

import pytest

from strandloom.operators.grouping import running_totals, spread_join
from strandloom.operators.periods import periods_and_gaps, valid_intervals
from pyspark.sql import functions as F

SCHEMA = "id long, source_set string, record string, start long, end long, pos long, rank long"


def brute(rows):
    out = set()
    by = {}
    for _, s, r, a, b, *_ in rows:
        if s is not None and r is not None and r.strip() and a is not None and b is not None and 1 <= a <= b:
            by.setdefault((s, r.strip()), []).append((a, b))
    for key, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(*key, "period", a, b) for a, b in merged}
        out |= {(*key, "gap", x[1] + 1, y[0] - 1) for x, y in zip(merged, merged[1:])}
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA)
    keys = ["source_set", "record"]
    return {(r["source_set"], r["record"], r["kind"], r["seg_start"], r["seg_end"]) for r in periods_and_gaps(valid_intervals(df, keys), keys).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_intervals(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "b", None]), rng.choice(["x", " x", "y ", "", None, "z"]), a := rng.choice([None, rng.randrange(-5, 200)]), None if a is None else a + rng.randrange(-2, 12)) for i in range(300)]
    assert found(spark, rows) == brute(rows)


def test_touching_nested_repeated_and_huge(spark):
    big = 1 << 61
    rows = [(1, "s", "r", 5, 9), (2, "s", "r", 10, 12), (3, "s", "r", 10, 12), (4, "s", "r", 6, 7), (5, "s", "r", 14, 14), (6, "s", "r", big, big + 5), (7, "s", "r", 2_000_000, 9_000_000)]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == set()


def test_running_totals_over_many_tiles(spark):
    rng = random.Random(5)
    rows = [(k, p, rng.randrange(10)) for k in "ab" for p in rng.sample(range(5000), 700)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    got = {(r["k"], r["p"]): r["v_upto"] for r in running_totals(df, ["k"], "p", ["v"], tile_bits=4).collect()}
    assert got == {(k, p): sum(v2 for k2, p2, v2 in rows if k2 == k and p2 <= p) for k, p, _ in rows}


def test_spread_join_keeps_every_row_of_a_hot_key(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 0), (None, 1)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k long, w string")
    out = spread_join(left, right, ["k"], F.pmod("v", F.lit(8)))
    assert out.count() == 1000
