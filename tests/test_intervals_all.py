import random

from strandloom.operators import intervals
from strandloom.plans.genome_queries import registry


def fixture(spark, folder):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        start = rng.randrange(1, 4000)
        rows.append((i, rng.choice(["a", " a", "b"]), start, start + rng.choice([0, 0, 5, 30, 200]), rng.choice(["subtract", "merge", "intersect", "nearest"])))
    rows += [(500, "b", 9000, 9000, "nearest"), (501, "b", 9001, 9003, "intersect"), (502, "alone", 7, 9, "merge"), (503, None, 1, 2, "merge"), (504, "a", 5, 4, "merge"), (505, "b", 9500, 9510, "merge"), (506, "b", 9500, 9510, "merge")]
    spark.createDataFrame(rows, "interval_id long, record string, start long, end long, operation string").write.parquet(f"{folder}/genomic_intervals.parquet")
    return [(i, r.strip(), s, e) for i, r, s, e, _ in rows if r and s <= e]


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_all_rows_against_loops(spark, tmp_path):
    rows = fixture(spark, tmp_path)
    got = {n: values(registry.queries[f"interval_{n}_all"](spark, str(tmp_path))) for n in ("intersect", "reciprocal", "nearest", "subtract", "merge")}
    shared = lambda x, y: min(x[3], y[3]) - max(x[2], y[2]) + 1
    size = lambda x: x[3] - x[2] + 1
    pairs = [(x, y) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and shared(x, y) > 0]
    assert got["intersect"] == sorted((x[0], y[0], shared(x, y)) for x, y in pairs if shared(x, y) >= 10)
    assert got["reciprocal"] == sorted((x[0], y[0]) for x, y in pairs if 2 * shared(x, y) >= max(size(x), size(y)))
    apart = lambda x: [max(0, y[2] - x[3], x[2] - y[3]) for y in rows if y[0] != x[0] and y[1] == x[1]]
    assert dict(got["nearest"]) == {x[0]: min(apart(x), default=None) for x in rows}
    free, periods = set(), {}
    for x in rows:
        alone = set(range(x[2], x[3] + 1)) - {p for y in rows if y[0] != x[0] and y[1] == x[1] for p in range(y[2], y[3] + 1)}
        free |= {(x[0], x[1], p) for p in alone}
    assert {(i, r, p) for i, r, s, e in got["subtract"] for p in range(s, e + 1)} == free
    assert len(got["subtract"]) == sum((i, r, p - 1) not in free for i, r, p in free)
    for _, r, s, e in sorted(rows, key=lambda x: x[2]):
        last = periods.setdefault(r, [])
        if last and s <= last[-1][1] + 101:
            last[-1][1] = max(last[-1][1], e)
        else:
            last.append([s, e])
    assert got["merge"] == sorted((r, s, e) for r, ps in periods.items() for s, e in ps)


def test_nearest_of_one_position(spark):
    rows = spark.createDataFrame([(1, "a", 5, 5), (2, "a", 9, 12)], "interval_id long, record string, start long, end long")
    assert values(intervals.nearest_other(rows, "interval_id")) == [(1, 4), (2, 4)]
