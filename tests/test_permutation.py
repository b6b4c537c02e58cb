import random
from itertools import combinations

from strandloom.operators import stats

SCHEMA = "id long, g string, x double"


def result(spark, rows, **more):
    return stats.permutation_test(spark.createDataFrame(rows, SCHEMA), "g", "x", "a", "b", ["id"], **more).collect()[0]


def test_small_tables_are_enumerated(spark):
    xs = [1.0, 2.0, 4.0, 8.0, 9.0, 11.0, 15.0]
    got = result(spark, [(i, "a" if i < 3 else "b", x) for i, x in enumerate(xs)])
    d = lambda c: abs(sum(xs[i] for i in c) / 3 - sum(x for i, x in enumerate(xs) if i not in c) / 4)
    nulls = [d(c) for c in combinations(range(7), 3)]
    extreme = sum(v >= d((0, 1, 2)) - 1e-12 for v in nulls)
    assert (got["draws"], got["extreme"], got["p"]) == (35, extreme, round(extreme / 35, 6))
    assert result(spark, [(i, "a" if i < 4 else "b", x) for i, x in enumerate(xs)])["draws"] == 35


def test_draws_keep_the_group_sizes(spark):
    # only the sizes of the groups matter when a single row differs: it is in group a in n_a / n of the arrangements
    rows = [(i, "a" if i < 3000 else "b", 1.0 if i == 0 else 0.0) for i in range(12000)]
    got = result(spark, rows)
    assert got["draws"] == 5000
    assert abs(got["extreme"] / 5000 - 0.25) < 0.03


def test_small_p(spark):
    rng = random.Random(2)
    got = result(spark, [(i, "ab"[i % 2], rng.gauss(i % 2, 1)) for i in range(400)])
    assert got["extreme"] == 0 and got["p"] < 0.001
