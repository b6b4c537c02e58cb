import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.functions import special
from strandloom.operators import grouping, profile, stats, tables
from strandloom.session import clear_written, shared_dir, written


def test_ordered_totals(spark):
    rng = random.Random(0)
    values = sorted(rng.choice([rng.random(), 1e9 + rng.random() * 1e-3, -5.0 - rng.random()]) for _ in range(500))
    rows = [("b", v, i % 3) for i, v in enumerate(values)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, x double, n long")
    got = sorted((r["x"], r["n_upto"]) for r in grouping.ordered_totals(df, ["x"], ["n"]).collect())
    upto, expected = 0, []
    for _, v, n in rows:
        upto += n
        expected.append((v, upto))
    assert got == expected
    assert grouping.ordered_totals(df.where("n < 0"), ["x"], ["n"]).count() == 0


def test_kendall_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(float(rng.randrange(12)), float(rng.randrange(9))) for _ in range(150)] + [(None, 1.0)]
    got = profile.kendall(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    c = d = 0
    for i, (a, b) in enumerate(rows[:-1]):
        for x, y in rows[: i]:
            s = (a - x) * (b - y)
            c, d = c + (s > 0), d + (s < 0)
    assert (got["n"], got["n_concordant"], got["n_discordant"]) == (150, c, d)
    assert profile.kendall(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), "a", "b").first()["tau_b"] is None


def test_spearman_of_narrow_values(spark):
    rows = [(1.7e15 + i, float(-i * i)) for i in range(300)]
    got = profile.spearman(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    assert (got["n"], got["spearman"]) == (300, -1.0)
    assert profile.spearman(spark.createDataFrame([], "a double, b double"), "a", "b").first()["n"] == 0


def test_ranks_in_groups(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 1.0), ("x", 3.0), ("y", 9.0), ("y", 2.0)], "g string, v double")
    got = Counter((r["g"], r["v"], r["r"]) for r in profile.average_ranks(df, ["g"], "v", "r").collect())
    assert got == Counter([("x", 1.0, 1.5), ("x", 1.0, 1.5), ("x", 3.0, 3.0), ("y", 2.0, 1.0), ("y", 9.0, 2.0)])


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_group_quantiles_either_way(spark, monkeypatch, held):
    monkeypatch.setattr(profile, "MOST_HELD", held)
    rng = random.Random(5)
    rows = [(rng.choice("ab"), float(rng.randrange(30)), rng.randrange(1, 4)) for _ in range(120)] + [("one", 2.5, 1), (None, 1.0, 1)]
    cells = Counter()
    for g, x, c in rows:
        cells[g, x] += c
    counts = spark.createDataFrame([(*k, c) for k, c in cells.items()], "g string, x double, c long")
    got = {r["g"]: (r["q1"], r["q3"]) for r in profile.group_quantiles(counts, ["g"], {"q1": 0.25, "q3": 0.75}).collect()}

    def quantile(g, p):
        values = sorted(x for (h, x), c in cells.items() if h == g for _ in range(c))
        place = (len(values) - 1) * p
        low = int(place)
        return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (place - low)

    assert got == {g: (pytest.approx(quantile(g, 0.25)), pytest.approx(quantile(g, 0.75))) for g in ("a", "b", "one")}


def test_confidence_interval(spark):
    df = spark.createDataFrame([(float(v), "1") for v in (1, 2, 3, 4, 10)], "x double, column string")
    r = profile.describe(df, ["x"]).first()
    # t for 95 % and 4 degrees of freedom is 2.776445
    half = 2.776445 * math.sqrt(12.5) / math.sqrt(5)
    assert (r["ci_low"], r["ci_high"]) == (pytest.approx(4 - half, abs=1e-3), pytest.approx(4 + half, abs=1e-3))
    assert (r["q1"], r["median"], r["q3"], r["trimmed_mean"]) == (2.0, 3.0, 4.0, 4.0)
    assert math.isclose(special.t_quantile(0.95, 10), 2.228138852, abs_tol=1e-7)


def test_small_p_stays(spark):
    rows = [("a", float(i % 7)) for i in range(200)] + [("b", 100.0 + i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, x double")
    assert 0 < stats.mann_whitney(df, "g", "x", "a", "b").first()["p"] < 1e-50
    assert 0 < stats.kruskal_wallis(df, "g", "x").first()["p"] < 1e-50
    r = stats.kruskal_wallis(df.unionByName(spark.createDataFrame([("c", 3.0), ("c", 104.0)], "g string, x double")), "g", "x").first()
    assert r["p"] == pytest.approx(math.exp(-r["h"] / 2), rel=1e-3)


def test_group_summary_counts_cells(spark):
    df = spark.createDataFrame([(None, "1"), (None, "NA"), ("a", "2"), ("a", "2"), ("a", "x"), ("a", "4")], "g string, v string")
    got = {r["g"]: r for r in tables.summarize_groups(df, ["g"], ["v"]).collect()}
    assert (got["a"]["row_count"], got["a"]["v_count"], got["a"]["v_distinct"], got["a"]["v_median"], got["a"]["v_sum"]) == (4, 4, 3, 2.0, 8.0)
    assert (got[None]["row_count"], got[None]["v_count"], got[None]["v_distinct"], got[None]["v_sd"]) == (2, 1, 1, None)
    whole = tables.summarize_groups(df, [], ["v"], ["median", "distinct"]).first()
    assert (whole["row_count"], whole["v_median"], whole["v_distinct"]) == (6, 2.0, 4)


def test_hot_group_keeps_its_figures(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    got = grouping.with_group_figures(df, ["k"], F.pmod(F.xxhash64("id"), F.lit(8)), {"part": F.count("*"), "low": F.min("id")}, {"n": F.sum("part"), "first": F.min("low")})
    rows = got.collect()
    assert len(rows) == 3000 and {(r["n"], r["first"]) for r in rows if r["k"] == "hot"} == {(1000, 0)}


def test_written_tables_can_be_deleted(spark):
    clear_written(spark)
    assert written(spark.range(3)).count() == 3 and clear_written(spark) == 1 and clear_written(spark) == 0


def test_cluster_without_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
