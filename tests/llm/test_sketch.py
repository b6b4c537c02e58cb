import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import sketch


def test_error_bound_and_merging(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(5), rng.choice([0.0, 255.0, rng.lognormvariate(0, 3), -rng.lognormvariate(0, 3), 1e300, -1e-300, 5e-324])) for _ in range(3000)]
    df = spark.createDataFrame([(g, d, v, 1, 2) for g, d, v in rows], "g string, day int, v double, bucket int, n int")
    ps = [0.0, 0.01, 0.3, 0.5, 0.9, 1.0]
    whole = sketch.percentiles(sketch.sketch(df, ["g"], "v"), ["g"], ps)
    merged = sketch.percentiles(sketch.merge(sketch.sketch(df, ["g", "day"], "v"), ["g"]), ["g"], ps)
    key = lambda r: (r["g"], r["p"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))
    for r in sorted(whole.collect(), key=key):
        values = sorted(v for g, _, v in rows if g == r["g"])
        rank = r["p"] * (len(values) - 1)
        lo, hi = values[math.floor(rank)], values[math.ceil(rank)]
        exact = lo + (hi - lo) * (rank - math.floor(rank))
        assert r["n"] == len(values)
        assert r["low"] - 1e-9 * abs(exact) <= exact <= r["high"] + 1e-9 * abs(exact) or abs(exact) < 1e-300
        if lo * hi >= 0 and abs(exact) > 1e-290:
            assert abs(r["estimate"] - exact) <= 0.01 * abs(exact) * (1 + 1e-6)


def test_nulls_nan_infinity_ties_empty(spark):
    df = spark.createDataFrame([(None, 7.0)] * 5 + [(None, None), (None, float("nan")), (None, float("inf")), (None, -float("inf"))], "g string, v double")
    r = sketch.percentiles(sketch.sketch(df, ["g"], "v"), ["g"], [0.5]).collect()
    assert len(r) == 1 and r[0]["g"] is None and r[0]["n"] == 5 and r[0]["estimate"] == pytest.approx(7, rel=0.01)
    assert sketch.percentiles(sketch.sketch(df.where("false"), ["g"], "v"), ["g"], [0.5]).count() == 0


def test_sketch_is_bounded(spark):
    df = spark.range(200_000).select(F.lit("a").alias("g"), (F.rand(1) * 1e6).alias("v"))
    assert sketch.sketch(df, ["g"], "v").count() < 2500
    assert np.isclose(sketch.percentiles(sketch.sketch(df, ["g"], "v"), ["g"], [0.5]).first()["estimate"], 5e5, rtol=0.03)
