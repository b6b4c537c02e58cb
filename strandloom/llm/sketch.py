"""Mergeable percentile sketches over signed logarithmic buckets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of every value read from a sketch.
RELATIVE_ERROR = 0.01


def bucket(value: Column, error: float) -> Column:
    """The signed logarithmic bucket of a value: sign(v) * (k + OFFSET) with gamma**(k-1) < |v| <= gamma**k, 0 for zero.

    k is taken from a logarithm rounded to 9 places, so that powers of gamma fall into
    their own bucket on every machine; this lets the error pass ``error`` by some 1e-11 of the value.
    """
    gamma = (1 + error) / (1 - error)
    k = F.ceil(F.round(F.ln(F.abs(value)) / F.lit(math.log(gamma)), 9)).cast("long") + F.lit(offset(error))
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, k).otherwise(-k)


def offset(error: float) -> int:
    """Shift that makes the bucket of the smallest positive double 1 or more."""
    return math.ceil(745 / math.log((1 + error) / (1 - error))) + 1


def bucket_value(index: Column, error: float) -> Column:
    """The value with the smallest relative distance to all of a bucket: 2 gamma**k / (gamma + 1)."""
    gamma = (1 + error) / (1 - error)
    k = F.abs(index) - F.lit(offset(error))
    return F.when(index == 0, F.lit(0.0)).otherwise(F.signum(index.cast("double")) * F.lit(2 / (gamma + 1)) * F.exp(k * F.lit(math.log(gamma))))


def sketch(df: DataFrame, groups: Sequence[str], value: str, error: float = RELATIVE_ERROR) -> DataFrame:
    """Counts per group and bucket: groups, ``bucket``, ``n``.

    Null, NaN and infinite values are left out. The buckets of a group are bounded
    by the range of doubles and ``error``, whatever the number of rows; counting
    starts before the shuffle. Null group values form a group of their own.
    """
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return df.where(ok).groupBy(*groups, bucket(v, error).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Adds the matching buckets of sketches of the same error into coarser or equal groups."""
    return sketches.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, groups: Sequence[str], probabilities: Sequence[float], error: float = RELATIVE_ERROR) -> DataFrame:
    """Percentiles of each group: groups, ``p``, ``n`` (values), ``estimate``, ``low``, ``high``.

    The estimate interpolates between the values of ranks floor and ceil of
    p * (n - 1), as exact percentiles of type 7 do. Each of the two is within
    ``error`` of its true value; the exact percentile lies in [low, high], and where
    both values have one sign, within ``error`` of the estimate.
    """
    order = Window.partitionBy(*groups).orderBy("bucket")
    everything = Window.partitionBy(*groups)
    counted = sketches.withColumns({"upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(everything)})
    asked = counted.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in probabilities)))).withColumn("rank", F.col("p") * (F.col("total") - 1))
    # values of ranks upto - n ... upto - 1 lie in the bucket
    lo, hi = F.floor("rank"), F.ceil("rank")
    has = lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n"))
    value = bucket_value(F.col("bucket"), error)
    ends = asked.where(has(lo) | has(hi)).groupBy(*groups, "p").agg(
        F.max("total").alias("n"),
        F.max("rank").alias("rank"),
        F.max(F.when(has(lo), value)).alias("below"),
        F.max(F.when(has(hi), value)).alias("above"),
    )
    share = F.col("rank") - F.floor("rank")
    at = lambda x, y: x + (y - x) * share
    down = lambda c: F.when(F.col(c) >= 0, F.col(c) / (1 + error)).otherwise(F.col(c) / (1 - error))
    up = lambda c: F.when(F.col(c) >= 0, F.col(c) / (1 - error)).otherwise(F.col(c) / (1 + error))
    return ends.select(*groups, "p", "n", at(F.col("below"), F.col("above")).alias("estimate"), at(down("below"), down("above")).alias("low"), at(up("below"), up("above")).alias("high"))
