"""Continuous periods and gaps of overlapping intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.grouping import running_totals
from strandloom.session import written


def valid_intervals(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Rows with a usable key and ``1 <= start <= end``, as (keys, seg_start, seg_end).

    String keys lose white space at both ends; a null or then empty key leaves the row out.
    """
    kinds = dict(df.dtypes)
    clean = [F.regexp_replace(F.col(k), r"(?U)^\s+|\s+$", "").alias(k) if kinds[k] == "string" else F.col(k) for k in keys]
    out = df.select(*clean, F.col(start).cast("long").alias("seg_start"), F.col(end).cast("long").alias("seg_end"))
    ok = (F.col("seg_start") >= 1) & (F.col("seg_end") >= F.col("seg_start"))
    for k in keys:
        ok &= F.col(k).isNotNull() & ((F.col(k) != "") if kinds[k] == "string" else F.lit(True))
    return out.where(ok)


def periods_and_gaps(intervals: DataFrame, keys: Sequence[str], start: str = "seg_start", end: str = "seg_end") -> DataFrame:
    """Merges each entity's intervals into periods and lists the gaps between them.

    Starts and ends are ranked independently per entity; a gap lies behind rank i
    where the start of rank i + 1 lies more than one position behind the end of
    rank i. Equal positions are first counted, so ranks are running counts over
    distinct positions, and only the last end of a value and the first start of
    a value can bound a gap. Both meet in an equi-join on (entity, rank), which
    spreads a hot entity over all tasks.

    Returns keys, ``kind`` (period or gap), ``seg_start``, ``seg_end``. Intervals
    are closed and whole-numbered; touching ones are continuous. No valid
    interval gives no rows; repeated rows change nothing. The counted positions, the possible boundaries and the boundaries are
    each written to the shared folder once, since three and more later steps read them. Input rows must have
    non-null bounds with start <= end (see ``valid_intervals``).
    """
    keys = list(keys)
    events = (
        intervals.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("opens")), F.struct(F.col(end).alias("pos"), F.lit(0).alias("opens")))).alias("e"))
        .groupBy(*keys, F.col("e.pos").alias("pos"))
        .agg(F.sum("e.opens").cast("long").alias("starts"), F.sum(1 - F.col("e.opens")).cast("long").alias("ends"))
    )
    events = written(events)  # running totals read them once per level
    # an opening needs as many ends as starts before it, a closing as many up to it; no other position can bound a gap
    ranked = running_totals(events, keys, "pos", ["starts", "ends"]).withColumns(
        {"opens": F.expr("starts > 0 AND starts_upto - starts = ends_upto - ends"), "closes": F.expr("ends > 0 AND starts_upto = ends_upto")}
    )
    ranked = written(ranked.where("opens OR closes").drop("ends"))
    opening = ranked.where("opens").select(*keys, (F.col("starts_upto") - F.col("starts")).alias("rank"), F.col("pos").alias("opens_at"))
    closing = ranked.where("closes").select(*keys, F.col("ends_upto").alias("rank"), F.col("pos").alias("closes_at"))
    # only the first start and the last end stay without a partner
    bounds = closing.join(opening, [*keys, "rank"], "full").where("opens_at IS NULL OR closes_at IS NULL OR opens_at > closes_at + 1").withColumn("one", F.lit(1).cast("long"))
    bounds = written(bounds)
    gaps = bounds.where("opens_at IS NOT NULL AND closes_at IS NOT NULL").select(*keys, F.lit("gap").alias("kind"), (F.col("closes_at") + 1).alias("seg_start"), (F.col("opens_at") - 1).alias("seg_end"))
    numbered = running_totals(bounds.select(*keys, "rank", "opens_at", "closes_at", "one"), keys, "rank", ["one"])
    # boundary m closes period m - 1 and opens period m
    sides = F.array(F.struct((F.col("one_upto") - 1).alias("no"), F.lit(None).cast("long").alias("a"), F.col("closes_at").alias("b")), F.struct(F.col("one_upto").alias("no"), F.col("opens_at").alias("a"), F.lit(None).cast("long").alias("b")))
    periods = (
        numbered.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, F.col("s.no").alias("no"))
        .agg(F.max("s.a").alias("seg_start"), F.max("s.b").alias("seg_end"))
        .where("seg_start IS NOT NULL AND seg_end IS NOT NULL")
        .select(*keys, F.lit("period").alias("kind"), "seg_start", "seg_end")
    )
    return periods.unionByName(gaps)
