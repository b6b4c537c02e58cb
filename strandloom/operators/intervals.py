"""Operations on closed, 1-based genomic intervals: (record, start, end)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.grouping import running_totals
from strandloom.operators.periods import periods_and_gaps
from strandloom.session import written

#: Positions per bin of the range joins.
BIN = 4096


def overlap_bp(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared positions of two intervals on one record."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def distance_bp(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """0 on overlap, else the steps between the nearest ends (1 when they touch)."""
    return F.greatest(F.lit(0), s2 - e1, s1 - e2)


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def intersect(query: DataFrame, reference: DataFrame, min_bp: int = 1, fraction: float = 0.0, width: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals with ``overlap_bp``.

    Both sides have record, start, end; further columns are kept, those of the
    reference prefixed ``ref_``. A pair needs ``min_bp`` shared positions and
    ``fraction`` of each interval. Intervals meet per (record, bin) and count only
    in the bin of their common start, so a record is spread over its bins; each
    interval is copied once per bin it touches.
    """
    ref = reference.select(*(F.col(c).alias(f"ref_{c}") for c in reference.columns))
    q, r = _binned(query, "start", "end", width), _binned(ref, "ref_start", "ref_end", width).withColumnRenamed("_bin", "_ref_bin")
    shared = overlap_bp(F.col("start"), F.col("end"), F.col("ref_start"), F.col("ref_end"))
    first = F.floor(F.greatest("start", "ref_start") / width)
    pairs = q.join(r, (F.col("record") == F.col("ref_record")) & (F.col("_bin") == F.col("_ref_bin")) & (F.col("start") <= F.col("ref_end")) & (F.col("ref_start") <= F.col("end")))
    enough = (F.col("overlap_bp") >= min_bp) & (F.col("overlap_bp") >= fraction * (F.col("end") - F.col("start") + 1)) & (F.col("overlap_bp") >= fraction * (F.col("ref_end") - F.col("ref_start") + 1))
    return pairs.where(F.col("_bin") == first).withColumn("overlap_bp", shared).where(enough).drop("_bin", "_ref_bin")


def nearest(query: DataFrame, reference: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Distance of every query interval to the nearest reference on its record: ids, ``distance``; null without any.

    0 on overlap; else from the last reference end before and the first start
    behind. Both come from running extremes over the record's distinct positions, taken in
    tiles of positions and over the tiles, so a record of any size is spread.
    """
    hit = intersect(query.select("record", "start", "end", *ids), reference.select("record", "start", "end")).select(*ids).distinct()
    return _distances(query, reference, ids, hit)


def nearest_other(df: DataFrame, id_col: str) -> DataFrame:
    """Distance of every interval to the nearest one with another id on its record: id, ``distance``; null without any."""
    rows = df.select("record", "start", "end", id_col)
    hit = intersect(rows, rows).where(F.col(id_col) != F.col(f"ref_{id_col}")).select(id_col).distinct()
    return _distances(rows, rows, [id_col], hit)


def _distances(query: DataFrame, reference: DataFrame, ids: Sequence[str], hit: DataFrame) -> DataFrame:
    """ids, ``distance``: 0 for the ids in ``hit``, else to the last end before the start and the first start behind the end, so never to the interval itself."""
    kinds = F.array(F.struct(F.col("end").alias("pos"), F.col("end").alias("e"), F.lit(None).cast("long").alias("s")), F.struct(F.col("start").alias("pos"), F.lit(None).cast("long").alias("e"), F.col("start").alias("s")))
    refs = reference.select("record", F.explode(kinds).alias("k")).select("record", "k.pos", "k.e", "k.s")
    places = query.select("record", F.explode(F.array(F.col("start") - 1, F.col("end") + 1)).alias("pos"), F.lit(None).cast("long").alias("e"), F.lit(None).cast("long").alias("s"))
    points = refs.unionByName(places).groupBy("record", "pos").agg(F.max("e").alias("e"), F.min("s").alias("s")).withColumn("tile", F.shiftright("pos", 16))
    tiles = points.groupBy("record", "tile").agg(F.max("e").alias("e"), F.min("s").alias("s"))
    # backward, not over following rows, which Spark would add up anew for every row
    over, back = (Window.partitionBy("record").orderBy(o) for o in (F.asc("tile"), F.desc("tile")))
    tiles = tiles.select("record", "tile", F.max("e").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("e_before"), F.min("s").over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("s_behind"))
    inside, inside_back = (Window.partitionBy("record", "tile").orderBy(o) for o in (F.asc("pos"), F.desc("pos")))
    local = points.select("record", "tile", "pos", F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("e_in"), F.min("s").over(inside_back.rowsBetween(Window.unboundedPreceding, 0)).alias("s_in"))
    known = local.join(tiles, ["record", "tile"]).select("record", "pos", F.coalesce("e_in", "e_before").alias("last_end"), F.coalesce("s_in", "s_behind").alias("first_start"))
    at_start = known.select("record", (F.col("pos") + 1).alias("start"), "last_end")
    at_end = known.select("record", (F.col("pos") - 1).alias("end"), "first_start")
    joined = query.select("record", "start", "end", *ids).join(at_start, ["record", "start"], "left").join(at_end, ["record", "end"], "left").join(hit.withColumn("_hit", F.lit(True)), list(ids), "left")
    gap = F.least(F.col("start") - F.col("last_end"), F.col("first_start") - F.col("end"))
    return joined.select(*ids, F.when(F.col("_hit"), F.lit(0).cast("long")).otherwise(gap).alias("distance"))


def merge(df: DataFrame, keys: Sequence[str] = ("record",), gap: int = 0) -> DataFrame:
    """Covered periods per key; stretches with at most ``gap`` uncovered positions between them join."""
    wide = df.select(*keys, F.col("start").alias("seg_start"), (F.col("end") + gap).alias("seg_end"))
    return periods_and_gaps(wide, keys).where("kind = 'period'").select(*keys, F.col("seg_start").alias("start"), (F.col("seg_end") - gap).alias("end"))


def subtract(query: DataFrame, reference: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The parts of each query interval that no reference covers: ids, record, start, end.

    These are its overlaps with the holes that the references leave in the range of
    the record's queries, so nothing is collected per interval.
    """
    ends = query.groupBy("record").agg((F.min("start") - 1).alias("a"), (F.max("end") + 1).alias("b"))
    marks = ends.select("record", F.explode(F.array("a", "b")).alias("seg_start")).withColumn("seg_end", F.col("seg_start"))
    covered = reference.select("record", F.col("start").alias("seg_start"), F.col("end").alias("seg_end")).unionByName(marks)
    holes = periods_and_gaps(covered, ["record"]).where("kind = 'gap'").select("record", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
    parts = intersect(query.select("record", "start", "end", *ids), holes)
    return parts.select(*ids, "record", F.greatest("start", "ref_start").alias("start"), F.least("end", "ref_end").alias("end"))


def subtract_others(df: DataFrame, id_col: str) -> DataFrame:
    """The parts of each interval that no interval with another id covers: id, record, start, end.

    These are its overlaps with the runs of depth 1, each of which lies in one interval.
    """
    rows = df.select("record", "start", "end", id_col)
    parts = intersect(rows, depth(rows, ["record"]).where("depth = 1").select("record", "start", "end"))
    return parts.select(id_col, "record", F.greatest("start", "ref_start").alias("start"), F.least("end", "ref_end").alias("end"))


def depth(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Runs of equal depth above 0: keys, start, end, depth. A sweep over +1/-1 events counted per position."""
    events = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).cast("long").alias("d")), F.struct((F.col(end) + 1).alias("pos"), F.lit(-1).cast("long").alias("d")))).alias("v")).groupBy(*keys, F.col("v.pos").alias("pos")).agg(F.sum("v.d").alias("d"))
    swept = running_totals(written(events), keys, "pos", ["d"])  # read once per level, and twice below
    # the next event: inside the tile, else the first of the next tile that has any
    tile = F.shiftright("pos", 20)
    tiles = swept.groupBy(*keys, tile.alias("tile")).agg(F.min("pos").alias("first"))
    tiles = tiles.select(*keys, "tile", F.lead("first").over(Window.partitionBy(*keys).orderBy("tile")).alias("after"))
    inside = swept.withColumn("tile", tile).withColumn("next", F.lead("pos").over(Window.partitionBy(*keys, "tile").orderBy("pos")))
    return inside.join(tiles, [*keys, "tile"]).where("d_upto > 0").select(*keys, F.col("pos").alias("start"), (F.coalesce("next", "after") - 1).alias("end"), F.col("d_upto").alias("depth"))


def depth_summary(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Covered positions, total, mean (over covered positions) and largest depth."""
    length = F.col("end") - F.col("start") + 1
    total = F.sum(F.col("depth") * length)
    return runs.groupBy(*keys).agg(F.sum(length).alias("covered"), total.alias("total_depth"), F.round(total / F.sum(length), 6).alias("mean_depth"), F.max("depth").alias("max_depth"))


def complement(df: DataFrame, lengths: DataFrame) -> DataFrame:
    """The positions from 1 to ``length`` that no interval of the record covers: record, start, end. ``lengths`` has (record, length); null lengths drop out.

    Gaps between periods, and the stretches before the first and behind the last one.
    """
    spans = lengths.where("length IS NOT NULL").select("record", "length")
    edges = spans.select("record", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e")), F.struct((F.col("length") + 1).alias("s"), (F.col("length") + 1).alias("e")))).alias("x"))
    all_ = df.select("record", F.col("start").alias("seg_start"), F.col("end").alias("seg_end")).unionByName(edges.select("record", F.col("x.s").alias("seg_start"), F.col("x.e").alias("seg_end")))
    holes = periods_and_gaps(all_, ["record"]).where("kind = 'gap'").join(spans, "record")
    return holes.where("seg_start >= 1 AND seg_end <= length").select("record", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
