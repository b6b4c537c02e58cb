"""Group-wide figures for large and skewed groups, without moving a group into one task."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Positions per tile of ``running_totals``, as a power of two.
TILE_BITS = 20


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    values: Sequence[str],
    tile_bits: int = TILE_BITS,
    levels: int = 2,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Running totals by ``position`` within ``keys``, exact for groups of any size.

    ``df`` should hold each (keys, position) once, or nearly so, so that a tile of
    ``2**tile_bits`` positions holds a bounded number of rows; ``ties`` orders rows
    of one position. Totals run inside each tile; the
    totals of whole tiles run one level up in the same way, and are added. Adds
    ``<value>_upto`` (inclusive) and keeps every row and column. Null positions
    are not allowed; values must be long.
    """
    tile = f"{position}_tile"
    tiled = df.withColumn(tile, F.shiftright(F.col(position), tile_bits)) if levels else df
    inside = Window.partitionBy(*keys, *([tile] if levels else [])).orderBy(position, *ties).rowsBetween(Window.unboundedPreceding, 0)
    local = tiled.withColumns({f"{v}_upto": F.sum(v).over(inside) for v in values})
    if not levels:
        return local
    tiles = df.groupBy(*keys, F.shiftright(F.col(position), tile_bits).alias(tile)).agg(*(F.sum(v).alias(v) for v in values))
    above = running_totals(tiles, keys, tile, values, tile_bits, levels - 1)
    before = above.select(*keys, tile, *((F.col(f"{v}_upto") - F.col(v)).alias(f"{v}_before") for v in values))
    joined = local.join(before, [*keys, tile])
    return joined.select(*df.columns, *((F.col(f"{v}_upto") + F.col(f"{v}_before")).alias(f"{v}_upto") for v in values))


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salt: Column) -> DataFrame:
    """Inner equi-join in which a hot key of ``left`` is spread over its salts.

    ``right`` goes first to the (keys, salt) pairs that ``left`` has, at most one
    per salt and key, and from there to the rows. Null keys match nothing.
    """
    salted = left.withColumn("_salt", salt)
    pairs = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_rows")).drop("_rows")
    return salted.join(pairs.join(right, list(keys)), [*keys, "_salt"]).drop("_salt")


def with_group_figures(df: DataFrame, keys: Sequence[str], salt: Column, partial: dict[str, Column], total: dict[str, Column]) -> DataFrame:
    """Joins group-wide aggregates to every row, a hot group being spread over its salts.

    ``partial`` aggregates per (keys, salt), ``total`` combines those columns per
    key, over the at most one row per salt that a group then has. The totals go
    from the (keys, salt) pairs to the rows, so no task receives more than a
    salt's part of a group. Rows whose key is null are dropped. ``df`` is read
    twice, for the aggregates and for the rows: pass a written table if it is costly.
    """
    salted = df.withColumn("_salt", salt)
    parts = salted.groupBy(*keys, "_salt").agg(*(c.alias(n) for n, c in partial.items()))
    salts = Window.partitionBy(*keys)
    spread = parts.select(*keys, "_salt", *(c.over(salts).alias(n) for n, c in total.items()))
    return salted.join(spread, [*keys, "_salt"]).drop("_salt")


def ordered_totals(df: DataFrame, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Running totals of long columns over the whole table in the order of ``order``: adds ``<value>_upto`` (inclusive).

    Rows are sorted by range partitions, whose bounds Spark takes from a sample of the
    data, so any distribution of values spreads evenly; each partition adds up its own
    rows and the totals of the partitions, one row each, are added after that. Rows that
    are equal in ``order`` share a partition and come in any order: let there be few. The
    sorted rows are written once. Values must not be null.
    """
    names = [f.name for f in df.schema.fields]
    at = [names.index(v) for v in values]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), [0] * len(at)
        for batch in batches:
            sums = []
            for k, i in enumerate(at):
                upto = np.cumsum(batch.column(i).to_numpy(zero_copy_only=False)) + so_far[k]
                so_far[k] = int(upto[-1]) if len(upto) else so_far[k]
                sums.append(pa.array(upto, pa.int64()))
            parts = pa.array(np.full(batch.num_rows, part, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums, parts], names=[*names, *(f"_upto{k}" for k in range(len(at))), "_part"])

    schema = T.StructType([*df.schema.fields, *(T.StructField(f"_upto{k}", T.LongType()) for k in range(len(at))), T.StructField("_part", T.IntegerType())])
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(count, *order).sortWithinPartitions(*order).mapInArrow(add_up, schema))
    ends = rows.groupBy("_part").agg(*(F.sum(v).alias(f"_sum{k}") for k, v in enumerate(values)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select("_part", *(F.coalesce(F.sum(f"_sum{k}").over(before), F.lit(0)).alias(f"_before{k}") for k in range(len(at))))
    joined = rows.join(F.broadcast(base), "_part")  # one row per shuffle partition
    return joined.select(*names, *((F.col(f"_upto{k}") + F.col(f"_before{k}")).alias(f"{v}_upto") for k, v in enumerate(values)))
