"""Structured Streaming versions of the folds."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import shared_dir


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 16) -> DataFrame:
    """Parquet files as a stream; ``path`` is a folder or a glob (a single file needs a glob, such as ``event[s].parquet``)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """A folder of text files as a stream of lines; stateless parsers and filters apply to it as to a table."""
    return spark.readStream.text(path)


def windowed(stream: DataFrame, ts: str, groups: Sequence[str], window: str, aggregates: dict[str, Column], delay: str | None = None) -> DataFrame:
    """Aggregates per event-time window and group; with ``delay``, later rows than that are dropped and state stays bounded."""
    late = stream.withWatermark(ts, delay) if delay else stream
    out = late.groupBy(F.window(ts, window).alias("_w"), *groups).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("_w.start").alias("window_start"), *groups, *aggregates)


def run_to_end(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs an aggregating stream over all that is there and returns its final rows.

    Each batch appends the groups it changed to Parquet in the shared folder; of
    each group the latest state counts.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/strandloom-stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("append").parquet(f"{base}/out")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{base}/out")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*")
