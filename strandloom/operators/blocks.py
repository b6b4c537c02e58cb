"""Alignment blocks of genome comparisons: comparison, reference, strand, start, end (on the reference), query_start, query_end, identity, block_length, mapq."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.periods import periods_and_gaps


def filter_blocks(blocks: DataFrame, min_identity: float = 0.0, min_length: int = 1, min_mapq: int = 0, both_strands: bool = True) -> DataFrame:
    """Blocks of enough identity, length and mapping quality (a missing quality passes); reverse ones only with ``both_strands``."""
    kept = blocks.where((F.col("identity") >= min_identity) & (F.col("block_length") >= min_length) & (F.col("mapq").isNull() | (F.col("mapq") >= min_mapq)))
    return kept if both_strands else kept.where(F.col("strand") != "-")


def reference_coverage(blocks: DataFrame) -> DataFrame:
    """Positions of each reference that the blocks of a comparison cover: comparison, reference, covered."""
    keys = ["comparison", "reference"]
    rows = blocks.where("start >= 1 AND `end` >= start AND comparison IS NOT NULL AND reference IS NOT NULL").select(*keys, F.col("start").alias("seg_start"), F.col("end").alias("seg_end"))
    return periods_and_gaps(rows, keys).where("kind = 'period'").groupBy(*keys).agg(F.sum(F.col("seg_end") - F.col("seg_start") + 1).alias("covered"))


def exact_block_copies(blocks: DataFrame) -> DataFrame:
    """Blocks without their copies: of blocks equal in comparison, reference, strand and all four places, the one of the best identity stays, with ``n_copies``."""
    keys = ["comparison", "reference", "strand", "start", "end", "query_start", "query_end"]
    rest = [c for c in blocks.columns if c not in keys]
    best = F.max(F.struct("identity", *(c for c in rest if c != "identity"))).alias("_b")
    return blocks.groupBy(*keys).agg(best, F.count("*").alias("n_copies")).select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest), "n_copies")
