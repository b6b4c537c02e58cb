"""Queries of workflows and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans import workflow
from strandloom.plans.registry import Registry
from strandloom.session import table
from strandloom.streaming.folds import run_to_end, stream_parquet, windowed

registry = Registry()
query = registry.query


@query("SELECT l_returnflag, count(*) AS row_count, round(sum(l_quantity), 6) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean FROM lineitem WHERE l_quantity > 10 AND l_linestatus = 'O' GROUP BY 1")
def workflow_summary(spark: SparkSession, d: str) -> DataFrame:
    """A workflow of filters, a summary and a sort."""
    plan = [
        {"op": "filter", "column": "L_QUANTITY", "rule": "gt", "value": "10"},
        {"op": "filter", "column": "l_linestatus", "rule": "equals", "value": "O"},
        {"op": "select", "columns": "l_returnflag,l_linestatus,l_quantity"},
        {"op": "summarize", "groups": ["l_returnflag"], "values": ["l_quantity"], "operations": ["sum", "mean"]},
        {"op": "sort", "rules": [("l_returnflag", False)]},
    ]
    return workflow.run(table(spark, d, "lineitem"), plan)


@query("SELECT record_id, 'EcoRI' AS motif, '+' AS strand, a AS start, a + 5 AS \"end\" FROM (SELECT record_id, sequence AS s, unnest(range(1, length(sequence) + 1)) AS a FROM sequence_records WHERE length(sequence) >= 100) WHERE upper(substr(s, CAST(a AS INTEGER), 6)) = 'GAATTC'")
def workflow_motifs(spark: SparkSession, d: str) -> DataFrame:
    """A workflow from records to motif places."""
    plan = [{"op": "to_records"}, {"op": "min_length", "n": 100}, {"op": "find_motifs", "motifs": {"EcoRI": "GAATTC"}}]
    return workflow.run(table(spark, d, "sequence_records").select("record_id", "title", "sequence"), plan)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events in windows of a day, folded as a stream."""
    stream = stream_parquet(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema)
    days = windowed(stream, "ts", ["event_type"], "1 day", {"n": F.count("*"), "total": F.sum("value")})
    return run_to_end(days, ["window_start", "event_type"]).withColumn("total", F.round("total", 4))


@query("SELECT reference, count(*) AS n, CAST(sum(mapq) AS BIGINT) AS mapq_sum FROM sam_alignments GROUP BY reference")
def stream_references(spark: SparkSession, d: str) -> DataFrame:
    """Alignments folded by reference as a stream."""
    stream = stream_parquet(spark, f"{d}/sam_alignment[s].parquet", table(spark, d, "sam_alignments").schema)
    return run_to_end(stream.groupBy("reference").agg(F.count("*").alias("n"), F.sum("mapq").alias("mapq_sum")), ["reference"])
