"""Queries of the general problems: interval periods (1) and failing rows (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.parsing import digits_up_to, is_cigar, loaded, parse_lines, rejected
from strandloom.operators.periods import periods_and_gaps, valid_intervals
from strandloom.plans.registry import Registry
from strandloom.session import table

registry = Registry()

_P1_SQL = r"""
WITH v AS (
  SELECT source_set, regexp_replace(record, '^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+$', '', 'g') AS record, start AS s, "end" AS e
  FROM genomic_intervals WHERE start >= 1 AND "end" >= start),
o AS (SELECT *, max(e) OVER (PARTITION BY source_set, record ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM v WHERE record <> '' AND source_set IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source_set, record ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM o),
p AS (SELECT source_set, record, n, min(s) AS seg_start, max(e) AS seg_end FROM i GROUP BY ALL),
g AS (SELECT source_set, record, 'gap' AS kind, seg_end + 1 AS seg_start, lead(seg_start) OVER (PARTITION BY source_set, record ORDER BY seg_start) - 1 AS seg_end FROM p)
"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    keys = ["source_set", "record"]
    return periods_and_gaps(valid_intervals(table(spark, d, "genomic_intervals"), keys), keys)


@registry.query(_P1_SQL + "SELECT source_set, record, 'period' AS kind, seg_start, seg_end FROM p UNION ALL SELECT * FROM g WHERE seg_end IS NOT NULL")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Covered periods and the gaps between them, per source set and record."""
    return _segments(spark, d)


@registry.query(
    _P1_SQL
    + """SELECT source_set, record, CAST(count(*) FILTER (kind = 'period') AS BIGINT) AS n_periods, CAST(count(*) FILTER (kind = 'gap') AS BIGINT) AS n_gaps,
  CAST(sum(CASE WHEN kind = 'period' THEN seg_end - seg_start + 1 ELSE 0 END) AS BIGINT) AS covered, CAST(sum(CASE WHEN kind = 'gap' THEN seg_end - seg_start + 1 ELSE 0 END) AS BIGINT) AS uncovered
  FROM (SELECT source_set, record, 'period' AS kind, seg_start, seg_end FROM p UNION ALL SELECT * FROM g WHERE seg_end IS NOT NULL) GROUP BY ALL"""
)
def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per source set and record: numbers of periods and gaps, covered and uncovered positions."""
    length = F.col("seg_end") - F.col("seg_start") + 1
    period = F.col("kind") == "period"
    return _segments(spark, d).groupBy("source_set", "record").agg(
        F.count_if(period).alias("n_periods"),
        F.count_if(~period).alias("n_gaps"),
        F.sum(F.when(period, length).otherwise(0)).alias("covered"),
        F.sum(F.when(~period, length).otherwise(0)).alias("uncovered"),
    )


SAM_LINE_FIELDS = ["qname", "flag", "reference", "start", "end", "strand", "mapq", "cigar", "read_length", "reference_span", "template_length", "read_group", "sample", "status"]
SAM_LINE_RULES = {
    "flag": lambda f: digits_up_to(f["flag"], 65535),
    "start": lambda f: digits_up_to(f["start"], 2147483647),
    "cigar": lambda f: is_cigar(f["cigar"]),
}
_SAM_CASTS = {"flag": "int", "start": "bigint", "end": "bigint", "mapq": "int", "read_length": "int", "reference_span": "bigint", "template_length": "bigint"}

# A line's fields, taken one by one from the left: quoted, or up to the next comma.
_P4_SQL = r"""
WITH l AS (SELECT line_id, raw_line, coalesce(NOT regexp_full_match(raw_line, '(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*', 's'), false) AS badq FROM sam_lines),
f AS (SELECT line_id, badq, CASE WHEN badq OR raw_line IS NULL THEN NULL ELSE list_transform(
        regexp_extract_all(',' || raw_line, ',(?:"(?:[^"]|"")*"|[^",]*)', 0, 's'),
        lambda x: CASE WHEN x[2:2] = '"' THEN replace(x[3:-2], '""', '"') ELSE x[2:] END) END AS v FROM l),
c AS (SELECT line_id, badq, v, NOT badq AND (v IS NULL OR len(v) <> 14) AS badc FROM f),
ok AS (SELECT line_id, v,
    regexp_full_match(v[2], '[0-9]+') AND length(ltrim(v[2], '0')) <= 5 AND coalesce(try_cast('0' || ltrim(v[2], '0') AS BIGINT), 99999) <= 65535 AS flag_ok,
    regexp_full_match(v[4], '[0-9]+') AND length(ltrim(v[4], '0')) <= 10 AND coalesce(try_cast('0' || ltrim(v[4], '0') AS BIGINT), 9999999999) <= 2147483647 AS start_ok,
    regexp_full_match(v[8], '\*|([0-9]+[MIDNSHP=X])+') AS cigar_ok
  FROM c WHERE NOT badq AND NOT badc),
r AS (SELECT line_id, 'quoting' AS reason FROM c WHERE badq UNION ALL SELECT line_id, 'columns' FROM c WHERE badc
  UNION ALL SELECT line_id, 'flag' FROM ok WHERE NOT flag_ok UNION ALL SELECT line_id, 'start' FROM ok WHERE NOT start_ok UNION ALL SELECT line_id, 'cigar' FROM ok WHERE NOT cigar_ok)
"""


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(table(spark, d, "sam_lines"), "raw_line", SAM_LINE_FIELDS, SAM_LINE_RULES)


@registry.query(_P4_SQL + "SELECT * FROM r")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that do not parse, one row per reason."""
    return rejected(_parsed(spark, d), ["line_id"])


@registry.query(
    _P4_SQL
    + """SELECT line_id, v[1] AS qname, CAST(v[2] AS INTEGER) AS flag, v[3] AS reference, CAST(v[4] AS BIGINT) AS start, TRY_CAST(v[5] AS BIGINT) AS "end", v[6] AS strand, TRY_CAST(v[7] AS INTEGER) AS mapq, v[8] AS cigar,
  TRY_CAST(v[9] AS INTEGER) AS read_length, TRY_CAST(v[10] AS BIGINT) AS reference_span, TRY_CAST(v[11] AS BIGINT) AS template_length, v[12] AS read_group, v[13] AS sample, v[14] AS status
  FROM ok WHERE flag_ok AND start_ok AND cigar_ok"""
)
def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines as typed alignment rows."""
    return loaded(_parsed(spark, d), ["line_id"], SAM_LINE_FIELDS, _SAM_CASTS)


@registry.query(_P4_SQL + "SELECT reason, CAST(count(*) AS BIGINT) AS n_lines FROM r GROUP BY reason")
def p4_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Number of lines by reason."""
    return rejected(_parsed(spark, d), ["line_id"]).groupBy("reason").agg(F.count("*").alias("n_lines"))
