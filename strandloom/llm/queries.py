"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import dedup, sketch, spans
from strandloom.llm.leak import LeakSearch
from strandloom.llm.mix import Mixture
from strandloom.llm.subjects import SubjectModel
from strandloom.llm.words import without_space
from strandloom.plans.registry import Registry
from strandloom.session import table

registry = Registry()

_P2_SQL = r"""
WITH n AS (SELECT record_id, regexp_replace(lower(sequence), '[^\p{L}]+', '', 'g') AS seq, list_sort(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) AS w
  FROM sequence_records WHERE title <> '' AND sequence <> ''),
k AS (SELECT record_id, min(record_id) OVER (PARTITION BY seq, w) AS keep_id, count(*) OVER (PARTITION BY seq, w) AS n_copies FROM n)
"""


def _duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.hidden_duplicates(table(spark, d, "sequence_records"), "record_id", "sequence", "title")


@registry.query(_P2_SQL + "SELECT keep_id, record_id AS copy_id FROM k WHERE record_id > keep_id")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each copy with the record it repeats."""
    return _duplicates(spark, d).where("record_id > keep_id").select("keep_id", F.col("record_id").alias("copy_id"))


@registry.query(_P2_SQL + "SELECT keep_id, CAST(max(n_copies) AS BIGINT) AS n_copies FROM k WHERE n_copies > 1 GROUP BY keep_id")
def p2_copies(spark: SparkSession, d: str) -> DataFrame:
    """Kept records with the size of their class."""
    return _duplicates(spark, d).where("record_id = keep_id").select("keep_id", "n_copies")


_P5_FROM = "sam_alignments"
_P5_SQL = """
WITH s AS (SELECT {keys}, CASE WHEN mapq = 0 THEN 0 WHEN mapq > 0 THEN ceil(round(ln(mapq) / ln(1.01 / 0.99), 9)) ELSE -ceil(round(ln(-mapq) / ln(1.01 / 0.99), 9)) END AS b,
    CASE WHEN mapq = 0 THEN 0.0 ELSE sign(mapq) * 2 / (1.01 / 0.99 + 1) * exp(ceil(round(ln(abs(mapq)) / ln(1.01 / 0.99), 9)) * ln(1.01 / 0.99)) END AS v
  FROM sam_alignments WHERE mapq IS NOT NULL {where}),
q AS (SELECT {keys}, count(*) AS n, {quantiles} FROM s GROUP BY ALL)
"""
PROBABILITIES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("estimate", "low", "high")})


@registry.query(
    _P5_SQL.format(keys="reference", where="", quantiles="list_zip([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99], quantile_cont(v, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])) AS z")
    + """, e AS (SELECT reference, n, unnest(z) AS u FROM q)
SELECT reference, CAST(u[1] AS DOUBLE) AS p, n, round(u[2], 6) AS estimate, round(u[2] / 1.01, 6) AS low, round(u[2] / 0.99, 6) AS high FROM e"""
)
def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of mapq per reference over all runs, merged from the sketches of single runs."""
    per_run = sketch.sketch(table(spark, d, "sam_alignments"), ["run_id", "reference"], "mapq")
    return _rounded(sketch.percentiles(sketch.merge(per_run, ["reference"]), ["reference"], PROBABILITIES))


@registry.query(
    _P5_SQL.format(keys="run_id, reference", where="AND reference <> '*'", quantiles="quantile_cont(v, 0.5) AS m")
    + """, b AS (SELECT run_id, group_label AS reference, max_by(median, made_at) AS box_median, max(count) AS box_count FROM box_summary GROUP BY ALL)
SELECT run_id, reference, n, round(m, 6) AS estimate, box_count, box_median FROM q FULL JOIN b USING (run_id, reference)"""
)
def p5_box_compared(spark: SparkSession, d: str) -> DataFrame:
    """The sketched median of each run and reference beside the latest median of its box summary; late rows came after some summaries."""
    mapped = table(spark, d, "sam_alignments").where("reference <> '*'")
    medians = sketch.percentiles(sketch.sketch(mapped, ["run_id", "reference"], "mapq"), ["run_id", "reference"], [0.5])
    boxes = table(spark, d, "box_summary").groupBy("run_id", F.col("group_label").alias("reference")).agg(F.max_by("median", "made_at").alias("box_median"), F.max("count").alias("box_count"))
    return medians.join(boxes, ["run_id", "reference"], "full").select("run_id", "reference", "n", F.round("estimate", 6).alias("estimate"), "box_count", "box_median")


@registry.query(
    _P5_SQL.format(keys="strftime(run_at, '%Y-%m') AS run_month, reference", where="", quantiles="quantile_cont(v, 0.5) AS m").replace("q AS (SELECT strftime(run_at, '%Y-%m') AS run_month", "q AS (SELECT run_month")
    + "SELECT run_month, reference, n, round(m, 6) AS estimate, round(m / 1.01, 6) AS low, round(m / 0.99, 6) AS high FROM q"
)
def p5_months(spark: SparkSession, d: str) -> DataFrame:
    """Medians per month and reference, combined from the sketches of single runs."""
    runs = table(spark, d, "sam_alignments").withColumn("run_month", F.date_format("run_at", "yyyy-MM"))
    per_run = sketch.sketch(runs, ["run_id", "run_month", "reference"], "mapq")
    return _rounded(sketch.percentiles(sketch.merge(per_run, ["run_month", "reference"]), ["run_month", "reference"], [0.5]).drop("p"))


_P3_SQL = r"""
WITH t AS (SELECT record_id AS row, regexp_replace(sequence, '[\s\x0B\x{85}\p{Z}]+', '', 'g') AS text FROM sequence_records
  UNION ALL SELECT -1 - row_number() OVER (), regexp_replace(pattern, '[\s\x0B\x{85}\p{Z}]+', '', 'g') FROM technical_sequences),
w AS (SELECT row, unnest(generate_series(1, length(text) - 49)) AS a, text FROM t WHERE length(text) >= 50),
h AS (SELECT row, a, substr(text, CAST(a AS INTEGER), 50) AS g FROM w),
s AS (SELECT g FROM h GROUP BY g HAVING min(row) <> max(row)),
x AS (SELECT row, a, lag(a) OVER (PARTITION BY row ORDER BY a) AS b FROM h SEMI JOIN s USING (g) WHERE row >= 0),
r AS (SELECT row, a, sum(CASE WHEN b IS NULL OR a > b + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY a) AS n FROM x),
f AS (SELECT row AS record_id, min(a) AS span_start, max(a) + 49 AS span_end FROM r GROUP BY row, n)
"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "sequence_records").select("record_id", "sequence")
    return spans.shared_spans(records, table(spark, d, "technical_sequences").select("pattern")).withColumnRenamed("row", "record_id")


@registry.query(_P3_SQL + "SELECT * FROM f")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of 50 letters and more that stand in another record or a pattern."""
    return _spans(spark, d)


@registry.query(
    _P3_SQL
    + """SELECT record_id, CAST(length(text) AS BIGINT) AS n_letters, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, CAST(coalesce(n_shared, 0) AS BIGINT) AS n_shared,
  round(coalesce(n_shared, 0) / length(text), 6) AS share FROM (SELECT row AS record_id, text FROM t WHERE row >= 0 AND text <> '')
  LEFT JOIN (SELECT record_id, count(*) AS n_spans, sum(span_end - span_start + 1) AS n_shared FROM f GROUP BY 1) USING (record_id)"""
)
def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per record: its length, and how much of it stands elsewhere too."""
    found = _spans(spark, d).groupBy("record_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start") + 1).alias("n_shared"))
    lengths = table(spark, d, "sequence_records").select("record_id", F.length(without_space(F.col("sequence"))).cast("long").alias("n_letters")).where("n_letters > 0")
    zero = F.lit(0).cast("long")
    shared = F.coalesce("n_shared", zero)
    return lengths.join(found, "record_id", "left").select("record_id", "n_letters", F.coalesce("n_spans", zero).alias("n_spans"), shared.alias("n_shared"), F.round(shared / F.col("n_letters"), 6).alias("share"))


_P6_SQL = r"""
WITH e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM e)),
dg AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g))
"""


def _leaks(spark: SparkSession, d: str) -> LeakSearch:
    return LeakSearch(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


@registry.query(_P6_SQL + "SELECT * FROM f")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 12 consecutive words of a test item."""
    return _leaks(spark, d).exact().select("doc_id", "item_id").distinct()


@registry.query(_P6_SQL + "SELECT item_id, suite, CAST(count(doc_id) AS BIGINT) AS n_docs FROM eval_items LEFT JOIN f USING (item_id) GROUP BY ALL")
def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Per test item: how many documents give it away."""
    found = _leaks(spark, d).exact().select("doc_id", "item_id").distinct().groupBy("item_id").agg(F.count("*").alias("n"))
    items = table(spark, d, "eval_items").select("item_id", "suite")
    return items.join(found, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0).cast("long")).alias("n_docs"))


@registry.query()
def p6_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least 9 of 12 consecutive item words, whichever they are, within two places of their order."""
    return _leaks(spark, d).near()


def _mixture(spark: SparkSession, d: str) -> Mixture:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@registry.query()
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents and how often each is used."""
    return _mixture(spark, d).repeats()


@registry.query()
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mixture(spark, d).shares()


def _subjects(spark: SparkSession, d: str) -> SubjectModel:
    # a fixed table of a dozen rows names the components
    names = sorted(r["subject"] for r in table(spark, d, "subject_areas").select("subject").collect())
    return SubjectModel(table(spark, d, "documents"), table(spark, d, "subject_labels"), names)


@registry.query()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of each document with text."""
    return _subjects(spark, d).of_documents().select("doc_id", "subject")


@registry.query()
def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Make-up of the corpus: documents of each subject, and their parts when a document of several subjects is divided among them by share."""
    found = _subjects(spark, d).of_documents()
    parts = found.join(found.groupBy("doc_id").agg(F.sum("share").alias("whole")), "doc_id")
    return parts.groupBy("subject").agg(F.count("*").alias("n_docs"), F.round(F.sum(F.col("share") / F.col("whole")), 3).alias("doc_parts"))
