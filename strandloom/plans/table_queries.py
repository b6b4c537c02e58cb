"""Queries over tables, lists and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.exprs import clean_text, compare, natural_key
from strandloom.operators import plotdata, profile, sets_text, tables
from strandloom.plans.registry import Registry
from strandloom.session import table

registry = Registry()
query = registry.query


@query("""SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_price, round(avg(o_totalprice), 4) AS mean_price
FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus""")
def sql_where_group_order(spark: SparkSession, d: str) -> DataFrame:
    """Spark SQL over a table given as argument: filter, group, order."""
    return spark.sql("""SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_price, round(avg(o_totalprice), 4) AS mean_price
        FROM {orders} WHERE o_totalprice > 1000 GROUP BY o_orderstatus ORDER BY n_orders DESC""", orders=table(spark, d, "orders"))


@query("SELECT p_brand, count(*) AS n_parts, min(p_size) AS min_size, max(p_size) AS max_size FROM part WHERE p_name ILIKE '%red%' AND p_type IN ('ECONOMY', 'STANDARD') AND p_brand IS NOT NULL GROUP BY p_brand")
def sql_like_in_is(spark: SparkSession, d: str) -> DataFrame:
    """LIKE, IN and IS NOT NULL."""
    parts = table(spark, d, "part").where(F.col("p_name").ilike("%red%") & F.col("p_type").isin("ECONOMY", "STANDARD") & F.col("p_brand").isNotNull())
    return parts.groupBy("p_brand").agg(F.count("*").alias("n_parts"), F.min("p_size").alias("min_size"), F.max("p_size").alias("max_size"))


@query("SELECT sample_id, concentration_ng_ul FROM sample_sheet WHERE try_cast(concentration_ng_ul AS DOUBLE) >= 100")
def cells_compared(spark: SparkSession, d: str) -> DataFrame:
    """Text cells compared as numbers where both are numbers."""
    sheet = table(spark, d, "sample_sheet").where(F.col("concentration_ng_ul").rlike(r"^[0-9.]+$"))
    return sheet.where(compare(F.col("concentration_ng_ul"), ">=", F.lit("100"))).select("sample_id", "concentration_ng_ul")


_GROUPED = ", ".join(f"count({v}) AS {v}_count, round(sum({v}), 6) AS {v}_sum, round(avg({v}), 6) AS {v}_mean, round(quantile_cont({v}, 0.5), 6) AS {v}_median, min({v}) AS {v}_min, max({v}) AS {v}_max, round(stddev_samp({v}), 6) AS {v}_sd, count(DISTINCT {v}) AS {v}_distinct" for v in ("l_quantity", "l_discount"))


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS row_count, {_GROUPED} FROM lineitem GROUP BY ALL")
def group_summary(spark: SparkSession, d: str) -> DataFrame:
    """All eight group operations."""
    return tables.summarize_groups(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])


@query("""SELECT lower(trim(treatment)) AS treatment, count(*) AS row_count, count(x) AS conc_count, round(avg(x), 6) AS conc_mean, count(DISTINCT x) AS conc_distinct FROM (
  SELECT treatment, CASE WHEN trim(concentration_ng_ul) IN ('', 'NA', 'N/A', 'na', 'n/a', 'null', 'NULL', '-') THEN NULL ELSE try_cast(concentration_ng_ul AS DOUBLE) END AS x FROM sample_sheet) GROUP BY 1""")
def group_summary_missing(spark: SparkSession, d: str) -> DataFrame:
    """Group summary over dirty text cells."""
    sheet = table(spark, d, "sample_sheet").select(F.lower(F.trim("treatment")).alias("treatment"), F.col("concentration_ng_ul").try_cast("double").alias("conc"))
    return tables.summarize_groups(sheet, ["treatment"], ["conc"], ["count", "mean", "distinct"])


@query("SELECT o_orderkey, o_custkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    """Inner join on normalised keys."""
    left = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return tables.join_tables(left, table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), [("o_custkey", "c_custkey")])


@query("SELECT n_name, n_nationkey, s_suppkey, s_acctbal FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    """Left join."""
    return tables.join_tables(table(spark, d, "nation").select("n_name", "n_nationkey"), table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), [("n_nationkey", "s_nationkey")], "left")


@query("""SELECT coalesce(a.reference, b.reference) AS reference, a.n AS n, b.length AS length FROM
  (SELECT reference, count(*) AS n FROM sam_alignments GROUP BY reference) a FULL JOIN sam_references b ON lower(trim(a.reference)) = lower(trim(b.reference)) AND trim(a.reference) <> ''""")
def join_full(spark: SparkSession, d: str) -> DataFrame:
    """Full join: the key column is filled from both sides."""
    counts = table(spark, d, "sam_alignments").groupBy("reference").agg(F.count("*").alias("n"))
    return tables.join_tables(counts, table(spark, d, "sam_references"), [("reference", "reference")], "full").select("reference", "n", "length")


@query("SELECT sample_id, treatment, run_id, mapq FROM (SELECT DISTINCT sample_id, treatment FROM sample_sheet) s JOIN sam_alignments a ON lower(trim(a.sample)) = lower(trim(s.sample_id)) AND trim(a.sample) <> ''")
def join_dirty_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that differ in case and white space; blank keys never match."""
    sheet = table(spark, d, "sample_sheet").select("sample_id", "treatment").distinct()
    return tables.join_tables(sheet, table(spark, d, "sam_alignments").select("sample", "run_id", "mapq"), [("sample_id", "sample")]).select("sample_id", "treatment", "run_id", "mapq")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a partner."""
    return tables.join_tables(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").select("o_custkey"), [("c_custkey", "o_custkey")], "semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a partner."""
    return tables.join_tables(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").select("o_custkey"), [("c_custkey", "o_custkey")], "anti")


@query("""SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 6) AS F, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 6) AS O FROM lineitem GROUP BY l_returnflag""")
def pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    """Long to wide with sums."""
    return tables.long_to_wide(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", "sum", columns=["F", "O"])


@query("SELECT run_id, arg_min(mapq, aln_id) FILTER (strand = '+') AS plus, arg_min(mapq, aln_id) FILTER (strand = '-') AS minus FROM (SELECT * FROM sam_alignments WHERE mapq IS NOT NULL) GROUP BY run_id")
def pivot_first(spark: SparkSession, d: str) -> DataFrame:
    """Long to wide, the first value by id."""
    rows = table(spark, d, "sam_alignments").where("mapq IS NOT NULL")
    return tables.long_to_wide(rows, ["run_id"], "strand", "mapq", "first", ["aln_id"], ["+", "-"]).withColumnsRenamed({"+": "plus", "-": "minus"})


@query("""SELECT run_id, group_label, name, value FROM (SELECT run_id, group_label, made_at, CAST(CAST(min AS INTEGER) AS VARCHAR) AS min, CAST(CAST(max AS INTEGER) AS VARCHAR) AS max, CAST(outlier_count AS VARCHAR) AS outlier_count FROM box_summary) UNPIVOT (value FOR name IN (min, max, outlier_count))""")
def unpivot_long(spark: SparkSession, d: str) -> DataFrame:
    """Wide to long."""
    rows = table(spark, d, "box_summary").select("run_id", "group_label", F.col("min").cast("int").alias("min"), F.col("max").cast("int").alias("max"), "outlier_count")
    return tables.wide_to_long(rows, ["run_id", "group_label"], ["min", "max", "outlier_count"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice + l_tax, 6) AS plus, round(l_extendedprice / 7, 6) AS ratio,
  round(CASE WHEN l_extendedprice <> 0 THEN l_tax / l_extendedprice * 100 END, 6) AS percent, round(CASE WHEN l_quantity > 0 THEN log2(l_quantity) END, 6) AS lg FROM lineitem""")
def calculate_columns(spark: SparkSession, d: str) -> DataFrame:
    """Calculated columns."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_tax", "l_quantity")
    for name, op, a, b in (("plus", "add", "l_extendedprice", "l_tax"), ("ratio", "divide", "l_extendedprice", 7), ("percent", "percent", "l_tax", "l_extendedprice"), ("lg", "log2", "l_quantity", None)):
        rows = tables.calculate(rows, name, op, a, b)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "plus", "ratio", "percent", "lg")


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS z FROM customer")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    """Standard scores."""
    return tables.calculate(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "z", "zscore", "c_acctbal").select("c_custkey", "z")


_CLEAN = "CASE WHEN lower({0}) IN ('.', 'n/a', 'na', 'null') THEN '' ELSE {0} END"
_SHEET = ["sample_id", "collection_date", "treatment", "replicate", "concentration_ng_ul", "od260_280", "qc_pass", "notes"]


@query("SELECT DISTINCT " + ", ".join(_CLEAN.format(f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'), ' ')") + f" AS {c}" for c in _SHEET) + " FROM sample_sheet WHERE trim(replicate) <> '' AND lower(replicate) NOT IN ('.', 'n/a', 'na', 'null')")
def clean_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The cleaning pipeline: normalise, filter rows, drop repeated and empty rows."""
    return tables.clean_table(table(spark, d, "sample_sheet"), [("replicate", "not_empty", "")])


@query("SELECT DISTINCT record_trimmed, source_set FROM (SELECT trim(regexp_replace(coalesce(record, ''), '\\s+', ' ', 'g'), ' ') AS record_trimmed, source_set FROM genomic_intervals) WHERE record_trimmed <> ''")
def distinct_records(spark: SparkSession, d: str) -> DataFrame:
    """Distinct normalised cells."""
    rows = table(spark, d, "genomic_intervals").select(clean_text(F.col("record")).alias("record_trimmed"), "source_set")
    return rows.where("record_trimmed <> ''").distinct()


@query("SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT p_brand, p_partkey, p_retailprice, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part) WHERE rank <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    """Top 3 parts of each brand."""
    return tables.top_per_group(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3)


@query("""WITH u AS (SELECT 'event_type' AS "column", event_type AS cell FROM events UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events), c AS (SELECT "column", cell, count(*) AS n_cells FROM u WHERE cell IS NOT NULL AND trim(cell) <> '' GROUP BY ALL)
SELECT "column", cell, n_cells, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n_cells DESC, cell) AS rank FROM c) WHERE rank <= 5""")
def topk_values(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent cells by column."""
    return profile.top_values(table(spark, d, "events"), ["event_type", "user_id"])


_PROFILE = """SELECT '{0}' AS "column", '{1}' AS type, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({0}) AS BIGINT) AS n_missing, round((count(*) - count({0})) * 100 / count(*), 2) AS missing_percent, count(DISTINCT {0}) AS n_distinct,
 {2} min(length(CAST({0} AS VARCHAR))) AS min_length, max(length(CAST({0} AS VARCHAR))) AS max_length FROM (SELECT CASE WHEN {0} IS NOT NULL AND trim(CAST({0} AS VARCHAR)) NOT IN ('', 'NA', 'N/A', 'na', 'n/a', 'null', 'NULL', '-') THEN {0} END AS {0} FROM sam_alignments)"""
_AS_NUMBER = "CAST(min({0}) AS DOUBLE) AS min_number, CAST(max({0}) AS DOUBLE) AS max_number, round(avg({0}), 6) AS mean_number, round(quantile_cont({0}, 0.5), 6) AS median_number,"
_NO_NUMBER = "CAST(NULL AS DOUBLE) AS min_number, CAST(NULL AS DOUBLE) AS max_number, CAST(NULL AS DOUBLE) AS mean_number, CAST(NULL AS DOUBLE) AS median_number,"


@query(" UNION ALL ".join(_PROFILE.format(c, t, (_AS_NUMBER if t == "integer" else _NO_NUMBER).format(c)) for c, t in (("mapq", "integer"), ("read_length", "integer"), ("read_group", "text"), ("cigar", "text"))))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    """Type, missing cells, distinct values and figures by column."""
    return profile.column_profile(table(spark, d, "sam_alignments"), ["mapq", "read_length", "read_group", "cigar"])


@query("""WITH t AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders WHERE o_totalprice IS NOT NULL),
m AS (SELECT x, count(*) AS c FROM t GROUP BY x ORDER BY c DESC, x LIMIT 1)
SELECT 'o_totalprice' AS "column", count(*) AS n, round(sum(x), 4) AS sum, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median, min(x) AS min, max(x) AS max, round(max(x) - min(x), 4) AS range,
 round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.75), 4) AS q3, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) AS iqr, round(var_samp(x), 1) AS variance, round(stddev_samp(x), 4) AS sd,
 round(stddev_samp(x) / sqrt(count(*)), 4) AS se, round(stddev_samp(x) / abs(avg(x)) * 100, 4) AS cv_percent, round(avg(x) FILTER (i > floor(n * 0.1) AND i <= n - floor(n * 0.1)), 4) AS trimmed_mean,
 round(skewness(x), 4) AS skewness, round(kurtosis(x), 4) AS kurtosis, (SELECT x FROM m) AS mode, (SELECT c FROM m) AS mode_count FROM t""")
def descriptive(spark: SparkSession, d: str) -> DataFrame:
    """Descriptive statistics."""
    return profile.describe(table(spark, d, "orders"), ["o_totalprice"]).withColumn("variance", F.round("variance", 1)).drop("ci_low", "ci_high")


_CORR = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"), ("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"), ("l_discount", "l_discount")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS pearson, round(covar_samp({a}, {b}), 4) AS covariance FROM lineitem" for a, b in _CORR))
def correlation_pearson(spark: SparkSession, d: str) -> DataFrame:
    """Pearson correlations and covariances of all pairs."""
    return profile.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("""SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS ra, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS rb FROM lineitem)""")
def correlation_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's rank correlation."""
    return profile.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("""WITH c AS (SELECT l_quantity AS a, l_discount AS b, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT CAST(sum(CASE WHEN y.b > x.b THEN x.n * y.n ELSE 0 END) AS BIGINT) AS n_concordant, CAST(sum(CASE WHEN y.b < x.b THEN x.n * y.n ELSE 0 END) AS BIGINT) AS n_discordant FROM c x JOIN c y ON y.a > x.a),
t AS (SELECT CAST(sum(t) AS BIGINT) AS n, sum(t * (t - 1) / 2) AS ta FROM (SELECT sum(n) AS t FROM c GROUP BY a)), u AS (SELECT sum(t * (t - 1) / 2) AS tb FROM (SELECT sum(n) AS t FROM c GROUP BY b))
SELECT n, n_concordant, n_discordant, round((n_concordant - n_discordant) / sqrt((n * (n - 1) / 2 - ta) * (n * (n - 1) / 2 - tb)), 6) AS tau_b FROM p, t, u""")
def correlation_kendall(spark: SparkSession, d: str) -> DataFrame:
    """Kendall's tau-b."""
    return profile.kendall(table(spark, d, "lineitem"), "l_quantity", "l_discount")


@query("SELECT mapq IS NULL AS a_missing, read_group IS NULL OR trim(read_group) IN ('', 'NA', 'N/A', 'na', 'n/a', 'null', 'NULL', '-') AS b_missing, count(*) AS n_rows FROM sam_alignments GROUP BY ALL")
def missing_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Missing cells of two columns together."""
    return profile.missing_patterns(table(spark, d, "sam_alignments"), "mapq", "read_group")


@query("SELECT l_returnflag AS category, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS sd, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3, max(l_extendedprice) AS max FROM lineitem GROUP BY 1")
def compare_numeric_category(spark: SparkSession, d: str) -> DataFrame:
    """A number by category."""
    return profile.numeric_by_category(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


@query("""WITH c AS (SELECT c_mktsegment AS a, CAST(c_nationkey AS VARCHAR) AS b FROM customer), ra AS (SELECT a, row_number() OVER (ORDER BY count(*) DESC, a) AS k FROM c GROUP BY a), rb AS (SELECT b, row_number() OVER (ORDER BY count(*) DESC, b) AS k FROM c GROUP BY b),
m AS (SELECT CASE WHEN ra.k <= 8 THEN a ELSE 'Other' END AS a, CASE WHEN rb.k <= 8 THEN b ELSE 'Other' END AS b, count(*) AS n FROM c JOIN ra USING (a) JOIN rb USING (b) GROUP BY ALL)
SELECT a, b, n, round(n * 100 / sum(n) OVER (), 2) AS percent, round(n * 100 / sum(n) OVER (PARTITION BY a), 2) AS row_percent, round(n * 100 / sum(n) OVER (PARTITION BY b), 2) AS column_percent FROM m""")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Contingency table with percents and rare categories joined."""
    return profile.crosstab(table(spark, d, "customer"), "c_mktsegment", "c_nationkey", 8)


@query("""WITH g AS (SELECT event_type, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
j AS (SELECT * FROM events JOIN g USING (event_type) WHERE value IS NOT NULL), m AS (SELECT event_type, quantile_cont(abs(value - med), 0.5) AS mad FROM j GROUP BY 1),
x AS (SELECT event_id, event_type, value, (value - mean) / nullif(sd, 0) AS z, 0.6745 * (value - med) / nullif(mad, 0) AS mz, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM j JOIN m USING (event_type))
SELECT event_id, event_type, value, round(z, 6) AS z, round(mz, 6) AS modified_z, round(lo, 6) AS low_fence, round(hi, 6) AS high_fence, coalesce(abs(z) >= 3, false) AS z_flag, coalesce(abs(mz) >= 3.5, false) AS modified_z_flag, value < lo OR value > hi AS iqr_flag FROM x""")
def outliers_grouped(spark: SparkSession, d: str) -> DataFrame:
    """Outlier scores and flags within groups."""
    return profile.outliers(table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", "value")


@query("""WITH s AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders), g AS (SELECT CAST(unnest(range(20)) AS INTEGER) AS bin), c AS (SELECT CAST(least(floor((o_totalprice - low) / ((high - low) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM orders, s GROUP BY 1)
SELECT bin, round(low + bin * ((high - low) / 20), 6) AS bin_start, round(low + (bin + 1) * ((high - low) / 20), 6) AS bin_end, coalesce(n, 0) AS n_values FROM g LEFT JOIN c USING (bin), s""")
def histogram_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of 20 bins."""
    return plotdata.histogram(table(spark, d, "orders"), "o_totalprice", 20)


@query("""WITH s AS (SELECT min(value) AS low, max(value) AS high, count(value) AS n, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events), b AS (SELECT low, high, CAST(greatest(1, least(80, ceil((high - low) / (2 * iqr / pow(n, 1 / 3.0))))) AS INTEGER) AS bins FROM s), g AS (SELECT unnest(range(bins)) AS bin, low, (high - low) / bins AS step FROM b),
c AS (SELECT CAST(least(floor((value - low) / ((high - low) / bins)), bins - 1) AS INTEGER) AS bin, count(*) AS n FROM events, b WHERE value IS NOT NULL GROUP BY 1)
SELECT CAST(bin AS INTEGER) AS bin, round(low + bin * step, 6) AS bin_start, round(low + (bin + 1) * step, 6) AS bin_end, coalesce(n, 0) AS n_values FROM g LEFT JOIN c USING (bin)""")
def histogram_auto(spark: SparkSession, d: str) -> DataFrame:
    """Histogram with bins from the data."""
    return plotdata.histogram(table(spark, d, "events"), "value")


@query("""WITH v AS (SELECT reference, CAST(mapq AS DOUBLE) AS x FROM sam_alignments WHERE mapq IS NOT NULL AND reference <> '*'), f AS (SELECT reference, count(*) AS n, min(x) AS min, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS max FROM v GROUP BY 1)
SELECT reference, any_value(n) AS n, any_value(min) AS min, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3, any_value(max) AS max, min(x) FILTER (ok) AS whisker_low, max(x) FILTER (ok) AS whisker_high, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS outlier_count
FROM (SELECT *, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM v JOIN f USING (reference)) GROUP BY reference""")
def box_plot(spark: SparkSession, d: str) -> DataFrame:
    """Box figures of mapq by reference."""
    return plotdata.box(table(spark, d, "sam_alignments").where("reference <> '*'"), ["reference"], "mapq")


@query("""WITH c AS (SELECT strand, CAST(mapq AS DOUBLE) AS v, count(*) AS c FROM sam_alignments WHERE mapq IS NOT NULL AND reference <> '*' GROUP BY ALL), r AS (SELECT strand, CAST(mapq AS DOUBLE) AS v FROM sam_alignments WHERE mapq IS NOT NULL AND reference <> '*'), w AS (SELECT strand, count(*) AS n, stddev_samp(v) AS sd, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM r GROUP BY 1),
h AS (SELECT strand, n, 0.9 * CASE WHEN iqr > 0 THEN least(sd, iqr / 1.34) ELSE sd END * pow(n, -0.2) AS h FROM w), g AS (SELECT unnest(range(32)) AS i, low, (high - low) / 31 AS step FROM (SELECT min(v) AS low, max(v) AS high FROM c)), e AS (SELECT strand, low + i * step AS x, c.v, c.c, n, h FROM c JOIN h USING (strand), g WHERE h > 0)
SELECT strand, round(x, 6) AS x, round(sum(exp(-pow((x - v) / h, 2) / 2) * c) / max(n * h) / sqrt(2 * pi()), 6) AS density FROM e GROUP BY strand, x""")
def violin_density(spark: SparkSession, d: str) -> DataFrame:
    """Density of mapq by strand."""
    return plotdata.density(table(spark, d, "sam_alignments").where("reference <> '*'"), ["strand"], "mapq")


@query("""WITH c AS (SELECT c_mktsegment AS x, c_nationkey AS y, round(avg(c_acctbal), 6) AS mean, count(*) AS n FROM customer GROUP BY ALL)
SELECT x, y, mean, coalesce(n, 0) AS n FROM (SELECT DISTINCT x FROM c) CROSS JOIN (SELECT DISTINCT y FROM c) LEFT JOIN c USING (x, y)""")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Means of all cells of two categories."""
    return plotdata.heatmap(table(spark, d, "customer"), "c_mktsegment", "c_nationkey", "c_acctbal")


@query("SELECT n_name AS source, c_mktsegment AS target, round(sum(c_acctbal), 2) AS flow FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY ALL")
def sankey_flows(spark: SparkSession, d: str) -> DataFrame:
    """Positive flows between nations and segments."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return plotdata.flows(rows, "n_name", "c_mktsegment", "c_acctbal")


@query("""WITH e AS (SELECT n_name AS source, c_mktsegment AS target, round(sum(c_acctbal), 2) AS flow FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY ALL)
SELECT node, round(sum(incoming), 2) AS incoming, round(sum(outgoing), 2) AS outgoing FROM (SELECT source AS node, 0.0 AS incoming, flow AS outgoing FROM e UNION ALL SELECT target, flow, 0.0 FROM e) GROUP BY node""")
def sankey_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Totals by node."""
    return plotdata.node_totals(sankey_flows(spark, d))


@query("""SELECT node, CAST(max(level) AS INTEGER) AS level FROM (SELECT r_name AS node, 0 AS level FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
 UNION ALL SELECT c_mktsegment, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY node""")
def sankey_levels(spark: SparkSession, d: str) -> DataFrame:
    """Longest-path levels of a three-step flow."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = rows.select(F.col("r_name").alias("source"), F.col("n_name").alias("target")).union(rows.select("n_name", "c_mktsegment")).distinct()
    return plotdata.node_levels(edges)


@query("SELECT x, CAST(rank AS BIGINT) AS rank, round((rank - 0.5) / n, 9) AS probability FROM (SELECT value AS x, max(i) AS rank, any_value(n) AS n FROM (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) GROUP BY value)")
def qq_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks and probabilities of a Q-Q plot."""
    return plotdata.qq(table(spark, d, "events"), "value").drop("quantile")


@query()
def qq_points(spark: SparkSession, d: str) -> DataFrame:
    """Q-Q points with normal quantiles."""
    return plotdata.qq(table(spark, d, "events"), "value")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_discount - 0.05 AS effect, l_tax + 0.001 AS p, round(-log10(l_tax + 0.001), 6) AS minus_log10_p, CASE WHEN l_tax + 0.001 <= 0.03 AND l_discount - 0.05 >= 0.02 THEN 'up' WHEN l_tax + 0.001 <= 0.03 AND l_discount - 0.05 <= -0.02 THEN 'down' ELSE 'ns' END AS kind FROM lineitem""")
def volcano(spark: SparkSession, d: str) -> DataFrame:
    """Effect and significance classes."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax")
    return plotdata.volcano(rows, F.col("l_discount") - 0.05, F.col("l_tax") + 0.001, 0.02, 0.03).drop("l_discount", "l_tax")


@query("""WITH o AS (SELECT reference, length, regexp_extract(reference, '^(\\D+)', 1) AS t, CAST(regexp_extract(reference, '(\\d+)$', 1) AS INTEGER) AS k FROM sam_references WHERE length IS NOT NULL),
p AS (SELECT reference, row_number() OVER w AS chrom_no, coalesce(sum(length) OVER (ORDER BY t, k, reference ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM o WINDOW w AS (ORDER BY t, k, reference))
SELECT aln_id, a.reference, a.start, CAST(chrom_no AS INTEGER) AS chrom_no, CAST(off + a.start AS BIGINT) AS cumulative FROM sam_alignments a JOIN p ON a.reference = p.reference""")
def manhattan(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative positions over references in natural order."""
    rows = table(spark, d, "sam_alignments").select("aln_id", "reference", "start")
    return plotdata.manhattan(rows, "reference", "start", table(spark, d, "sam_references")).select("aln_id", "reference", "start", "chrom_no", "cumulative")


@query("SELECT DISTINCT reference FROM sam_alignments")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """References in natural order."""
    return table(spark, d, "sam_alignments").select("reference").distinct().orderBy(natural_key(F.col("reference")), "reference")


@query("""WITH u AS (SELECT lower(trim(reference)) AS key, 1 AS a, 0 AS r, 0 AS i FROM sam_alignments UNION ALL SELECT lower(trim(reference)), 0, 1, 0 FROM sam_references UNION ALL SELECT lower(trim(record, ' ')), 0, 0, 1 FROM genomic_intervals)
SELECT key, CAST(sum(a) AS BIGINT) AS in_alignments, CAST(sum(r) AS BIGINT) AS in_references, CAST(sum(i) AS BIGINT) AS in_intervals, concat_ws('&', CASE WHEN sum(a) > 0 THEN 'alignments' END, CASE WHEN sum(r) > 0 THEN 'references' END, CASE WHEN sum(i) > 0 THEN 'intervals' END) AS membership FROM u WHERE key <> '' GROUP BY key""")
def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Membership of names in three lists."""
    lists = [("alignments", table(spark, d, "sam_alignments").select("reference")), ("references", table(spark, d, "sam_references").select("reference")), ("intervals", table(spark, d, "genomic_intervals").select("record"))]
    return sets_text.compare_lists(lists)


@query("""WITH u AS (SELECT CAST(c_nationkey AS VARCHAR) AS key, 1 AS a FROM customer UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 2 FROM supplier), k AS (SELECT key, bool_or(a = 1) AS c, bool_or(a = 2) AS s FROM u GROUP BY key)
SELECT concat_ws('&', CASE WHEN c THEN 'customers' END, CASE WHEN s THEN 'suppliers' END) AS membership, count(*) AS n_items FROM k GROUP BY 1""")
def set_categories(spark: SparkSession, d: str) -> DataFrame:
    """Items by membership pattern."""
    compared = sets_text.compare_lists([("customers", table(spark, d, "customer").select("c_nationkey")), ("suppliers", table(spark, d, "supplier").select("s_nationkey"))])
    return sets_text.overlap_categories(compared)


@query("SELECT 'both' AS part, nk FROM (SELECT c_nationkey AS nk FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers only', nk FROM (SELECT c_nationkey AS nk FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def intersect_except(spark: SparkSession, d: str) -> DataFrame:
    """Intersection and difference."""
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("nk")), table(spark, d, "supplier").select("s_nationkey")
    both, only = c.intersect(s), c.exceptAll(c.join(s, F.col("nk") == F.col("s_nationkey"), "left_semi")).distinct()
    return both.select(F.lit("both").alias("part"), "nk").unionByName(only.select(F.lit("customers only").alias("part"), "nk"))


_STOP = ("the", "and", "for", "that", "with", "not", "you", "are", "was", "but")


@query(f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''-]*')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= 3 AND word NOT IN {_STOP} GROUP BY word)
SELECT word, n, round(n * 100 / (SELECT sum(n) FROM c), 6) AS percent FROM c ORDER BY n DESC, word LIMIT 100""")
def word_cloud(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent words."""
    return sets_text.word_counts(table(spark, d, "documents"), "text", _STOP, 3, 100)


@query("""WITH l AS (SELECT trim(regexp_replace(unnest(regexp_split_to_array(tags, '[,<>]+')), '\\s+', ' ', 'g'), ' ') AS item, doc_id FROM documents WHERE tags IS NOT NULL)
SELECT lower(item) AS key, count(*) AS n, arg_min(item, doc_id) AS item FROM l WHERE item <> '' GROUP BY 1""")
def line_list(spark: SparkSession, d: str) -> DataFrame:
    """List items counted without regard to case, in their first spelling."""
    items = sets_text.list_items(table(spark, d, "documents").where("tags IS NOT NULL"), "tags", "[,<>]+", ["doc_id"])
    return sets_text.count_items(items, "item", order=["doc_id", "place"])


@query(r"SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS replaced, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS n_matches FROM documents WHERE text IS NOT NULL")
def search_replace(spark: SparkSession, d: str) -> DataFrame:
    """Regular-expression replacement with counts."""
    return sets_text.replace_text(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"), "text", "[0-9]+", "#").drop("text")


@query(r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS content, generate_subscripts(regexp_split_to_array(text, '\r\n|\r|\n'), 1) AS line FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, line, unnest(regexp_extract_all(content, 'https?://[^\s)]+')) AS matched, generate_subscripts(regexp_extract_all(content, 'https?://[^\s)]+'), 1) AS match_no FROM l)
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(match_no AS INTEGER) AS match_no, matched FROM m""")
def search_matches(spark: SparkSession, d: str) -> DataFrame:
    """One row per match with line and number."""
    return sets_text.text_matches(table(spark, d, "documents"), ["doc_id"], "text", r"https?://[^\s)]+")


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS plain FROM documents WHERE text IS NOT NULL")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    """Text without tags."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", sets_text.strip_html(F.col("text")).alias("plain"))


@query("SELECT k, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events) GROUP BY k")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """A field of JSON text, grouped."""
    rows = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean5, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events")
def sliding_mean(spark: SparkSession, d: str) -> DataFrame:
    """Moving means per user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.round(F.avg("value").over(w.rowsBetween(-4, 0)), 6).alias("mean5"), (F.col("value") - F.lag("value").over(w)).alias("step"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_hours(spark: SparkSession, d: str) -> DataFrame:
    """Events in windows of an hour."""
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("bucket"), "event_type", "n", "total")


@query()
def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 100 rows (a sampling operator)."""
    return tables.sample_rows(table(spark, d, "orders"), 100, ["o_orderkey"])


@query()
def sampled_with_replacement(spark: SparkSession, d: str) -> DataFrame:
    """A seeded bootstrap: as many draws as there are rows."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return tables.sample_with_replacement(rows, rows.count(), ["o_orderkey"])
