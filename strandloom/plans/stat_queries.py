"""Queries of hypothesis tests, regression and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import stats
from strandloom.plans.registry import Registry
from strandloom.session import table

registry = Registry()
query = registry.query

_TWO = "SELECT count(*) FILTER (event_type = 'click') AS n_a, count(*) FILTER (event_type = 'view') AS n_b, avg(value) FILTER (event_type = 'click') AS ma, avg(value) FILTER (event_type = 'view') AS mb, var_samp(value) FILTER (event_type = 'click') AS va, var_samp(value) FILTER (event_type = 'view') AS vb FROM events"


@query(f"WITH s AS ({_TWO}) SELECT n_a, n_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(ma - mb, 6) AS difference, round((ma - mb) / sqrt(va / n_a + vb / n_b), 6) AS t, round(pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)), 6) AS df FROM s")
def welch_stats(spark: SparkSession, d: str) -> DataFrame:
    """Welch's t of two event types."""
    return stats.t_test(table(spark, d, "events"), "event_type", "value", "click", "view").drop("p")


@query()
def welch_test(spark: SparkSession, d: str) -> DataFrame:
    """The same with its p."""
    return stats.t_test(table(spark, d, "events"), "event_type", "value", "click", "view")


@query(f"WITH s AS ({_TWO}) SELECT n_a, n_b, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(ma - mb, 6) AS difference, round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)), 6) AS t, CAST(n_a + n_b - 2 AS DOUBLE) AS df FROM s")
def student_stats(spark: SparkSession, d: str) -> DataFrame:
    """Student's t with pooled variance."""
    return stats.t_test(table(spark, d, "events"), "event_type", "value", "click", "view", welch=False).drop("p")


@query("""WITH m AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT a.g AS g_a, b.g AS g_b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 6) AS df FROM m a JOIN m b ON a.g < b.g""")
def posthoc_stats(spark: SparkSession, d: str) -> DataFrame:
    """Welch's t of all pairs of event types."""
    return stats.pairwise_t_tests(table(spark, d, "events"), "event_type", "value").drop("p", "p_adjusted")


@query()
def posthoc_holm(spark: SparkSession, d: str) -> DataFrame:
    """The same with p and Holm's correction."""
    return stats.pairwise_t_tests(table(spark, d, "events"), "event_type", "value")


@query("""WITH g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), a AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS grand FROM g),
s AS (SELECT any_value(a.n) AS n, any_value(k) AS k, sum(g.n * pow(m - grand, 2)) AS b, sum(v * (g.n - 1)) AS w FROM g, a)
SELECT k AS n_groups, CAST(n AS BIGINT) AS n, CAST(k - 1 AS BIGINT) AS df_between, CAST(n - k AS BIGINT) AS df_within, round(b / (k - 1) / (w / (n - k)), 4) AS f, round(b / (b + w), 4) AS eta_squared FROM s""")
def anova_oneway(spark: SparkSession, d: str) -> DataFrame:
    """One-way analysis of variance."""
    return stats.anova(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").drop("p", "ss_between", "ss_within")


@query()
def anova_test(spark: SparkSession, d: str) -> DataFrame:
    """The same with sums of squares and p."""
    return stats.anova(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


_RANKED = "SELECT {g} AS g, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2 AS r, count(*) OVER (PARTITION BY {x}) AS t FROM {f}"


@query("WITH r AS (" + _RANKED.format(g="status", x="mapq", f="sam_alignments WHERE mapq IS NOT NULL") + """), g AS (SELECT g, count(*) AS n, sum(r) AS s, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY g), a AS (SELECT CAST(sum(n) AS DOUBLE) AS n, count(*) AS k, sum(s * s / n) AS q, sum(ties) AS ties FROM g)
SELECT CAST(n AS BIGINT) AS n, k AS n_groups, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h, CAST(k - 1 AS BIGINT) AS df FROM a""")
def kruskal_stats(spark: SparkSession, d: str) -> DataFrame:
    """Kruskal-Wallis H of mapq by status."""
    return stats.kruskal_wallis(table(spark, d, "sam_alignments"), "status", "mapq").drop("p")


@query("WITH r AS (" + _RANKED.format(g="status", x="mapq", f="sam_alignments WHERE mapq IS NOT NULL AND status IN ('mapped', 'duplicate')") + """), a AS (SELECT count(*) FILTER (g = 'mapped') AS n_a, count(*) FILTER (g = 'duplicate') AS n_b, sum(r) FILTER (g = 'mapped') AS ra, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r),
u AS (SELECT n_a, n_b, CAST(n_a AS DOUBLE) * n_b AS m, ra - CAST(n_a AS DOUBLE) * (n_a + 1) / 2 AS ua, ties, CAST(n_a + n_b AS DOUBLE) AS n FROM a)
SELECT n_a, n_b, round(least(ua, m - ua), 6) AS u, round(sign(ua - m / 2) * greatest(abs(ua - m / 2) - 0.5, 0) / sqrt(m / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM u""")
def mwu_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mann-Whitney U of mapq by status."""
    return stats.mann_whitney(table(spark, d, "sam_alignments"), "status", "mapq", "mapped", "duplicate").drop("p")


@query("WITH x AS (SELECT CAST(max AS DOUBLE) - CAST(q3 AS DOUBLE) AS d FROM box_summary WHERE max IS NOT NULL AND q3 IS NOT NULL) SELECT count(*) AS n, round(avg(d), 6) AS mean_difference, round(stddev_samp(d), 6) AS sd, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, CAST(count(*) - 1 AS BIGINT) AS df FROM x")
def paired_t_stats(spark: SparkSession, d: str) -> DataFrame:
    """Paired t of the upper quartile and the maximum."""
    return stats.paired_t_test(table(spark, d, "box_summary"), "q3", "max").drop("p")


@query("""WITH x AS (SELECT l_tax - l_discount AS d FROM lineitem WHERE l_tax - l_discount <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM x),
a AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS p, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS m, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r)
SELECT CAST(n AS BIGINT) AS n, round(p, 4) AS w_plus, round(m, 4) AS w_minus, round(sign(p - n * (n + 1) / 4) * greatest(abs(p - n * (n + 1) / 4) - 0.5, 0) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 4) AS z FROM a""")
def wilcoxon_stats(spark: SparkSession, d: str) -> DataFrame:
    """Wilcoxon signed ranks of tax and discount."""
    return stats.wilcoxon(table(spark, d, "lineitem"), "l_discount", "l_tax").drop("p")


@query("""WITH c AS (SELECT l_returnflag AS r, CAST(l_linenumber AS VARCHAR) AS c, count(*) AS o FROM lineitem GROUP BY ALL), x AS (SELECT r, c FROM (SELECT DISTINCT r FROM c) CROSS JOIN (SELECT DISTINCT c FROM c)),
e AS (SELECT r, c, coalesce(o, 0) AS observed, sum(coalesce(o, 0)) OVER (PARTITION BY r) * sum(coalesce(o, 0)) OVER (PARTITION BY c) / sum(coalesce(o, 0)) OVER () AS expected FROM x LEFT JOIN c USING (r, c))
SELECT r, c, observed, round(expected, 4) AS expected, round(pow(observed - expected, 2) / expected, 4) AS contribution, round(sum(pow(observed - expected, 2) / expected) OVER (), 4) AS chi2, CAST(((SELECT count(DISTINCT r) FROM c) - 1) * ((SELECT count(DISTINCT c) FROM c) - 1) AS INTEGER) AS df FROM e""")
def chi2_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chi-square test of two categories."""
    return stats.chi_square(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber").drop("p")


@query("SELECT count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS a, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') AS b, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS c, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'F') AS d FROM lineitem")
def fisher_counts(spark: SparkSession, d: str) -> DataFrame:
    """The four counts of Fisher's exact test."""
    return stats.fisher_exact(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "F").select("a", "b", "c", "d")


@query()
def fisher_test(spark: SparkSession, d: str) -> DataFrame:
    """Fisher's exact test."""
    return stats.fisher_exact(table(spark, d, "lineitem"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "F")


@query("""WITH s AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem))
SELECT n, round(b, 4) AS slope, round(a, 4) AS intercept, round(r2, 4) AS r_squared, round(sqrt((1 - r2) * syy / (n - 2) / sxx), 4) AS slope_se, round(b / sqrt((1 - r2) * syy / (n - 2) / sxx), 4) AS t, CAST(n - 2 AS BIGINT) AS df FROM s""")
def ols_simple(spark: SparkSession, d: str) -> DataFrame:
    """A regression line."""
    return stats.linear_regression(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity").drop("p")


@query()
def ols_multiple(spark: SparkSession, d: str) -> DataFrame:
    """Regression on three predictors."""
    return stats.multiple_regression(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@query()
def pca2(spark: SparkSession, d: str) -> DataFrame:
    """Two principal components of line items."""
    rows = table(spark, d, "lineitem")
    return stats.principal_components(rows, [F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")], ["l_orderkey", "l_linenumber", "l_partkey"])


@query()
def permutation(spark: SparkSession, d: str) -> DataFrame:
    """Permutation test of two event types."""
    return stats.permutation_test(table(spark, d, "events"), "event_type", "value", "click", "view", ["event_id"])


@query("""WITH r AS (SELECT l_returnflag AS a, l_linestatus AS b, l_extendedprice AS x FROM lineitem), g AS (SELECT avg(x) AS g FROM r), ma AS (SELECT a, count(*) AS n, avg(x) AS m FROM r GROUP BY a), c AS (SELECT a, b, count(*) AS n, var_samp(x) AS v FROM r GROUP BY a, b)
SELECT round((SELECT sum(n * pow(m - g, 2)) FROM ma, g) / ((SELECT count(*) FROM ma) - 1) / (sum(v * (n - 1)) / (sum(n) - count(*))), 3) AS f_a, CAST(sum(n) - count(*) AS BIGINT) AS df_residual FROM c""")
def anova_twoway_first(spark: SparkSession, d: str) -> DataFrame:
    """The first factor's F of a two-way analysis, which has a closed form."""
    t = stats.two_way_anova(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice")
    return t.agg(F.round(F.max(F.when(F.col("term") == "l_returnflag", F.col("f"))), 3).alias("f_a"), F.max(F.when(F.col("term") == "residual", F.col("df"))).alias("df_residual"))


@query()
def anova_twoway(spark: SparkSession, d: str) -> DataFrame:
    """Two-way analysis of variance."""
    return stats.two_way_anova(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice")


@query("""WITH c AS (SELECT user_id AS s, event_type AS c, avg(value) AS x FROM events WHERE value IS NOT NULL GROUP BY ALL), k AS (SELECT count(DISTINCT c) AS k FROM c), w AS (SELECT s, avg(x) AS ms FROM c GROUP BY s HAVING count(*) = (SELECT k FROM k)), u AS (SELECT * FROM c JOIN w USING (s)),
p AS (SELECT c, avg(x) AS mc, count(*) AS n FROM u GROUP BY c), t AS (SELECT (SELECT k FROM k) AS k, max(n) AS n, (SELECT avg(x) FROM u) AS g, (SELECT sum(pow(x - ms, 2)) FROM u) AS i FROM p), z AS (SELECT any_value(k) AS k, any_value(t.n) AS n, any_value(i) AS i, sum(p.n * pow(mc - g, 2)) AS ss FROM p, t)
SELECT n AS n_subjects, k AS n_conditions, round(ss / (k - 1) / ((i - ss) / ((n - 1) * (k - 1))), 4) AS f, CAST(k - 1 AS BIGINT) AS df_condition, CAST((n - 1) * (k - 1) AS BIGINT) AS df_error FROM z""")
def anova_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Repeated-measures analysis of users over event types."""
    return stats.repeated_measures_anova(table(spark, d, "events"), "user_id", "event_type", "value").drop("p")
