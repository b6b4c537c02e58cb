"""Hypothesis tests and regression: one pass of sums in Spark, tails on the few resulting rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.exprs import is_missing, number
from strandloom.functions.special import chi2_p, f_p, fisher_p, normal_p, t_p
from strandloom.operators.plotdata import bounded_grid
from strandloom.operators.profile import ranked_values
from strandloom.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _one(df: DataFrame) -> DataFrame:
    """A one-row table with a constant key, to put one-row tables beside each other."""
    return df.withColumn("_one", F.lit(1))


def numeric_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """(g, x) of the rows with a group and a number."""
    return df.where(~is_missing(F.col(group))).select(F.col(group).cast("string").alias("g"), number(df, value).alias("x")).where("x IS NOT NULL")


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"), F.sum("x").alias("sum"))


def _rounded(df: DataFrame, keep: Sequence[str] = ("p", "p_adjusted"), digits: int = 6) -> DataFrame:
    """Rounds the figures; p stays whole, since small ones would become 0."""
    kinds = dict(df.dtypes)
    return df.select(*(F.round(c, digits).alias(c) if kinds[c] == "double" and c not in keep else F.col(c) for c in df.columns))


def t_test(df: DataFrame, group: str, value: str, a: str, b: str, welch: bool = True) -> DataFrame:
    """Two-group t test (Welch or pooled): n, means, difference a - b, t, df, two-sided p."""
    m = _moments(numeric_groups(df, group, value)).where(F.col("g").isin(a, b))
    pick = lambda c, g: F.max(F.when(F.col("g") == g, F.col(c)))
    r = m.agg(*(pick(c, g).alias(f"{c}_{s}") for c in ("n", "mean", "var") for g, s in ((a, "a"), (b, "b"))))
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    if welch:
        se = F.sqrt(va + vb)
        free = F.pow(va + vb, F.lit(2)) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    else:
        free = (F.col("n_a") + F.col("n_b") - 2).cast("double")
        pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / free
        se = F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))
    r = r.select("n_a", "n_b", "mean_a", "mean_b", (F.col("mean_a") - F.col("mean_b")).alias("difference"), ((F.col("mean_a") - F.col("mean_b")) / F.when(se > 0, se)).alias("t"), free.alias("df"))
    return _rounded(r.withColumn("p", t_p("t", "df")))


def adjusted(p: DataFrame, column: str = "p", method: str = "holm", order: Sequence[str] = ()) -> DataFrame:
    """Adds ``p_adjusted``: none, bonferroni or holm (step-down). For the short tables of tests."""
    n = F.count(column).over(Window.partitionBy())
    if method == "none":
        return p.withColumn("p_adjusted", F.col(column))
    if method == "bonferroni":
        return p.withColumn("p_adjusted", F.least(F.lit(1.0), F.col(column) * n))
    w = Window.orderBy(F.col(column).asc_nulls_last(), *order)
    step = F.least(F.lit(1.0), F.col(column) * (n - F.row_number().over(w) + 1))
    return p.withColumn("_step", step).withColumn("p_adjusted", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def pairwise_t_tests(df: DataFrame, group: str, value: str, method: str = "holm", most: int = 30) -> DataFrame:
    """Welch tests of all pairs of groups with adjusted p. Groups, not rows, are paired; more than ``most`` groups are an error."""
    m = written(_moments(numeric_groups(df, group, value)).drop("sum"))
    if m.count() > most:
        raise ValueError(f"{group} has more than {most} groups")
    left, right = (m.select(*(F.col(c).alias(f"{c}_{s}") for c in m.columns)) for s in ("a", "b"))
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    se = F.sqrt(va + vb)
    pairs = left.join(right, F.col("g_a") < F.col("g_b")).select(
        "g_a", "g_b", ((F.col("mean_a") - F.col("mean_b")) / F.when(se > 0, se)).alias("t"), (F.pow(va + vb, F.lit(2)) / (va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))).alias("df")
    )
    return _rounded(adjusted(pairs.withColumn("p", t_p("t", "df")), "p", method, ["g_a", "g_b"]))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance: groups, n, sums of squares, F, df, p, eta squared."""
    m = _moments(numeric_groups(df, group, value))
    all_ = m.agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum("sum") / F.sum("n")).alias("grand"))
    r = _one(m).join(_one(all_.withColumnRenamed("n", "total")), "_one").groupBy("total", "k").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2))).alias("ss_between"), F.sum(F.coalesce(F.col("var"), F.lit(0.0)) * (F.col("n") - 1)).alias("ss_within")
    )
    d1, d2 = F.col("k") - 1, F.col("total") - F.col("k")
    r = r.select(F.col("k").alias("n_groups"), F.col("total").alias("n"), "ss_between", "ss_within", d1.alias("df_between"), d2.alias("df_within"),
                 (F.col("ss_between") / d1 / F.when(F.col("ss_within") > 0, F.col("ss_within") / d2)).alias("f"), (F.col("ss_between") / (F.col("ss_between") + F.col("ss_within"))).alias("eta_squared"))
    return _rounded(r.withColumn("p", f_p("f", F.col("df_between").cast("double"), F.col("df_within").cast("double"))), digits=4)


def _tied() -> Column:
    """What each row of a tie of t rows adds to the tie correction."""
    return F.pow(F.col("r_ties").cast("double"), F.lit(2)) - 1


def _ranked_cells(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows of ``columns`` (with x) and their number ``c``, with the average rank ``r`` of x among all rows and the size of its tie."""
    cells = written(rows.groupBy(*columns).agg(F.count("*").alias("c")))
    return cells.join(ranked_values(cells, "x", "c", "r"), "x")


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, df and p."""
    ranked = _ranked_cells(numeric_groups(df, group, value), ["g", "x"])
    groups = ranked.groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("r") * F.col("c")).alias("r"), F.sum(_tied() * F.col("c")).alias("ties"))
    s = groups.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.pow("r", F.lit(2)) / F.col("n")).alias("q"), F.sum("ties").alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.when(F.col("ties") < n * n * n - n, 1 - F.col("ties") / (n * n * n - n))
    return _rounded(s.select("n", F.col("k").alias("n_groups"), h.alias("h"), (F.col("k") - 1).alias("df")).withColumn("p", chi2_p("h", F.col("df").cast("double"))), digits=4)


def mann_whitney(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """Mann-Whitney U (the smaller one), z with tie and continuity correction, two-sided p."""
    rows = numeric_groups(df, group, value).where(F.col("g").isin(a, b))
    ranked = _ranked_cells(rows, ["g", "x"])
    first, count = F.col("g") == a, lambda c: F.coalesce(F.sum(F.when(c, F.col("c"))), F.lit(0).cast("long"))
    s = ranked.agg(count(first).alias("n_a"), count(~first).alias("n_b"), F.sum(F.when(first, F.col("r") * F.col("c"))).alias("r_a"), F.sum(_tied() * F.col("c")).alias("ties"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    ua = F.col("r_a") - na * (na + 1) / 2
    u, n = F.least(ua, na * nb - ua), na + nb
    var = na * nb / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    gap = ua - na * nb / 2
    z = F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)) / F.when(var > 0, F.sqrt(var))
    return _rounded(s.select("n_a", "n_b", u.alias("u"), z.alias("z")).withColumn("p", normal_p("z")))


def paired_t_test(df: DataFrame, first: str, second: str) -> DataFrame:
    """Paired t test of second - first: n, mean difference, t, df, p."""
    d = df.select((number(df, second) - number(df, first)).alias("d")).where("d IS NOT NULL")
    s = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("sd"))
    t = F.col("mean_difference") / F.when(F.col("sd") > 0, F.col("sd") / F.sqrt("n"))
    return _rounded(s.select("n", "mean_difference", "sd", t.alias("t"), (F.col("n") - 1).alias("df")).withColumn("p", t_p("t", F.col("df").cast("double"))))


def wilcoxon(df: DataFrame, first: str, second: str) -> DataFrame:
    """Wilcoxon signed-rank test of second - first: zero differences drop out; z with tie and continuity correction, p."""
    d = df.select((number(df, second) - number(df, first)).alias("d")).where("d IS NOT NULL AND d <> 0").withColumn("x", F.abs("d"))
    ranked = _ranked_cells(d, ["d", "x"])
    side = lambda c: F.sum(F.when(c, F.col("r") * F.col("c")).otherwise(0.0))
    s = ranked.agg(F.coalesce(F.sum("c"), F.lit(0).cast("long")).alias("n"), side(F.col("d") > 0).alias("w_plus"), side(F.col("d") < 0).alias("w_minus"), F.sum(_tied() * F.col("c")).alias("ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    gap = F.col("w_plus") - n * (n + 1) / 4
    z = F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)) / F.when(var > 0, F.sqrt(var))
    return _rounded(s.select("n", "w_plus", "w_minus", z.alias("z")).withColumn("p", normal_p("z")), digits=4)


def chi_square(df: DataFrame, row: str, column: str, weight: Column | None = None) -> DataFrame:
    """Expected counts and contributions per cell of a contingency table, with the test's chi2, df and p on every row.

    All combinations of the seen rows and columns appear, 100,000 at most; ``weight`` sums counts instead of rows.
    """
    counted = (F.sum(weight) if weight is not None else F.count("*")).alias("observed")
    cells = written(df.where(~is_missing(F.col(row)) & ~is_missing(F.col(column))).groupBy(F.col(row).cast("string").alias("r"), F.col(column).cast("string").alias("c")).agg(counted))
    rows = cells.groupBy("r").agg(F.sum("observed").alias("row_total"))
    columns = cells.groupBy("c").agg(F.sum("observed").alias("column_total"))
    grid = bounded_grid(cells, "r", "c").join(rows, "r").join(columns, "c").join(cells, ["r", "c"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    whole = _one(rows.agg(F.sum("row_total").alias("total"), F.count("*").alias("n_rows")))
    sides = whole.join(_one(columns.agg(F.count("*").alias("n_columns"))), "_one")
    g = _one(grid).join(sides, "_one").withColumn("expected", F.col("row_total") * F.col("column_total") / F.col("total"))  # beside one row
    g = g.withColumn("contribution", F.pow(F.col("observed") - F.col("expected"), F.lit(2)) / F.when(F.col("expected") > 0, F.col("expected")))
    g = g.withColumn("df", ((F.col("n_rows") - 1) * (F.col("n_columns") - 1)).cast("int")).drop("_one")
    test = g.agg(F.sum("contribution").alias("chi2"))
    out = _one(g).join(_one(test), "_one").select("r", "c", "observed", "expected", "contribution", "chi2", "df")
    return _rounded(out.withColumn("p", chi2_p("chi2", F.col("df").cast("double"))), digits=4)


def fisher_exact(df: DataFrame, row: Column, column: Column) -> DataFrame:
    """Fisher's exact test of two Boolean columns: the four counts, the odds ratio and the two-sided p."""
    s = df.agg(*(F.count_if(row.eqNullSafe(F.lit(x)) & column.eqNullSafe(F.lit(y))).alias(n) for n, x, y in (("a", True, True), ("b", True, False), ("c", False, True), ("d", False, False))))
    odds = F.col("a") * F.col("d") / F.when(F.col("b") * F.col("c") > 0, F.col("b") * F.col("c"))
    return _rounded(s.select("a", "b", "c", "d", odds.alias("odds_ratio")).withColumn("p", fisher_p("a", "b", "c", "d")))


def linear_regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line of y on x: n, slope, intercept, R squared, standard error and t of the slope, df, p."""
    rows = df.select(number(df, y).alias("y"), number(df, x).alias("x")).dropna()
    s = rows.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r_squared"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"))
    free = (F.col("n") - 2).cast("double")
    se = F.sqrt((1 - F.col("r_squared")) * F.col("syy") / free / F.when(F.col("sxx") > 0, F.col("sxx")))
    t = F.col("slope") / F.when(se > 0, se)
    return _rounded(s.select("n", "slope", "intercept", "r_squared", se.alias("slope_se"), t.alias("t"), (F.col("n") - 2).alias("df")).withColumn("p", t_p("t", F.col("df").cast("double"))), digits=4)


def multiple_regression(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares of y on several predictors: one row per term with coefficient, standard error, t and p, and the fit's n and R squared.

    The products of all columns, (k + 2)**2 / 2 sums, are one pass; only they reach the driver.
    """
    names = ["intercept", *xs]
    rows = df.select(number(df, y).alias("_y"), *(number(df, x).alias(x) for x in xs)).dropna()
    cols = [F.lit(1.0), *(F.col(x) for x in xs), F.col("_y")]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = rows.agg(*(F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i, j in pairs)).first()
    m = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        m[i, j] = m[j, i] = sums[f"s{i}_{j}"] or 0.0
    xtx, xty, yty, n, k = m[:-1, :-1], m[:-1, -1], m[-1, -1], m[0, 0], len(names)
    inverse = np.linalg.pinv(xtx)
    beta = inverse @ xty
    rss = max(0.0, yty - beta @ xty)
    tss = yty - m[0, -1] ** 2 / n if n else 0.0
    free = n - k
    se = np.sqrt(np.maximum(np.diag(inverse), 0) * rss / free) if free > 0 else np.full(k, np.nan)
    out = [(names[i], float(beta[i]), float(se[i]), float(beta[i] / se[i]) if se[i] > 0 else None, int(n), float(1 - rss / tss) if tss > 0 else None, float(free)) for i in range(k)]
    table = df.sparkSession.createDataFrame(out, "term string, coefficient double, se double, t double, n bigint, r_squared double, df double")
    return _rounded(table.withColumn("p", t_p("t", "df")).drop("df"))


def principal_components(df: DataFrame, columns: Sequence[Column], ids: Sequence[str], count: int = 2, scale: bool = True) -> DataFrame:
    """The first principal components of every row: ids, pc1, pc2 …

    Sample covariance of the centred (and scaled) columns in one pass, its
    eigenvectors on the driver (columns x columns numbers), scores as expressions.
    Each component is turned so that its largest loading is positive; columns
    without variance drop out when scaling; rows with a null are left out.
    """
    names = [f"_v{i}" for i in range(len(columns))]
    rows = df.select(*ids, *(c.cast("double").alias(n) for c, n in zip(columns, names, strict=True))).dropna(subset=names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    figures = rows.agg(*(F.avg(n).alias(f"m{n}") for n in names), *(F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in pairs)).first()
    cov = np.array([[figures[f"c{min(a, b, key=names.index)}{max(a, b, key=names.index)}"] or 0.0 for b in names] for a in names])
    sd = np.sqrt(np.diag(cov))
    used = [i for i in range(len(names)) if not scale or sd[i] > 0]
    if scale:
        cov = cov[np.ix_(used, used)] / np.outer(sd[used], sd[used])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:count]
    scores = []
    for k, o in enumerate(order):
        v = vectors[:, o]
        v = v if v[np.argmax(np.abs(v))] >= 0 else -v
        terms = [(F.col(names[i]) - F.lit(figures[f"m{names[i]}"])) * F.lit(float(v[j] / (sd[i] if scale else 1))) for j, i in enumerate(used)]
        scores.append(F.round(sum(terms[1:], terms[0]), 6).alias(f"pc{k + 1}"))
    return rows.select(*ids, *scores)


#: Arrangements up to which the permutation test enumerates all of them, and the most random draws, as in the reference.
MOST_EXACT, MOST_DRAWS = 10_000, 100_000


def _exact_permutations(values: np.ndarray, n_a: int) -> np.ndarray:
    """Differences of the means of all arrangements of ``values``, whose first ``n_a`` are group a."""
    n = len(values)
    small = min(n_a, n - n_a)
    sums = np.array([values[list(chosen)].sum() for chosen in combinations(range(n), small)])
    if small < n_a:
        sums = values.sum() - sums
    return sums / n_a - (values.sum() - sums) / (n - n_a)


def permutation_test(df: DataFrame, group: str, value: str, a: str, b: str, key: Sequence[str], draws: int = 5000, seed: int = 1) -> DataFrame:
    """Two-group permutation test of the difference of means: difference, draws, extreme, p (two-sided); no rows if a group is empty.

    Up to ``MOST_EXACT`` arrangements are all enumerated and p = extreme / draws; else
    ``draws`` seeded relabellings that keep both group sizes give p = (extreme + 1) / (draws + 1).
    Rows fall into buckets by a hash of ``key``; per draw, group a is divided among the
    buckets as sampling without replacement does (multivariate hypergeometric), and each
    bucket chooses its part at random, so every arrangement is equally likely. Tasks
    add their buckets' sums per draw. A bucket is held by one task; there are 1,024 at most. Below a billion rows.
    """
    draws = max(1, min(MOST_DRAWS, draws))
    side = F.col(group).cast("string")
    rows = df.where(side.isin(a, b)).select(side.alias("g"), number(df, value).alias("x"), F.xxhash64(F.lit(seed), *key).alias("_id")).where("x IS NOT NULL")
    m = rows.agg(F.count_if(F.col("g") == a).alias("n_a"), F.count("*").alias("n"), F.avg(F.when(F.col("g") == a, F.col("x"))).alias("mean_a"), F.avg(F.when(F.col("g") == b, F.col("x"))).alias("mean_b"), F.avg("x").alias("mean"), F.avg(F.abs("x")).alias("size")).first()
    spark, schema = df.sparkSession, "difference double, draws int, extreme bigint, p double"
    n_a, n = m["n_a"], m["n"]
    if not n_a or n_a == n:
        return spark.createDataFrame([], schema)
    observed = m["mean_a"] - m["mean_b"]
    # sums in another order differ in the last places
    limit = abs(observed) - 1e-12 - 1e-11 * m["size"]
    if n <= MOST_EXACT and comb(n, n_a) <= MOST_EXACT:
        values = np.array([r["x"] for r in rows.orderBy(F.col("g") != a, "_id", "x").select("x").collect()])
        nulls = _exact_permutations(values, n_a)
        extreme = int((np.abs(nulls) >= limit).sum())
        return spark.createDataFrame([(round(observed, 6), len(nulls), extreme, round(extreme / len(nulls), 6))], schema)
    buckets = max(1, min(1024, n // 4096, 8_000_000 // draws))
    placed = rows.select(F.pmod("_id", F.lit(buckets)).cast("int").alias("bucket"), "_id", (F.col("x") - F.lit(m["mean"])).alias("x"))
    sizes = np.zeros(buckets, dtype=np.int64)
    for r in placed.groupBy("bucket").agg(F.count("*").alias("n")).collect():
        sizes[r["bucket"]] = r["n"]
    parts = np.random.default_rng([seed]).multivariate_hypergeometric(sizes, n_a, size=draws, method="marginals").astype(np.int32)
    shared = spark.sparkContext.broadcast(parts)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, used = np.zeros(draws), False
        for batch in batches:
            for bucket, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x, rng, used = cell.values.field("x").to_numpy(zero_copy_only=False).copy(), np.random.default_rng([seed, bucket]), True
                for k, count in enumerate(shared.value[:, bucket]):
                    rng.shuffle(x)
                    sums[k] += x[:count].sum()
        if used:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws, dtype=np.int32)), pa.array(sums)], names=["draw", "sum"])

    tasks = min(buckets, 4 * spark.sparkContext.defaultParallelism)
    held = placed.repartition(tasks, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("_id", "x"))).alias("xs"))
    each = held.mapInArrow(draw, "draw int, sum double").groupBy("draw").agg(F.sum("sum").alias("s"))
    # centred values add up to nothing, so group b has -s
    diff = F.abs(F.col("s") / n_a + F.col("s") / (n - n_a))
    done = each.agg(F.count_if(diff >= limit).alias("extreme"))
    return done.select(F.round(F.lit(observed), 6).alias("difference"), F.lit(draws).alias("draws"), "extreme", F.round((F.col("extreme") + 1) / (draws + 1), 6).alias("p"))


#: Cells of a two-way table that may reach the driver.
MOST_CELLS = 100_000


def two_way_anova(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Two-way analysis of variance with interaction, sequential (type I) in the order a, b, a x b: term, ss, df, f, p.

    Count, sum and sum of squares of each cell are one aggregation; the cells, at
    most ``MOST_CELLS``, go to the driver, where nested models are fitted to them.
    No rows for an empty table.
    """
    rows = df.where(~is_missing(F.col(a)) & ~is_missing(F.col(b))).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), number(df, value).alias("x")).where("x IS NOT NULL")
    cells = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("v")).limit(MOST_CELLS + 1).toPandas()
    if len(cells) > MOST_CELLS:
        raise ValueError(f"{a} and {b} have more than {MOST_CELLS} cells")
    schema = "term string, ss double, df bigint, f double"
    if cells.empty:
        return df.sparkSession.createDataFrame([], schema).withColumn("p", F.lit(None).cast("double"))
    n, m = cells["n"].to_numpy(float), cells["m"].to_numpy(float)
    root = np.sqrt(n)
    dummies = lambda c: (cells[c].to_numpy()[:, None] == np.array(sorted(set(cells[c])))[None, 1:]).astype(float)
    one, da, db = np.ones((len(cells), 1)), dummies("a"), dummies("b")
    within = float((cells["v"].to_numpy() * (n - 1)).sum())

    def fit(design: np.ndarray) -> tuple[float, int]:
        beta, _, rank, _ = np.linalg.lstsq(design * root[:, None], m * root, rcond=None)
        return float((n * (m - design @ beta) ** 2).sum()), int(rank)

    fits = [fit(one), fit(np.hstack([one, da])), fit(np.hstack([one, da, db])), (0.0, len(cells))]
    free = int(n.sum()) - len(cells)
    noise = within / free if free > 0 else 0.0
    out = []
    for term, (r0, k0), (r1, k1) in zip((a, b, f"{a} x {b}"), fits, fits[1:], strict=False):
        out.append((term, r0 - r1, k1 - k0, (r0 - r1) / (k1 - k0) / noise if k1 > k0 and noise > 0 else None))
    out.append(("residual", within, free, None))
    table = df.sparkSession.createDataFrame(out, schema)
    return _rounded(table.withColumn("p", f_p("f", F.col("df").cast("double"), F.lit(float(free)))), digits=4)


def repeated_measures_anova(df: DataFrame, subject: str, condition: str, value: str) -> DataFrame:
    """One-way repeated measures: n_subjects, n_conditions, f, df_condition, df_error, p. Repeated cells are averaged; subjects lacking a condition drop out."""
    rows = df.where(~is_missing(F.col(subject)) & ~is_missing(F.col(condition))).select(F.col(subject).alias("s"), F.col(condition).alias("c"), number(df, value).alias("x")).where("x IS NOT NULL")
    cells = rows.groupBy("s", "c").agg(F.avg("x").alias("x"))
    k = cells.select("c").distinct().count()
    whole = cells.groupBy("s").agg(F.count("*").alias("k"), F.avg("x").alias("ms")).where(F.col("k") == k).select("s", "ms")
    used = cells.join(whole, "s")
    per = used.groupBy("c").agg(F.avg("x").alias("mc"), F.count("*").alias("n"), F.sum("x").alias("sum"), F.sum(F.pow(F.col("x") - F.col("ms"), F.lit(2))).alias("inner"))
    all_ = per.agg(F.max("n").alias("n"), (F.sum("sum") / F.sum("n")).alias("grand"), F.sum("inner").alias("inner"))
    # sum of squares inside subjects = conditions + error
    both = _one(per.select("mc")).join(_one(all_), "_one").groupBy("n", "inner").agg(F.sum(F.col("n") * F.pow(F.col("mc") - F.col("grand"), F.lit(2))).alias("ssc"))
    d1, d2 = F.lit(k - 1), (F.col("n") - 1) * (k - 1)
    error = F.col("inner") - F.col("ssc")
    f = F.col("ssc") / F.when(d1 > 0, d1) / F.when(error > 1e-12, error / d2)
    return _rounded(both.select(F.col("n").alias("n_subjects"), F.lit(k).cast("long").alias("n_conditions"), f.alias("f"), d1.cast("long").alias("df_condition"), d2.cast("long").alias("df_error")).withColumn("p", f_p("f", F.col("df_condition").cast("double"), F.col("df_error").cast("double"))), digits=4)
