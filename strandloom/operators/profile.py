"""Profiles, descriptive statistics, correlation, comparison and outliers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.exprs import is_missing, number, to_num
from strandloom.functions.special import t_critical
from strandloom.operators.grouping import ordered_totals, spread_join
from strandloom.session import written


#: Rows of a table of counts whose values one aggregation may hold, some 16 bytes each.
MOST_HELD = 1 << 20


def _unpivoted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], list(columns), "column", "cell")


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: type, rows, missing cells, distinct values, and number or length figures.

    Types in order of preference: empty, boolean (true/false/yes/no), integer,
    number, date (YYYY-MM-DD), text. Missing spellings do not take part.
    """
    cells = written(_unpivoted(df, columns).select("column", F.when(~is_missing(F.col("cell")), F.trim("cell")).alias("cell")).groupBy("column", "cell").agg(F.count("*").alias("n")))
    here, x = F.col("cell").isNotNull(), to_num(F.col("cell"))
    all_of = lambda test: F.coalesce(F.bool_and(F.when(here, test)), F.lit(False))
    kind = (
        F.when(F.count("cell") == 0, "empty")
        .when(all_of(F.lower("cell").isin("true", "false", "yes", "no")), "boolean")
        .when(all_of(F.col("cell").rlike(r"^[+-]?\d+$")), "integer")
        .when(all_of(x.isNotNull()), "number")
        .when(all_of(F.col("cell").rlike(r"^\d{4}-\d{2}-\d{2}$")), "date")
        .otherwise("text")
    )
    size, weight = F.length("cell"), F.col("n")
    figures = cells.groupBy("column").agg(
        kind.alias("type"),
        F.sum("n").alias("n_rows"),
        F.sum(F.when(here, 0).otherwise(weight)).alias("n_missing"),
        F.round(F.sum(F.when(here, 0).otherwise(weight)) * 100 / F.sum("n"), 2).alias("missing_percent"),
        F.count("cell").alias("n_distinct"),
        F.min(x).alias("min_number"),
        F.max(x).alias("max_number"),
        F.round(F.sum(x * weight) / F.sum(F.when(x.isNotNull(), weight)), 6).alias("mean_number"),
        F.min(size).cast("long").alias("min_length"),
        F.max(size).cast("long").alias("max_length"),
    )
    counts = cells.select("column", x.alias("x"), F.col("n").alias("c")).where("x IS NOT NULL")
    medians = group_quantiles(counts, ["column"], {"median_number": 0.5})
    return figures.join(medians, "column", "left").withColumn("median_number", F.round("median_number", 6))  # one row per column


def top_values(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` most frequent cells of each column, ties in order of the value: column, rank, cell, count."""
    counts = _unpivoted(df, columns).where(~is_missing(F.col("cell"))).groupBy("column", "cell").agg(F.count("*").alias("n_cells"))
    order = Window.partitionBy("column").orderBy(F.desc("n_cells"), "cell")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def describe(df: DataFrame, columns: Sequence[str], trim: float = 0.1) -> DataFrame:
    """Descriptive statistics per numeric column, over the distinct values with their counts.

    Skewness and excess kurtosis are those of samples (G1, G2); quartiles
    interpolate linearly; the trimmed mean drops floor(n * trim) values at each end;
    ``ci_low`` and ``ci_high`` bound the mean with 95 % confidence (Student's t).
    Quartiles and trimmed mean come from running counts over range partitions, so a
    column of any number of distinct values is spread.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), number(df, c).alias("x")) for c in columns)))
    values = ordered_totals(df.select(each.alias("e")).select("e.*").where("x IS NOT NULL").groupBy("column", "x").agg(F.count("*").alias("c")), ["column", "x"], ["c"])
    means = values.groupBy("column").agg(F.sum("c").alias("n"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"), F.min(F.col("c_upto") - F.col("c")).alias("base"))
    centred = values.join(F.broadcast(means), "column").withColumns({"d": F.col("x") - F.col("mean"), "upto": F.col("c_upto") - F.col("base")})  # one row per column
    cut = F.floor(F.col("n") * trim)
    kept = F.greatest(F.lit(0).cast("long"), F.least(F.col("upto"), F.col("n") - cut) - F.greatest(F.col("upto") - F.col("c"), cut))
    power = lambda k: F.sum(F.pow("d", F.lit(k)) * F.col("c"))
    sums = centred.groupBy("column").agg(
        F.max("n").alias("n"), F.max("mean").alias("mean"), power(2).alias("m2"), power(3).alias("m3"), power(4).alias("m4"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.sum(F.col("x") * F.col("c")).alias("sum"), *(quantile_at(p).alias(name) for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))), (F.sum(F.col("x") * kept) / F.sum(kept)).alias("trimmed_mean"),
        F.max(F.struct("c", -F.col("x"))).alias("often"),
    )
    n, var = F.col("n"), F.col("m2") / F.when(F.col("n") > 1, F.col("n") - 1)
    sd = F.sqrt(var)
    skew = F.when((n > 2) & (F.col("m2") > 0), F.sqrt(n * (n - 1)) / (n - 2) * (F.col("m3") / n) / F.pow(F.col("m2") / n, F.lit(1.5)))
    kurt = F.when((n > 3) & (F.col("m2") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * F.col("m4") / F.pow("m2", F.lit(2)) - 3) + 6))
    reach = t_critical(F.lit(0.95), (n - 1).cast("double")) * sd / F.sqrt(n)
    figures = {
        "sum": F.col("sum"), "mean": F.col("mean"), "median": F.col("median"), "min": F.col("min"), "max": F.col("max"), "range": F.col("max") - F.col("min"), "q1": F.col("q1"), "q3": F.col("q3"),
        "iqr": F.col("q3") - F.col("q1"), "variance": var, "sd": sd, "se": sd / F.sqrt(n), "ci_low": F.col("mean") - reach, "ci_high": F.col("mean") + reach, "cv_percent": F.when(F.col("mean") != 0, sd / F.abs("mean") * 100), "trimmed_mean": F.col("trimmed_mean"),
        "skewness": skew, "kurtosis": kurt, "mode": -F.col("often.col2"),
    }
    return sums.select("column", "n", *(F.round(c, 4).alias(k) for k, c in figures.items()), F.col("often.c").alias("mode_count"))


def quantile_at(p: float, x: str = "x", upto: str = "upto", c: str = "c", n: str = "n") -> Column:
    """Aggregate: the linearly interpolated quantile of values ``x`` that stand ``c`` times, up to place ``upto`` of ``n``."""
    place = (F.col(n) - 1) * F.lit(p)
    low, high = F.floor(place), F.ceil(place)
    holds = lambda k: (F.col(upto) > k) & (F.col(upto) - F.col(c) <= k)
    below, above = F.max(F.when(holds(low), F.col(x))), F.max(F.when(holds(high), F.col(x)))
    return below + (above - below) * F.max(place - low)


def group_quantiles(counts: DataFrame, groups: Sequence[str], wanted: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group of a written table of counts (groups, x, c): groups, and one column each.

    Up to ``MOST_HELD`` rows of counts, an aggregation holds the values of a group. Beyond
    that, places come from running counts over range partitions, so no task holds them,
    with the same result. Null groups drop out.
    """
    known = counts.dropna(subset=list(groups)) if groups else counts
    if known.count() <= MOST_HELD:
        return known.groupBy(*groups).agg(*(F.percentile("x", p, F.col("c")).alias(name) for name, p in wanted.items()))
    placed = ordered_totals(known, [*groups, "x"], ["c"])
    ends = placed.groupBy(*groups).agg(F.min(F.col("c_upto") - F.col("c")).alias("base"), F.sum("c").alias("n"))
    met = spread_join(placed, ends, groups, F.pmod(F.xxhash64("x"), F.lit(64))).withColumn("upto", F.col("c_upto") - F.col("base"))
    return met.groupBy(*groups).agg(*(quantile_at(p).alias(name) for name, p in wanted.items()))


def ranked_values(cells: DataFrame, value: str, count: str, rank: str) -> DataFrame:
    """Distinct values of a table of counts: value, ``rank`` (the average one, ties share it), ``<rank>_ties`` (rows of the value), and ``<rank>_below`` (rows before it)."""
    counted = ordered_totals(cells.groupBy(value).agg(F.sum(count).alias("_n")), [value], ["_n"])
    return counted.select(value, (F.col("_n_upto") - (F.col("_n") - 1) / 2).alias(rank), F.col("_n").alias(f"{rank}_ties"), (F.col("_n_upto") - F.col("_n")).alias(f"{rank}_below"))


def average_ranks(df: DataFrame, groups: Sequence[str], value: str, rank: str) -> DataFrame:
    """Adds the average rank (ties share one) of a numeric column within groups, and ``<rank>_ties``, the size of the tie.

    Counted over distinct values in range partitions, so no group passes through one
    task; the rows of a frequent value are spread when they take their rank back.
    """
    counted = ordered_totals(df.groupBy(*groups, value).agg(F.count("*").alias("_n")), [*groups, value], ["_n"])
    if groups:
        starts = counted.groupBy(*groups).agg(F.min(F.col("_n_upto") - F.col("_n")).alias("_base"))
        counted = spread_join(counted, starts, groups, F.pmod(F.xxhash64(value), F.lit(64)))
    else:
        counted = counted.withColumn("_base", F.lit(0))
    ranked = counted.select(*groups, value, (F.col("_n_upto") - F.col("_base") - (F.col("_n") - 1) / 2).alias(rank), F.col("_n").alias(f"{rank}_ties"))
    return df.join(ranked, [*groups, value])


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs of numeric columns: n, Pearson's r, covariance, and the regression line; rows lacking either value are left out. One pass."""
    cast = df.select(*(number(df, c).alias(c) for c in columns))
    pairs = list(combinations_with_replacement(columns, 2))
    made = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
        made += [F.count(x).alias(f"n{i}"), F.corr(x, y).alias(f"r{i}"), F.covar_samp(x, y).alias(f"c{i}")]
    row = cast.agg(*made)
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"), F.round(f"r{i}", 6).alias("pearson"), F.round(f"c{i}", 4).alias("covariance")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def correlation_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The cells of a correlation heat map: a, b, pearson, for every ordered pair of columns."""
    half = correlations(df, columns)
    cells = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return half.select(F.explode(F.when(F.col("a") == F.col("b"), F.slice(cells, 1, 1)).otherwise(cells)).alias("e"), "pearson").select("e.a", "e.b", "pearson")


def _pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs of numbers with their rows: a, b, n; written, since marginals and pairs are both read."""
    return written(df.select(number(df, a).alias("a"), number(df, b).alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("n")))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rank correlation of two numeric columns: Pearson's r of the average ranks, over distinct pairs with their counts."""
    pairs = _pair_counts(df, a, b)
    ranked = pairs.join(ranked_values(pairs, "a", "n", "ra"), "a").join(ranked_values(pairs, "b", "n", "rb"), "b")
    n = F.col("n").cast("double")
    # ranks have the mean (n + 1) / 2, so products about it need no second pass
    total = pairs.agg(F.sum("n")).first()[0]
    middle = ((total or 0) + 1) / 2
    da, db = F.col("ra") - middle, F.col("rb") - middle
    moments = ranked.agg(F.sum("n").alias("n"), F.sum(da * db * n).alias("ab"), F.sum(da * da * n).alias("aa"), F.sum(db * db * n).alias("bb"))
    bound = F.sqrt(F.col("aa") * F.col("bb"))
    return moments.select(F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.round(F.col("ab") / F.when(bound > 0, bound), 6).alias("spearman"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall's tau-b: n, n_concordant, n_discordant (pairs of rows), tau_b.

    Two rows differ in a at the highest bit in which the numbers of their a values
    differ. So for each bit, the rows with equal higher bits form a block, in which
    those with the bit stand behind those without: running counts in the order of b
    give how many of these have a smaller or larger b. The work is rows times the
    bits of the number of distinct a values; no pair is formed. Below three billion rows.
    """
    pairs = _pair_counts(df, a, b)
    numbered = ordered_totals(pairs.select("a").distinct().withColumn("one", F.lit(1).cast("long")), ["a"], ["one"]).select("a", (F.col("one_upto") - 1).alias("no"))
    bits = max(1, (numbered.agg(F.max("no")).first()[0] or 0)).bit_length()
    shift = lambda k: F.call_function("shiftright", F.col("no"), k)
    split = pairs.join(numbered, "a").withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    split = split.select("bit", shift(F.col("bit") + 1).alias("block"), "b", "n", shift(F.col("bit")).bitwiseAND(F.lit(1)).alias("high"))
    places = split.groupBy("bit", "block", "b").agg(F.sum(F.when(F.col("high") == 0, F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.when(F.col("high") == 1, F.col("n")).otherwise(0)).alias("ones"))
    counted = ordered_totals(places, ["bit", "block", "b"], ["zeros"])
    blocks = counted.groupBy("bit", "block").agg(F.min(F.col("zeros_upto") - F.col("zeros")).alias("before"), F.max("zeros_upto").alias("upto"))
    met = spread_join(counted, blocks, ["bit", "block"], F.pmod(F.xxhash64("b"), F.lit(64)))
    smaller, larger = F.col("zeros_upto") - F.col("zeros") - F.col("before"), F.col("upto") - F.col("zeros_upto")
    signs = met.agg(F.coalesce(F.sum(F.col("ones") * smaller), F.lit(0)).alias("n_concordant"), F.coalesce(F.sum(F.col("ones") * larger), F.lit(0)).alias("n_discordant"))
    tied = lambda c: pairs.groupBy(c).agg(F.sum("n").alias("t")).agg(F.sum("t").alias("n"), F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"t{c}"))
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    bound = F.sqrt((all_pairs - F.col("ta")) * (all_pairs - F.col("tb")))
    one = F.lit(1).alias("_one")
    joined = signs.select("*", one).join(tied("a").select("*", one), "_one").join(tied("b").select("tb", one), "_one")  # one row each
    return joined.select("n", "n_concordant", "n_discordant", F.round((F.col("n_concordant") - F.col("n_discordant")) / F.when(bound > 0, bound), 6).alias("tau_b"))


def missing_patterns(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows by whether either column is missing."""
    return df.groupBy(is_missing(F.col(a)).alias("a_missing"), is_missing(F.col(b)).alias("b_missing")).agg(F.count("*").alias("n_rows"))


def numeric_by_category(df: DataFrame, category: str, value: str) -> DataFrame:
    """Five-number summary, mean and deviation of a number per category."""
    x = number(df, value)
    q = lambda p: F.round(F.percentile(x, p), 6)
    return df.where(~is_missing(F.col(category)) & x.isNotNull()).groupBy(F.col(category).alias("category")).agg(
        F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("sd"), F.min(x).alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(x).alias("max")
    )


def crosstab(df: DataFrame, a: str, b: str, most: int = 20) -> DataFrame:
    """Counts of category pairs with percents of all, of the row and of the column; categories after the ``most`` most frequent become Other."""
    cells = df.where(~is_missing(F.col(a)) & ~is_missing(F.col(b))).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))

    def limited(side: str) -> Column:
        return F.when(F.col(f"{side}_first"), F.col(side)).otherwise("Other")

    for side in ("a", "b"):
        first = cells.groupBy(side).agg(F.sum("n").alias("_t")).orderBy(F.desc("_t"), side).limit(most).select(side, F.lit(True).alias(f"{side}_first"))
        cells = cells.join(F.broadcast(first), side, "left")  # the most frequent ones only
    merged = cells.groupBy(limited("a").alias("a"), limited("b").alias("b")).agg(F.sum("n").alias("n"))
    part = lambda *by: F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy(*by)), 2)
    return merged.select("a", "b", "n", part().alias("percent"), part("a").alias("row_percent"), part("b").alias("column_percent"))


def outliers(df: DataFrame, group: str, value: str, z: float = 3.0, modified: float = 3.5, fence: float = 1.5) -> DataFrame:
    """Every numeric row with its group's figures and flags.

    Adds z (sample deviation), modified z (0.6745 (x - median) / MAD), the fences of
    Tukey, and the three flags; a score that needs a zero deviation is null. The
    figures are one row per group; percentiles are exact. Rows of a null group drop out.
    """
    x = number(df, value)
    rows = df.where(x.isNotNull()).withColumn("_x", x)
    counts = written(rows.groupBy(group, F.col("_x").alias("x")).agg(F.count("*").alias("c")))
    quartiles = group_quantiles(counts, [group], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    figures = written(rows.groupBy(group).agg(F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd")).join(quartiles, group))
    away = counts.join(figures.select(group, "median"), group).select(group, F.abs(F.col("x") - F.col("median")).alias("x"), "c")
    out = rows.join(figures, group).join(group_quantiles(away, [group], {"mad": 0.5}), group)
    zs = (F.col("_x") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd"))
    ms = F.lit(0.6745) * (F.col("_x") - F.col("median")) / F.when(F.col("mad") > 0, F.col("mad"))
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - fence * iqr, F.col("q3") + fence * iqr
    flag = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        *df.columns, F.round(zs, 6).alias("z"), F.round(ms, 6).alias("modified_z"), F.round(low, 6).alias("low_fence"), F.round(high, 6).alias("high_fence"),
        flag(F.abs(zs) >= z).alias("z_flag"), flag(F.abs(ms) >= modified).alias("modified_z_flag"), flag((F.col("_x") < low) | (F.col("_x") > high)).alias("iqr_flag"),
    )
