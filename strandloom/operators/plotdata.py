"""The tables behind common plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.exprs import natural_key, number
from strandloom.functions.special import normal_q
from strandloom.operators.grouping import ordered_totals
from strandloom.operators.profile import quantile_at
from strandloom.session import written

#: Cells of a grid of labels that a plot or a contingency table may have.
MOST_CELLS = 100_000


def histogram(df: DataFrame, value: str, bins: int | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts in bins of equal width, empty ones included; the top edge belongs to the last bin.

    Without ``bins``, the rule of Freedman and Diaconis sets them (Sturges' where
    the quartiles meet), within 1 and 80.
    """
    rows = df.select(number(df, value).alias("x")).where("x IS NOT NULL")
    f = rows.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).first()
    if not f["n"]:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, n_values bigint")
    low, high = f["low"] if low is None else low, f["high"] if high is None else high
    if bins is None:
        counts = ordered_totals(rows.groupBy("x").agg(F.count("*").alias("c")), ["x"], ["c"]).withColumns({"upto": F.col("c_upto"), "n": F.lit(f["n"])})
        q1, q3 = counts.agg(quantile_at(0.25), quantile_at(0.75)).first()
        width = 2 * (q3 - q1) / f["n"] ** (1 / 3)
        bins = math.ceil((high - low) / width) if width > 0 else math.ceil(math.log2(f["n"])) + 1
        bins = max(1, min(80, bins))
    step = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col("x") - low) / step), F.lit(bins - 1)).cast("int")
    counts = rows.where(F.col("x").between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n_values"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda c: F.round(F.lit(low) + c * F.lit(step), 6)
    return grid.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"), F.coalesce("n_values", F.lit(0).cast("long")).alias("n_values"))


def box(df: DataFrame, groups: Sequence[str], value: str, fence: float = 1.5) -> DataFrame:
    """Per group: n, five numbers, whiskers (the outermost values inside the fences) and the number of outliers.

    Values are first counted per group, so only distinct values with their counts go on.
    """
    counts = df.select(*groups, number(df, value).alias("x")).where("x IS NOT NULL").groupBy(*groups, "x").agg(F.count("*").alias("c"))
    q = lambda p: F.percentile("x", p, F.col("c"))
    five = counts.groupBy(*groups).agg(F.sum("c").alias("n"), F.min("x").alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("x").alias("max"))
    reach = fence * (F.col("q3") - F.col("q1"))
    inside = F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    ends = counts.join(five, list(groups)).groupBy(*groups).agg(F.min(F.when(inside, F.col("x"))).alias("whisker_low"), F.max(F.when(inside, F.col("x"))).alias("whisker_high"), F.sum(F.when(inside, 0).otherwise(F.col("c"))).alias("outlier_count"))
    return five.join(ends, list(groups))


def density(df: DataFrame, groups: Sequence[str], value: str, points: int = 32) -> DataFrame:
    """Gaussian density per group on one grid over the whole range, with Silverman's bandwidth: groups, x, density.

    Each distinct value adds to every grid point, so the work is distinct values times ``points``.
    """
    counts = df.select(*groups, number(df, value).alias("v")).where("v IS NOT NULL").groupBy(*groups, "v").agg(F.count("*").alias("c"))
    span = counts.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    if span["low"] is None:
        return df.select(*groups, F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).where("false")
    n = F.sum("c")
    mean = F.sum(F.col("v") * F.col("c")) / n
    var = (F.sum(F.col("v") * F.col("v") * F.col("c")) - n * mean * mean) / F.when(n > 1, n - 1)
    iqr = F.percentile("v", 0.75, F.col("c")) - F.percentile("v", 0.25, F.col("c"))
    width = counts.groupBy(*groups).agg(n.alias("n"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"), iqr.alias("iqr"))
    spread = F.when(F.col("iqr") > 0, F.least("sd", F.col("iqr") / 1.34)).otherwise(F.col("sd"))
    width = width.select(*groups, "n", (0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h")).where("h > 0")
    step = (span["high"] - span["low"]) / (points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(span["low"]) + i * F.lit(step))
    z = (F.col("x") - F.col("v")) / F.col("h")
    each = counts.join(width, list(groups)).select(*groups, "v", "c", "n", "h", F.explode(grid).alias("x"))
    return each.groupBy(*groups, "x").agg((F.sum(F.exp(-z * z / 2) * F.col("c")) / F.max(F.col("n") * F.col("h")) / math.sqrt(2 * math.pi)).alias("density")).select(*groups, F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


def bounded_grid(cells: DataFrame, x: str, y: str) -> DataFrame:
    """All combinations of the seen x and y of a table of cells; an error if they are more than ``MOST_CELLS``.

    Labels, not rows, are combined, and both sides are short by that bound.
    """
    n = cells.agg(F.count_distinct(x).alias("x"), F.count_distinct(y).alias("y")).first()
    if n["x"] * n["y"] > MOST_CELLS:
        raise ValueError(f"{n['x']} x {n['y']} labels make more than {MOST_CELLS} cells")
    one = F.lit(1).alias("_one")
    return cells.select(x, one).distinct().join(F.broadcast(cells.select(y, one).distinct()), "_one").drop("_one")


def heatmap(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Mean per (x, y) for all combinations of seen x and y, ``MOST_CELLS`` at most; cells without rows have a null mean."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.round(F.avg(number(df, value)), 6).alias("mean"), F.count("*").alias("n"))
    return bounded_grid(cells, "x", "y").join(cells, ["x", "y"], "left").select("x", "y", "mean", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def qq(df: DataFrame, value: str) -> DataFrame:
    """Normal Q-Q points per distinct value: value, its last rank, (rank - 0.5) / n, and the normal quantile."""
    counts = df.select(number(df, value).alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("c"))
    ranked = ordered_totals(counts, ["x"], ["c"])
    total = ranked.agg(F.max("c_upto")).first()[0] or 0
    return ranked.select("x", F.col("c_upto").alias("rank"), F.round((F.col("c_upto") - 0.5) / F.lit(float(total or 1)), 9).alias("probability")).withColumn("quantile", F.round(normal_q("probability"), 6))


def volcano(df: DataFrame, effect: Column, p: Column, effect_limit: float, p_limit: float) -> DataFrame:
    """Adds -log10 p and the class up, down or ns; rows without a positive p or an effect are left out."""
    out = df.withColumns({"effect": effect, "p": p}).where(F.col("effect").isNotNull() & (F.col("p") > 0))
    strong = F.col("p") <= p_limit
    kind = F.when(strong & (F.col("effect") >= effect_limit), "up").when(strong & (F.col("effect") <= -effect_limit), "down").otherwise("ns")
    return out.withColumns({"minus_log10_p": F.round(-F.log10("p"), 6), "kind": kind})


def manhattan(df: DataFrame, chrom: str, pos: str, lengths: DataFrame) -> DataFrame:
    """Adds the cumulative position over chromosomes in natural order; ``lengths`` has (chrom, length), few rows."""
    order = Window.orderBy(natural_key(F.col("chrom")), "chrom")
    offsets = lengths.select(F.col(lengths.columns[0]).alias("chrom"), F.col(lengths.columns[1]).alias("length")).where("length IS NOT NULL")
    offsets = offsets.select("chrom", F.row_number().over(order).alias("chrom_no"), F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return df.join(offsets, df[chrom] == offsets["chrom"]).drop("chrom").withColumn("cumulative", F.col("offset") + F.col(pos)).drop("offset")


def flows(df: DataFrame, source: str, target: str, value: str) -> DataFrame:
    """Positive flows summed by source and target."""
    x = number(df, value)
    return df.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (x > 0)).groupBy(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target")).agg(F.round(F.sum(x), 2).alias("flow"))


def node_totals(edges: DataFrame) -> DataFrame:
    """Incoming and outgoing totals of every node of a flow table."""
    ends = F.array(F.struct(F.col("source").alias("node"), F.lit(0.0).alias("incoming"), F.col("flow").alias("outgoing")), F.struct(F.col("target").alias("node"), F.col("flow").alias("incoming"), F.lit(0.0).alias("outgoing")))
    return edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.round(F.sum("e.incoming"), 2).alias("incoming"), F.round(F.sum("e.outgoing"), 2).alias("outgoing"))


def node_levels(edges: DataFrame, most: int = 50) -> DataFrame:
    """The level of every node: the longest path of edges that leads to it, sources having 0.

    Nodes are settled in the order of their levels: each round takes the nodes whose
    incoming edges all come from settled nodes, so a path of n edges takes n rounds, and
    ``most`` rounds at most; more is an error. Nodes on a cycle or behind one are never
    taken and get level 1, or 0 without an incoming edge.
    """
    left = written(edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct())
    nodes = left.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    settled, rest = [], nodes
    for level in range(most + 1):
        rest = written(rest)
        free = rest.join(left.select(F.col("target").alias("node")).distinct(), "node", "left_anti")
        free = written(free.withColumn("level", F.lit(level)))
        if not free.take(1):
            break
        settled.append(free)
        rest = rest.join(free, "node", "left_anti")
        left = written(left.join(free.select(F.col("node").alias("source")), "source", "left_anti"))
    else:
        if rest.take(1):
            raise ValueError(f"a path has more than {most} edges")
    for part in settled[1:]:
        settled[0] = settled[0].unionByName(part)
    on_cycles = rest.withColumn("level", F.lit(1))
    return settled[0].unionByName(on_cycles) if settled else on_cycles


def evenly_spaced(df: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows at even distances in the order of a unique column, the first and the last included; all rows if there are no more.

    Row i of n has the place round(i (N - 1) / (n - 1)) among N, halves upward.
    """
    numbered = ordered_totals(df.where(F.col(order).isNotNull()).withColumn("_one", F.lit(1).cast("long")), [order], ["_one"])
    total = numbered.agg(F.max("_one_upto")).first()[0] or 0
    if total <= n:
        return numbered.select(*df.columns)
    place = F.col("_one_upto") - 1
    if n <= 1:
        return numbered.where(place < n).select(*df.columns)
    step = (total - 1) / (n - 1)
    at = lambda i: F.floor(i * F.lit(step) + 0.5)
    near = F.round(place / step)
    return numbered.where((at(near) == place) | (at(near - 1) == place) | (at(near + 1) == place)).select(*df.columns)


def line_points(df: DataFrame, x: str, y: str, series: str | None = None) -> DataFrame:
    """Numeric points of a line plot in the order of series and x: series, x, y. Rows lacking a number drop out; without ``series`` it is blank."""
    name = F.coalesce(F.col(series).cast("string"), F.lit("")) if series else F.lit("")
    return df.select(name.alias("series"), number(df, x).alias("x"), number(df, y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL").orderBy("series", "x", "y")


def scatter_points(df: DataFrame, x: str, y: str, group: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric points of a scatter plot: keep, group (blank without one), x, y; rows lacking a number drop out."""
    name = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    return df.select(*keep, name.alias("group"), number(df, x).alias("x"), number(df, y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


def bar_values(df: DataFrame, category: str, value: str, group: str | None = None) -> DataFrame:
    """Bars with a numeric value: category, group (blank without one), value; blank categories drop out."""
    label = F.trim(F.coalesce(F.col(category).cast("string"), F.lit("")))
    name = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    return df.select(label.alias("category"), name.alias("group"), number(df, value).alias("value")).where("category <> '' AND value IS NOT NULL")


def track_summary(df: DataFrame, group: str, start: str, end: str, lengths: DataFrame, bins: int = 100) -> DataFrame:
    """Intervals per bin of their record: group, bin (from 0), bin_start, bin_end, n (intervals that touch it), covered (their positions in it, added up).

    ``lengths`` has (group, length); records of unknown length drop out. Intervals are
    copied to the bins they touch, at most ``bins`` each; bins without one are left out.
    """
    sizes = lengths.select(F.col(lengths.columns[0]).alias(group), F.col(lengths.columns[1]).alias("_length")).where("_length > 0")
    width = F.ceil(F.col("_length") / F.lit(bins)).cast("long")
    rows = df.select(group, F.col(start).cast("long").alias("_a"), F.col(end).cast("long").alias("_b")).where("_a >= 1 AND _b >= _a").join(sizes, group).where("_a <= _length")
    each = rows.withColumn("_w", width).withColumn("_b", F.least("_b", "_length")).withColumn("bin", F.explode(F.sequence(F.floor((F.col("_a") - 1) / F.col("_w")), F.floor((F.col("_b") - 1) / F.col("_w")))))
    low, high = F.col("bin") * F.col("_w") + 1, F.least((F.col("bin") + 1) * F.col("_w"), F.col("_length"))
    covered = F.least("_b", high) - F.greatest("_a", low) + 1
    return each.groupBy(group, "bin", low.alias("bin_start"), high.alias("bin_end")).agg(F.count("*").alias("n"), F.sum(covered).alias("covered"))
