"""Cleaning, calculating, joining, summarising and reshaping of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.exprs import clean_text, key_text, natural_key, number, present, to_num, to_num_sql
from strandloom.operators.grouping import ordered_totals


def find_column(df: DataFrame, name: str) -> str:
    """The column whose name, or ``label`` metadata, equals ``name`` without regard to case; the first wins."""
    wanted = name.strip().lower()
    for field in df.schema.fields:
        if field.name.lower() == wanted or str(field.metadata.get("label", "")).lower() == wanted:
            return field.name
    raise ValueError(f"no column {name!r} in {df.columns}")


def column_list(value: str | Sequence[str]) -> list[str]:
    """Names from a comma-separated text or a sequence; blanks are dropped."""
    parts = value.split(",") if isinstance(value, str) else value
    return [p.strip() for p in parts if p.strip()]


def rule_lines(text: str, fields: int) -> list[list[str]]:
    """Lines of ``a|b|c`` rules; blank lines and ``#`` comments are skipped, missing fields are blank."""
    lines = [line.strip() for line in text.splitlines()]
    split = [[p.strip() for p in line.split("|", fields - 1)] for line in lines if line and not line.startswith("#")]
    return [parts + [""] * (fields - len(parts)) for parts in split]


def row_rule(df: DataFrame, column: str, op: str, value: str = "") -> Column:
    """One row filter: contains, not_contains (without case), equals, not_equals, empty, not_empty, matches (a regular expression, with case), gt, gte, lt, lte (false unless numeric)."""
    cell = F.coalesce(F.col(find_column(df, column)).cast("string"), F.lit(""))
    x, bound = to_num(cell), to_num(F.lit(value))
    rules = {
        "contains": lambda: F.contains(F.lower(cell), F.lit(value.lower())),
        "not_contains": lambda: ~F.contains(F.lower(cell), F.lit(value.lower())),
        "equals": lambda: cell == value,
        "not_equals": lambda: cell != value,
        "empty": lambda: F.trim(cell) == "",
        "not_empty": lambda: F.trim(cell) != "",
        "matches": lambda: cell.rlike(value),
        "gt": lambda: F.coalesce(x > bound, F.lit(False)),
        "gte": lambda: F.coalesce(x >= bound, F.lit(False)),
        "lt": lambda: F.coalesce(x < bound, F.lit(False)),
        "lte": lambda: F.coalesce(x <= bound, F.lit(False)),
    }
    if op not in rules:
        raise ValueError(f"unknown rule {op!r}")
    return rules[op]()


def overview(df: DataFrame) -> DataFrame:
    """One row about a table: n_columns, n_rows, names (joined by a comma and a space)."""
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(len(df.columns)).alias("n_columns"), "n_rows", F.lit(", ".join(df.columns)).alias("names"))


def select_columns(df: DataFrame, rules: Sequence[tuple[str, str]], keep: bool = True) -> DataFrame:
    """Keeps (or drops) the columns whose names meet all rules; if none would remain, all do."""
    tests = {
        "contains": lambda n, v: v in n,
        "not_contains": lambda n, v: v not in n,
        "equals": lambda n, v: n == v,
        "not_equals": lambda n, v: n != v,
        "starts_with": str.startswith,
        "ends_with": str.endswith,
    }
    hit = [c for c in df.columns if all(tests[op](c.lower(), v.lower()) for op, v in rules)]
    chosen = hit if keep else [c for c in df.columns if c not in hit]
    return df.select(*(chosen or df.columns))


def non_empty_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with at least one cell that is not blank."""
    return df.where(reduce(lambda a, b: a | b, (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "" for c in columns or df.columns)))


def non_empty_columns(df: DataFrame) -> DataFrame:
    """Drops columns that are blank in every row; one aggregate row decides."""
    widths = df.agg(*(F.max(F.length(F.trim(F.col(c).cast("string")))).alias(c) for c in df.columns)).first()
    return df.select(*[c for c in df.columns if widths[c]] or df.columns)


def sort_by(df: DataFrame, rules: Sequence[tuple[str, bool]], *ties: str) -> DataFrame:
    """Orders by (column, descending) rules: numbers by value, text in natural order, then by ``ties``."""
    kinds = dict(df.dtypes)
    keys = []
    for name, down in rules:
        c = find_column(df, name)
        key = natural_key(F.col(c)) if kinds[c] == "string" else F.col(c)
        keys.append(key.desc() if down else key.asc())
    return df.orderBy(*keys, *ties)


def clean_table(df: DataFrame, row_rules: Sequence[tuple[str, str, str]] = (), distinct: bool = True, column_rules: Sequence[tuple[str, str]] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Normalises text cells, filters rows, drops repeated rows, filters columns and drops empty rows, in this order.

    Text cells are trimmed, inner white space collapses, missing spellings and nulls
    become blank. ``ties`` are columns that are left as they are and do not count in the
    comparison of rows; of equal rows the one with the smallest ``ties`` stays.
    """
    kinds = dict(df.dtypes)
    data = [c for c in df.columns if c not in ties]
    out = df.select(*((clean_text(F.col(c)).alias(c) if kinds[c] == "string" and c in data else F.col(c)) for c in df.columns))
    for column, op, value in row_rules:
        out = out.where(row_rule(out, column, op, value))
    if distinct:
        out = out.groupBy(*data).agg(F.min(F.struct(*ties)).alias("_first")).select("_first.*", *data).select(*df.columns) if ties else out.distinct()
    if column_rules:
        out = select_columns(out, column_rules)
    return non_empty_rows(out, [c for c in out.columns if c not in ties])


def calculate(df: DataFrame, name: str, op: str, left: str, right: str | float | None = None) -> DataFrame:
    """Appends a calculated column, rounded to 6 places; a result that does not exist is null.

    ``right`` names a column or is a constant. Blank cells count as 0. Operations:
    add, subtract, multiply, divide, percent, log2, log10, zscore (by the sample
    standard deviation over the whole column).
    """
    blank_zero = lambda c: to_num_sql(F.col(c)) if dict(df.dtypes)[c] == "string" else F.coalesce(number(df, c), F.lit(0.0))
    x = blank_zero(left) if op != "zscore" else number(df, left)
    y = blank_zero(right) if isinstance(right, str) else F.lit(float(right)) if right is not None else F.lit(None).cast("double")
    if op == "zscore":
        figures = df.agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_sd")).first()  # one row
        mean, sd = figures["_mean"], figures["_sd"]
        value = (x - F.lit(mean)) / F.lit(sd) if sd else F.lit(None).cast("double")
    else:
        value = {
            "add": lambda: x + y,
            "subtract": lambda: x - y,
            "multiply": lambda: x * y,
            "divide": lambda: F.when(y != 0, x / F.when(y != 0, y)),
            "percent": lambda: F.when(y != 0, x / F.when(y != 0, y) * 100),
            "log2": lambda: F.when(x > 0, F.log2(x)),
            "log10": lambda: F.when(x > 0, F.log10(x)),
        }[op]()
    return df.withColumn(name, F.round(value, 6))


def join_tables(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner", case_sensitive: bool = False) -> DataFrame:
    """Equi-join on pairs of key columns: inner, left, full, semi or anti.

    Keys compare trimmed and without case; a key with a blank or null part matches
    nothing but its row stays in left and full joins. The right key columns are
    dropped, in a full join they fill the left ones; other right columns whose
    names clash get the suffix ``_right``.
    """
    keys_l = [key_text(F.col(a), case_sensitive) for a, _ in on]
    keys_r = [key_text(F.col(b), case_sensitive) for _, b in on]
    whole = lambda parts: F.when(reduce(lambda a, b: a & b, (p.isNotNull() for p in parts)), F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts))))
    l = left.withColumn("_key_l", whole(keys_l))  # noqa: E741
    names, taken = {}, set(left.columns)
    for c in right.columns:
        new = c
        while new in taken:
            new += "_right"
        names[c] = new
        taken.add(new)
    r = right.select(whole(keys_r).alias("_key_r"), *(F.col(c).alias(names[c]) for c in right.columns))
    kind = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
    joined = l.join(r, F.col("_key_l") == F.col("_key_r"), kind)
    if how in ("semi", "anti"):
        return joined.select(*left.columns)
    partner = {a: names[b] for a, b in on}
    dropped = {names[b] for _, b in on}
    cols = [F.coalesce(F.col(c), F.col(partner[c])).alias(c) if how == "full" and c in partner else F.col(c) for c in left.columns]
    return joined.select(*cols, *(F.col(n) for n in names.values() if n not in dropped))


def summarize_groups(df: DataFrame, groups: Sequence[str], values: Sequence[str], operations: Sequence[str] = ("count", "sum", "mean", "median", "min", "max", "sd", "distinct")) -> DataFrame:
    """Per group: ``row_count`` and one ``<value>_<operation>`` column each, rounded to 6 places.

    Missing spellings do not count; number operations also skip other text; the
    deviation of fewer than two values is null. Null group cells form a group.
    Median and distinct need the single values: cells are counted per (group, value
    column, cell) first, so that distinct cells with their counts are all that they hold.
    """
    direct, counted = [F.count("*").alias("row_count")], []
    for i, v in enumerate(values):
        shown, x, mine = present(df, v), number(df, v), F.col("_i") == i
        made = {"count": F.count(shown), "sum": F.round(F.sum(x), 6), "mean": F.round(F.avg(x), 6), "min": F.min(x), "max": F.max(x), "sd": F.round(F.stddev_samp(x), 6)}
        later = {"median": F.round(F.percentile(F.when(mine, F.col("_x")), 0.5, F.when(mine, F.col("_c")).otherwise(0)), 6), "distinct": F.count_if(mine & F.col("_here"))}
        direct += [made[op].alias(f"{v}_{op}") for op in operations if op in made]
        counted += [later[op].alias(f"{v}_{op}") for op in operations if op in later]
    keys = [f"_g{k}" for k in range(len(groups))]
    named = [F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)]
    out = df.groupBy(*named).agg(*direct)
    if counted:
        cells = [F.struct(F.lit(i).alias("_i"), number(df, v).alias("_x"), F.when(number(df, v).isNull(), present(df, v).cast("string")).alias("_text"), present(df, v).isNotNull().alias("_here")) for i, v in enumerate(values)]
        each = df.select(*named, F.explode(F.array(*cells)).alias("e")).select(*keys, "e.*")
        counts = each.groupBy(*keys, "_i", "_x", "_text", "_here").agg(F.count("*").alias("_c")).groupBy(*keys).agg(*counted)
        same = reduce(lambda a, b: a & b, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys), F.lit(True))
        out = out.alias("a").join(counts.alias("b"), same).select("a.*", *(f"b.{c}" for c in counts.columns if c not in keys))
    return out.select(*(F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)), "row_count", *(f"{v}_{op}" for v in values for op in operations))


def long_to_wide(df: DataFrame, ids: Sequence[str], names: str, value: str, how: str = "first", order: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """One row per ids, one column per name. ``how``: first or last by ``order``, sum or mean (blanks count as 0); blank names are skipped."""
    named = df.where(F.trim(F.coalesce(F.col(names).cast("string"), F.lit(""))) != "")
    x = to_num_sql(F.col(value)) if dict(df.dtypes)[value] == "string" else F.coalesce(number(df, value), F.lit(0.0))
    place = F.struct(*order) if order else F.lit(0)
    agg = {"first": lambda: F.min_by(value, place), "last": lambda: F.max_by(value, place), "sum": lambda: F.round(F.sum(x), 6), "mean": lambda: F.round(F.avg(x), 6)}[how]()
    grouped = named.groupBy(*ids)
    return (grouped.pivot(names, list(columns)) if columns else grouped.pivot(names)).agg(agg)


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row per ids and value column, blanks included, values as text."""
    return df.select(*ids, *(F.col(v).cast("string").alias(v) for v in values)).unpivot(list(ids), list(values), name, value)


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 1) -> DataFrame:
    """Exactly ``n`` rows (or all) in the order of a seeded hash of the key: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def sample_with_replacement(df: DataFrame, n: int, key: Sequence[str], seed: int = 1) -> DataFrame:
    """Exactly ``n`` draws, each of any row with the same chance: the row with ``draw`` (from 0). None from an empty table.

    Draw i takes the row whose number, in the order of ``key``, is a seeded hash of i
    modulo the number of rows, so the same rows come on every run and a row may be drawn any number of times.
    """
    numbered = ordered_totals(df.withColumn("_one", F.lit(1).cast("long")), key, ["_one"])
    rows = numbered.agg(F.max("_one_upto")).first()[0]
    if not rows:
        return df.withColumn("draw", F.lit(0).cast("long")).where("false")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(rows)) + 1).alias("_one_upto"))
    return numbered.drop("_one").join(draws, "_one_upto").select(*df.columns, "draw")


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with ``rank``; a first cut inside each task keeps hot groups small."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(64))
    first = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "_salt").orderBy(*order))).where(F.col("_r") <= n).drop("_r", "_salt")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= n)
