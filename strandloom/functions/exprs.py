"""Column builders for cells that arrive as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that count as missing in statistics and group summaries.
MISSING = ("NA", "N/A", "na", "n/a", "null", "NULL", "-")
#: Spellings that the table cleaner blanks (compared without case).
CLEANER_MISSING = ("NA", "N/A", "null", "NULL", ".")

_NUMBER = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def to_num(cell: Column) -> Column:
    """The finite number a cell spells, null for blank or other text. Suffixes such as ``1d`` and words such as NaN are not numbers."""
    text = F.trim(cell.cast("string"))
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def number(df: DataFrame, name: str) -> Column:
    """The finite number of a column: text by ``to_num``, numeric types as they are, NaN and infinities null."""
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return F.col(name).cast("double")
    if kind in ("float", "double"):
        value = F.col(name).cast("double")
        return F.when(F.abs(value) < F.lit(float("inf")), value)
    return to_num(F.col(name))


def present(df: DataFrame, name: str) -> Column:
    """The value of a column where it is not missing: trimmed text, numeric types as they are."""
    if dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return F.col(name)
    return F.when(~is_missing(F.col(name)), F.trim(F.col(name).cast("string")))


def to_num_sql(cell: Column) -> Column:
    """As ``to_num``, but a blank or null cell is 0 (the policy of SQL aggregates, the calculator and reshaping)."""
    return F.when(F.trim(F.coalesce(cell.cast("string"), F.lit(""))) == "", F.lit(0.0)).otherwise(to_num(cell))


def is_missing(cell: Column, tokens: Sequence[str] = MISSING) -> Column:
    """True for null, blank and the missing spellings, after trimming."""
    text = F.trim(F.coalesce(cell.cast("string"), F.lit("")))
    return (text == "") | text.isin(*tokens)


def natural_key(cell: Column) -> Column:
    """A key that orders digit runs by value: chr1 < chr2 < chr10. Case does not count; null sorts as blank."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(cell, F.lit(""))), F.lit(r"\d+|\D+"), F.lit(0))
    bare = lambda r: F.regexp_replace(r, "^0+(?=.)", "")
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.concat(F.lpad(F.length(bare(r)).cast("string"), 4, "0"), bare(r))).otherwise(r)), "")


def clean_text(cell: Column, missing: Sequence[str] = CLEANER_MISSING, trim: bool = True, collapse: bool = True) -> Column:
    """Trimmed text with single spaces; null and missing spellings become blank."""
    out = F.coalesce(cell.cast("string"), F.lit(""))
    if collapse:
        out = F.regexp_replace(out, r"\s+", " ")
    if trim:
        out = F.trim(out)
    return F.when(F.lower(out).isin(*sorted({t.lower() for t in missing})), "").otherwise(out)


def key_text(cell: Column, case_sensitive: bool = False) -> Column:
    """A join key: trimmed and lower-cased, null where blank so that blanks never match."""
    text = F.trim(cell.cast("string"))
    return F.when(text != "", text if case_sensitive else F.lower(text))


def compare(left: Column, op: str, right: Column) -> Column:
    """Comparison of two text cells: as numbers where both are numbers, else by natural order."""
    a, b = to_num(left), to_num(right)
    both = a.isNotNull() & b.isNotNull()
    x, y = (left, right) if op in ("=", "!=") else (natural_key(left), natural_key(right))
    ops = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}
    return F.when(both, ops[op](a, b)).otherwise(ops[op](x, y))


def significant(value: Column, digits: int = 12) -> Column:
    """The value rounded to so many significant digits."""
    size = F.when(value == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(value)))).cast("int")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - size)
    return F.when(value.isNull(), None).otherwise(F.rint(value * scale) / scale)
