"""Parsing of delimited lines with the reasons why lines fail."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stand for a comma between fields and for themselves; see ``split_fields``.
_MARK, _SEP, _SELF = "\u0001", "\u0001f", "\u0001e"


def _pieces(line: Column) -> Column:
    """Text between double quotes: pieces 0, 2, 4 … stand outside quotes, 1, 3, 5 … inside."""
    return F.split(line, '"', -1)


def quoting_fails(line: Column) -> Column:
    """True where a quoted field is not closed, a quote stands in an unquoted field, or text follows a closing quote."""
    parts = _pieces(line)
    n = F.size(parts)
    inner = F.transform(parts, lambda x, i: (i % 2 == 1) | (x == "") | ((i == 0) | x.startswith(",")) & ((i == n - 1) | x.endswith(",")))
    return (n % 2 == 0) | ~F.forall(inner, lambda ok: ok)


def split_fields(line: Column) -> Column:
    """The unquoted fields of a line whose quoting holds; doubled quotes become one."""
    parts = _pieces(F.replace(line, F.lit(_MARK), F.lit(_SELF)))
    n = F.size(parts)
    joined = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, x).when((x == "") & (i > 0) & (i < n - 1), '"').otherwise(F.replace(x, F.lit(","), F.lit(_SEP)))), "")
    return F.transform(F.split(joined, _SEP, -1), lambda f: F.replace(f, F.lit(_SELF), F.lit(_MARK)))


def digits_up_to(text: Column, most: int) -> Column:
    """True where ``text`` has only digits 0-9, at least one, and its value is at most ``most``."""
    bare = F.regexp_replace(text, "^0+", "")
    small = F.length(bare) <= len(str(most))
    return text.rlike(r"\A[0-9]+\z") & small & (F.coalesce(F.when(text.rlike(r"\A[0-9]+\z") & small, F.concat(F.lit("0"), bare).try_cast("long")), F.lit(most + 1)) <= most)


def is_cigar(text: Column) -> Column:
    """True for ``*`` and for one or more of digits followed by one of MIDNSHP=X."""
    return (text == "*") | ((text != "") & (F.regexp_replace(text, "[0-9]+[MIDNSHP=X]", "") == ""))


def parse_lines(df: DataFrame, line: str, columns: Sequence[str], rules: dict[str, Callable[[dict[str, Column]], Column]]) -> DataFrame:
    """Loads every field as nullable text and collects the reasons of failure per row.

    ``rules`` maps a reason to a function that gets the field columns by name and
    gives a Boolean column, true where the value holds. Adds ``fields``, an array of
    text, and ``errors``, an array of reasons: ``quoting``, else ``columns``, else
    the broken rules. Valid rows have an empty array. A null line has the error
    ``columns``; a rule that gives null counts as broken. Other columns are kept.
    """
    raw = F.col(line)
    plain = ~F.contains(raw, F.lit('"'))
    fields = F.when(raw.isNull(), None).when(plain, F.split(raw, ",", -1)).when(quoting_fails(raw), None).otherwise(split_fields(raw))

    def reasons(f: Column) -> Column:
        by_name = {c: F.get(f, F.lit(i)) for i, c in enumerate(columns)}
        broken = F.filter(F.array(*(F.when(~F.coalesce(rule(by_name), F.lit(False)), F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
        return F.when(f.isNull() & raw.isNotNull(), F.array(F.lit("quoting"))).when(f.isNull() | (F.size(f) != len(columns)), F.array(F.lit("columns"))).otherwise(broken)

    # the lambda binds the fields, so that a line is split once and not once per rule
    errors = F.transform(F.array(fields), reasons)[0]
    return df.withColumns({"fields": fields, "errors": errors})


def rejected(parsed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per failing line and reason."""
    return parsed.select(*keep, F.explode("errors").alias("reason"))


def loaded(parsed: DataFrame, keep: Sequence[str], columns: Sequence[str], casts: dict[str, str]) -> DataFrame:
    """The valid rows with one column per field; ``casts`` names the types of typed ones, blank or uncastable values being null."""
    value = {c: F.get(F.col("fields"), F.lit(i)) for i, c in enumerate(columns)}
    return parsed.where(F.size("errors") == 0).select(*keep, *((value[c].try_cast(casts[c]) if c in casts else value[c]).alias(c) for c in columns))
