"""Lists, sets and text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.exprs import natural_key

#: A token: a letter or digit, then letters, digits, apostrophes and hyphens.
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}'-]*"


def list_items(df: DataFrame, text: str, separator: str = r"\r\n|\r|\n", keep: Sequence[str] = ()) -> DataFrame:
    """One row per item of a text: keep, ``place`` (from 0), ``item`` trimmed with single spaces; blank items drop out."""
    rows = df.select(*keep, F.posexplode(F.split(F.col(text), separator)).alias("place", "item"))
    return rows.withColumn("item", F.trim(F.regexp_replace("item", r"\s+", " "))).where("item <> ''")


def count_items(df: DataFrame, item: str, case_sensitive: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """Counts per item without regard to case, in the spelling that comes first by ``order``."""
    key = F.col(item) if case_sensitive else F.lower(item)
    spelling = F.min_by(item, F.struct(*order)) if order else F.min(item)
    return df.where(F.col(item).isNotNull()).groupBy(key.alias("key")).agg(F.count("*").alias("n"), spelling.alias("item"))


def compare_lists(lists: Sequence[tuple[str, DataFrame]], case_sensitive: bool = False) -> DataFrame:
    """Membership of items in named one-column lists: key, one ``in_<name>`` count each, and ``membership``, the names joined by &."""
    parts = [df.select(F.lit(name).alias("list"), F.col(df.columns[0]).cast("string").alias("item")) for name, df in lists]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    key = F.trim("item") if case_sensitive else F.lower(F.trim("item"))
    counts = [F.count_if(F.col("list") == name).alias(f"in_{name}") for name, _ in lists]
    out = rows.withColumn("key", key).where("key <> ''").groupBy("key").agg(*counts)
    return out.withColumn("membership", F.concat_ws("&", *(F.when(F.col(f"in_{name}") > 0, F.lit(name)) for name, _ in lists)))


def overlap_categories(compared: DataFrame) -> DataFrame:
    """Items per membership pattern."""
    return compared.groupBy("membership").agg(F.count("*").alias("n_items"))


def sorted_items(df: DataFrame, item: str, mode: str = "natural", descending: bool = False) -> DataFrame:
    """Orders items: natural (digit runs by value), text, or numeric (numbers first, by value)."""
    number = F.col(item).try_cast("double")
    keys = {"natural": [natural_key(F.col(item)), F.col(item)], "text": [F.col(item)], "numeric": [number.isNull(), number, F.col(item)]}[mode]
    return df.orderBy(*(k.desc() if descending else k.asc() for k in keys))


def tokens(text: Column) -> Column:
    """The lower-cased tokens of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_counts(df: DataFrame, text: str, stop_words: Sequence[str] = (), min_length: int = 3, top: int | None = None) -> DataFrame:
    """Words with counts and percent of all counted words; with ``top``, the most frequent ones (ties by word)."""
    rows = df.select(F.explode(tokens(F.col(text))).alias("word")).where((F.length("word") >= min_length) & ~F.col("word").isin(*stop_words) if stop_words else F.length("word") >= min_length)
    counts = rows.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    one = F.lit(1).alias("_one")
    out = counts.select("*", one).join(total.select("*", one), "_one").select("word", "n", F.round(F.col("n") * 100 / F.col("total"), 6).alias("percent"))  # beside one row
    return out.orderBy(F.desc("n"), "word").limit(top) if top else out


def replace_text(df: DataFrame, text: str, pattern: str, replacement: str) -> DataFrame:
    """Adds ``replaced`` and ``n_matches`` for a regular expression."""
    return df.withColumns({"replaced": F.regexp_replace(F.col(text), pattern, replacement), "n_matches": F.regexp_count(F.col(text), F.lit(pattern)).cast("long")})


def text_matches(df: DataFrame, ids: Sequence[str], text: str, pattern: str) -> DataFrame:
    """One row per match: ids, line (from 1), match number in the line, the matched text."""
    lines = df.select(*ids, F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("line", "content"))
    return lines.select(*ids, (F.col("line") + 1).alias("line"), F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("match_no", "matched")).withColumn("match_no", F.col("match_no") + 1)


def only_matches(text: Column, pattern: str, separator: str = "\n") -> Column:
    """All matches of a regular expression in a text, joined; null stays null."""
    return F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), separator)


def without_lines(text: Column, pattern: str) -> Column:
    """The text without the lines in which the pattern occurs."""
    return F.array_join(F.filter(F.split(text, r"\r\n|\r|\n"), lambda line: ~line.rlike(pattern)), "\n")


def strip_html(text: Column) -> Column:
    """Text without tags and with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " "))


def ranked_members(df: DataFrame, group: str, item: str) -> DataFrame:
    """Distinct items of each group with their dense rank in text order."""
    return df.select(group, item).distinct().withColumn("rank", F.dense_rank().over(Window.partitionBy(group).orderBy(item)))
