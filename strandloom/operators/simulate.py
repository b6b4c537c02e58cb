"""Seeded changes of sequences and simulated reads, by hashes of key and place: any partitioning gives the same letters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.seq import reverse_complement

_PARTS = 1_000_000


def _draw(*what: Column | int | str) -> Column:
    """A whole number below ``_PARTS``, even over the hashes of the arguments."""
    return F.pmod(F.xxhash64(*(w if isinstance(w, Column) else F.lit(w) for w in what)), F.lit(_PARTS))


def _letters(sequence: Column) -> Column:
    return F.regexp_extract_all(sequence, F.lit(r"(?s)."), F.lit(0))


def shuffle_letters(sequence: Column, key: Column, seed: int = 1) -> Column:
    """The same letters in an order given by seed and key; null stays null."""
    drawn = F.transform(_letters(sequence), lambda c, i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(drawn), lambda x: x["c"]), "")


def mutate(sequence: Column, key: Column, substitutions: float = 0.01, insertions: float = 0.0, deletions: float = 0.0, seed: int = 1, alphabet: str = "ACGT") -> Column:
    """Each letter is independently replaced by another of the alphabet, preceded by an inserted one, or deleted, at the given rates.

    Letters outside the alphabet may be replaced by any of it. Null stays null.
    """
    s, i_, d = (int(r * _PARTS) for r in (substitutions, insertions, deletions))

    def one(c: Column, i: Column) -> Column:
        u = _draw("what", seed, key, i)
        others = F.replace(F.lit(alphabet), F.upper(c), F.lit(""))
        other = F.substring(others, (F.pmod(_draw("which", seed, key, i), F.length(others)) + 1).cast("int"), F.lit(1))
        new = F.substring(F.lit(alphabet), (F.pmod(_draw("new", seed, key, i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
        return F.when(u < s, other).when(u < s + i_, F.concat(new, c)).when(u < s + i_ + d, F.lit("")).otherwise(c)

    return F.array_join(F.transform(_letters(sequence), one), "")


def fragments(df: DataFrame, key: str, sequence: str, size: int, every: int, circular: bool = False, seed: int = 1) -> DataFrame:
    """Random fragments of ``size`` letters, one per ``every`` letters begun: key, no, start, end, strand, fragment.

    Starts are even over the places a fragment fits; in a circular sequence it may run over the end, and ``end`` is then smaller than ``start``.
    Shorter and null sequences give none. ``fragment`` is as read on ``strand``.
    """
    n = F.length("_s")
    rows = df.select(key, F.upper(F.regexp_replace(sequence, r"\s+", "")).alias("_s")).where(n >= size)
    places = n if circular else n - size + 1
    drawn = rows.select(key, "_s", F.explode(F.sequence(F.lit(1), F.ceil(n / every).cast("int"))).alias("no"))
    at = drawn.withColumn("_at", F.pmod(F.xxhash64(F.lit("place"), F.lit(seed), F.col(key), F.col("no")), places).cast("int"))
    text = F.substring(F.concat("_s", "_s") if circular else F.col("_s"), F.col("_at") + 1, F.lit(size))
    strand = F.when(_draw("strand", seed, F.col(key), F.col("no")) < _PARTS // 2, "+").otherwise("-")
    placed = at.select(key, "no", (F.col("_at") + 1).cast("long").alias("start"), (F.pmod(F.col("_at") + size - 1, n) + 1).cast("long").alias("end"), strand.alias("strand"), text.alias("_f"))
    return placed.select(key, "no", "start", "end", "strand", F.when(F.col("strand") == "-", reverse_complement(F.col("_f"))).otherwise(F.col("_f")).alias("fragment"))


def paired_reads(df: DataFrame, key: str, sequence: str, length: int = 100, insert: int = 300, depth: float = 10.0, error: float = 0.01, seed: int = 1) -> DataFrame:
    """Reads of both ends of random fragments at a mean depth: title (``key_start_end_no/mate``), sequence, quality.

    Titles carry the true place, see ``true_place``. Errors are substitutions; quality is the constant letter of the error rate.
    """
    found = fragments(df, key, sequence, insert, max(1, round(2 * length / depth)), seed=seed)
    ends = F.array(F.struct(F.lit(1).alias("mate"), F.left("fragment", F.lit(length)).alias("s")), F.struct(F.lit(2).alias("mate"), F.left(reverse_complement(F.col("fragment")), F.lit(length)).alias("s")))
    reads = found.select(F.concat_ws("_", key, F.col("start"), F.col("end"), F.col("no")).alias("_t"), F.explode(ends).alias("r"))
    title = F.concat("_t", F.lit("/"), "r.mate")
    phred = 40 if error <= 0 else max(2, min(40, round(-10 * math.log10(error))))
    return reads.select(title.alias("title"), mutate(F.col("r.s"), title, error, seed=seed).alias("sequence"), F.repeat(F.lit(chr(33 + phred)), F.length("r.s")).alias("quality"))


def true_place(title: Column) -> Sequence[Column]:
    """Source, start, end, number and mate out of a simulated read's title; null where it is not one."""
    part = lambda i: F.nullif(F.regexp_extract(title, r"^(.*)_([0-9]+)_([0-9]+)_([0-9]+)/([12])$", i), F.lit(""))
    return [part(1).alias("source"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"), part(4).cast("int").alias("no"), part(5).cast("int").alias("mate")]
