"""Trimming and filtering of reads by quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phred(quality: Column, base: int = 33) -> Column:
    """The array of quality values of a quality text; null gives null."""
    return F.transform(F.regexp_extract_all(quality, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c) - base)


def best_range(values: Column, limit: float = 0.05, least: int = 20) -> Column:
    """Struct (start, end) of the stretch with the largest sum of ``limit`` minus error probability.

    Reads of ``least`` values and fewer, and reads whose best stretch is shorter than that, keep
    their whole range. A null value counts as an error for certain; null gives null.
    """
    zero, none = F.lit(0.0), F.lit(0)
    state = F.aggregate(
        F.transform(values, lambda q, i: F.struct(q.alias("q"), (i + 1).alias("i"))),
        F.struct(zero.alias("sum"), F.lit(1).alias("from"), zero.alias("best"), none.alias("a"), none.alias("b")),
        lambda s, v: F.transform(
            F.array(s["sum"] + limit - F.coalesce(F.pow(F.lit(10.0), v["q"] / -10), F.lit(1.0))),
            lambda t: F.struct(
                F.when(t > 0, t).otherwise(zero).alias("sum"),
                F.when(t > 0, s["from"]).otherwise(v["i"] + 1).alias("from"),
                F.when(t > s["best"], t).otherwise(s["best"]).alias("best"),
                F.when(t > s["best"], s["from"]).otherwise(s["a"]).alias("a"),
                F.when(t > s["best"], v["i"]).otherwise(s["b"]).alias("b"),
            ),
        )[0],
    )
    good = (F.size(values) > least) & (state["b"] - state["a"] + 1 >= least) & (state["best"] > 0)
    return F.when(values.isNotNull(), F.struct(F.when(good, state["a"]).otherwise(1).alias("start"), F.when(good, state["b"]).otherwise(F.size(values)).alias("end")))


def trim_best(df: DataFrame, sequence: str = "sequence", quality: str = "quality", limit: float = 0.05, least: int = 20) -> DataFrame:
    """Cuts both texts to the best range of the qualities; adds kept_start and kept_end. Texts of unequal length are first cut to the shorter one."""
    n = F.least(F.length(sequence), F.length(quality))
    cut = df.withColumns({sequence: F.left(F.col(sequence), n), quality: F.left(F.col(quality), n)}).withColumn("_r", best_range(phred(F.col(quality)), limit, least))
    part = lambda c: F.substring(F.col(c), F.col("_r.start"), F.col("_r.end") - F.col("_r.start") + 1)
    return cut.withColumns({sequence: part(sequence), quality: part(quality), "kept_start": F.col("_r.start"), "kept_end": F.col("_r.end")}).drop("_r")


def trim_tail(df: DataFrame, sequence: str = "sequence", quality: str = "quality", window: int = 4, mean: float = 20) -> DataFrame:
    """Cuts the end of a read as long as its last ``window`` values have a mean below ``mean``; a read without a good window becomes empty, one shorter than a window counts as a whole."""
    v = phred(F.col(quality))
    w = F.least(F.lit(window), F.size("_v"))
    ends = F.filter(F.sequence(w, F.size("_v")), lambda e: F.aggregate(F.slice("_v", e - w + 1, w), F.lit(0), lambda a, x: a + x) >= w * mean)
    keep = F.when(F.size("_v") > 0, F.coalesce(F.array_max(ends), F.lit(0))).otherwise(0)
    rows = df.withColumn("_v", v).withColumn("_k", keep)
    return rows.withColumns({sequence: F.left(F.col(sequence), F.col("_k")), quality: F.left(F.col(quality), F.col("_k"))}).drop("_v", "_k")


def read_faults(sequence: Column, quality: Column, least: int = 15, most_n: int = 5, low: int = 15, low_percent: float = 40) -> Column:
    """Why a read fails: array of ``too short``, ``too many N``, ``low quality``; empty for a good read. Null texts count as empty."""
    s, v = F.coalesce(sequence, F.lit("")), F.coalesce(phred(quality), F.array().cast("array<int>"))
    n_low = F.size(F.filter(v, lambda q: q < low))
    reasons = F.array(
        F.when(F.length(s) < least, "too short"),
        F.when(F.length(s) - F.length(F.translate(s, "Nn", "")) > most_n, "too many N"),
        F.when(n_low * 100 > F.size(v) * low_percent, "low quality"),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def mean_quality(quality: Column, base: int = 33) -> Column:
    """The mean quality value of a quality text; null if it is null or empty."""
    values = phred(quality, base)
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, q: a + q) / F.when(F.size(values) > 0, F.size(values))


def length_distribution(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Reads by length: length, n, percent of all reads. Null sequences drop out."""
    counts = df.where(F.col(sequence).isNotNull()).groupBy(F.length(sequence).alias("length")).agg(F.count("*").alias("n"))
    one = F.lit(1).alias("_one")
    return counts.select("*", one).join(counts.agg(F.sum("n").alias("_all")).select("*", one), "_one").select("length", "n", F.round(F.col("n") * 100 / F.col("_all"), 2).alias("percent"))  # beside one row


def duplicate_levels(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """How many distinct sequences occur how often: copies, n_sequences, n_reads."""
    counts = df.where(F.col(sequence).isNotNull()).groupBy(sequence).agg(F.count("*").alias("copies"))
    return counts.groupBy("copies").agg(F.count("*").alias("n_sequences"), F.sum("copies").alias("n_reads"))


def overrepresented(df: DataFrame, n: int = 20, sequence: str = "sequence") -> DataFrame:
    """The ``n`` most frequent sequences that occur more than once: sequence, copies; ties by sequence."""
    counts = df.where(F.col(sequence).isNotNull()).groupBy(sequence).agg(F.count("*").alias("copies")).where("copies > 1")
    return counts.orderBy(F.desc("copies"), sequence).limit(n)


def sample_reads(df: DataFrame, n: int, key: Sequence[str] = ("read_no",), seed: int = 1) -> DataFrame:
    """A seeded sample of ``n`` reads (all, if there are fewer), the same ones on every run: those with the smallest hashes of their key."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def sample_pairs(first: DataFrame, second: DataFrame, n: int, key: Sequence[str] = ("read_no",), seed: int = 1) -> DataFrame:
    """A seeded sample of ``n`` read pairs, mates by their key (the number in their file): key, sequence_1, quality_1, sequence_2, quality_2. Reads without a mate drop out."""
    named = lambda df, k: df.select(*key, F.col("sequence").alias(f"sequence_{k}"), F.col("quality").alias(f"quality_{k}"))
    return sample_reads(named(first, 1).join(named(second, 2), list(key)), n, key, seed)
