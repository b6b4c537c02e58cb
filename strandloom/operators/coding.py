"""Codon adaptation, back-translation and residue profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.seq import HYDROPATHY, codons


def relative_adaptiveness(usage: DataFrame) -> DataFrame:
    """Weights of codons from a table of (codon, amino_acid, n): n over the most frequent synonym's n; stops are left out. At most 61 rows."""
    coding = usage.where("amino_acid <> '*'").groupBy("codon", "amino_acid").agg(F.sum("n").alias("n"))
    most = coding.groupBy("amino_acid").agg(F.max("n").alias("most"))
    return coding.join(most, "amino_acid").select("codon", "amino_acid", (F.col("n") / F.col("most")).alias("weight"))


def adaptation_index(df: DataFrame, ids: Sequence[str], sequence: str, weights: DataFrame) -> DataFrame:
    """Codon adaptation index per row: ids, n_scored, n_ignored, cai (geometric mean of the weights).

    Stops, codons with other letters and codons of weight 0 are ignored and counted;
    a row without scored codons has a null index, a null sequence no row. Rows with
    equal ids are one coding sequence in pieces. All codons of a row lie in one
    partition, so the sums are formed before the shuffle.
    """
    pieces = df.where(F.col(sequence).isNotNull()).select(*ids, F.explode_outer(codons(F.col(sequence))).alias("codon"))
    logs = weights.where("weight > 0").select("codon", F.ln("weight").alias("_log"))
    scored = pieces.join(logs, "codon", "left").groupBy(*ids).agg(F.count("codon").alias("_n"), F.count("_log").alias("n_scored"), F.avg("_log").alias("_mean"))
    return scored.select(*ids, "n_scored", (F.col("_n") - F.col("n_scored")).alias("n_ignored"), F.round(F.exp("_mean"), 6).alias("cai"))


def favoured_codons(usage: DataFrame) -> dict[str, str]:
    """The most frequent codon of each amino acid, the first in the alphabet on ties; at most 21 rows reach the driver."""
    best = usage.groupBy("amino_acid").agg(F.min_by("codon", F.struct(-F.col("n"), F.col("codon"))).alias("codon"))
    return {r["amino_acid"]: r["codon"] for r in best.collect()}


def reverse_translate(df: DataFrame, protein: str, choice: dict[str, str], name: str = "coding") -> DataFrame:
    """Adds the coding sequence of a protein column by one codon per amino acid; unknown residues become NNN, null stays null."""
    table = F.create_map(*(F.lit(x) for pair in sorted(choice.items()) for x in pair)) if choice else F.create_map().cast("map<string,string>")
    letters = F.regexp_extract_all(F.upper(protein), F.lit(r"(?s)\S"), F.lit(0))
    return df.withColumn(name, F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("NNN"))), ""))


def hydropathy_profile(df: DataFrame, ids: Sequence[str], sequence: str, size: int = 9) -> DataFrame:
    """Moving mean of hydropathy: ids, start, end, position (the middle), n_known, hydropathy (null without known residues).

    A sequence shorter than ``size`` has one window, an empty or null one none. No
    shuffle: each row's windows are sums over a slice of its own values.
    """
    scale = F.create_map(*(F.lit(x) for pair in HYDROPATHY.items() for x in pair))
    values = F.transform(F.regexp_extract_all(F.upper(sequence), F.lit(r"\S"), F.lit(0)), lambda c: F.try_element_at(scale, c))
    rows = df.select(*ids, values.alias("_v")).where(F.size("_v") > 0).withColumn("_w", F.least(F.lit(size), F.size("_v")))
    placed = rows.select(*ids, "_w", F.col("_v"), F.explode(F.sequence(F.lit(1), F.size("_v") - F.col("_w") + 1)).alias("start"))
    known = F.filter(F.slice("_v", F.col("start"), F.col("_w")), lambda v: v.isNotNull())
    sums = placed.select(*ids, F.col("start").cast("long").alias("start"), (F.col("start") + F.col("_w") - 1).cast("long").alias("end"), known.alias("_k"))
    total = F.aggregate("_k", F.lit(0.0), lambda acc, v: acc + v)
    return sums.select(*ids, "start", "end", ((F.col("start") + F.col("end")) / 2).alias("position"), F.size("_k").cast("long").alias("n_known"), F.round(total / F.when(F.size("_k") > 0, F.size("_k")), 4).alias("hydropathy"))


def column_conservation(df: DataFrame, groups: Sequence[str], sequence: str) -> DataFrame:
    """Columns of aligned sequences per group: groups, position, n_rows, residue (most frequent, first in the alphabet on ties), share.

    Gaps (``-`` and ``.``) do not count. Letters are counted before anything is
    compared, so a group of any number of rows shrinks to its columns first.
    """
    counts = df.select(*groups, F.posexplode(F.regexp_extract_all(F.upper(sequence), F.lit(r"\S"), F.lit(0))).alias("_i", "residue")).where("residue NOT IN ('-', '.')").groupBy(*groups, "_i", "residue").agg(F.count("*").alias("_n"))
    best = counts.groupBy(*groups, "_i").agg(F.sum("_n").alias("n_rows"), F.max("_n").alias("_most"), F.min_by("residue", F.struct(-F.col("_n"), F.col("residue"))).alias("residue"))
    return best.select(*groups, (F.col("_i") + 1).cast("long").alias("position"), "n_rows", "residue", F.round(F.col("_most") / F.col("n_rows"), 4).alias("share"))
