"""Scans along sequences."""

from __future__ import annotations

import operator
import re
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.seq import CODONS, STANDARD_CODE, auto_window, codons, iupac_regex, reverse_complement, windows
from strandloom.operators.grouping import spread_join
from strandloom.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def windows_of(df: DataFrame, ids: Sequence[str], sequence: str, size: int, step: int) -> DataFrame:
    """Sliding windows: ids, start, end, gc_percent, gc_skew (null without G and C)."""
    rows = df.select(*ids, F.explode(windows(F.upper(sequence), size, step)).alias("w"))
    text = F.col("w.text")
    n = lambda letters: F.length(text) - F.length(F.translate(text, letters, ""))
    known, gc = n("ACGTU"), n("GC")
    return rows.select(*ids, F.col("w.start").alias("start"), (F.col("w.start") + size - 1).alias("end"), F.round(gc * 100 / F.when(known > 0, known), 4).alias("gc_percent"), F.round((n("G") - n("C")) / F.when(gc > 0, gc), 4).alias("gc_skew"))


def auto_windows(df: DataFrame, ids: Sequence[str], sequence: str) -> DataFrame:
    """Windows side by side of a size that suits each sequence (``auto_window``): ids, start, end, gc_percent, gc_skew; the last one may be shorter."""
    rows = df.where(F.length(sequence) > 0).select(*ids, F.upper(sequence).alias("_s")).withColumn("_w", auto_window(F.length("_s")))
    each = rows.withColumn("start", F.explode(F.sequence(F.lit(1), F.length("_s"), F.col("_w"))))
    text = F.substring(F.col("_s"), F.col("start"), F.col("_w"))
    n = lambda letters: F.length(text) - F.length(F.translate(text, letters, ""))
    known, gc = n("ACGTU"), n("GC")
    return each.select(*ids, "start", (F.col("start") + F.length(text) - 1).alias("end"), F.round(gc * 100 / F.when(known > 0, known), 4).alias("gc_percent"), F.round((n("G") - n("C")) / F.when(gc > 0, gc), 4).alias("gc_skew"))


def codon_usage(df: DataFrame, groups: Sequence[str], sequence: str) -> DataFrame:
    """Codon counts of frame 0 per group with the amino acid, the number per thousand and the share within the amino acid; codons with other letters drop out."""
    table = F.create_map(*(F.lit(x) for pair in zip(CODONS, STANDARD_CODE, strict=True) for x in pair))
    counts = df.select(*groups, F.explode(codons(F.col(sequence))).alias("codon")).groupBy(*groups, "codon").agg(F.count("*").alias("n")).withColumn("amino_acid", F.try_element_at(table, F.col("codon"))).where("amino_acid IS NOT NULL")
    everything, same = Window.partitionBy(*groups), Window.partitionBy(*groups, "amino_acid")  # at most 64 rows a group
    return counts.select(*groups, "codon", "amino_acid", "n", F.round(F.col("n") * 1000 / F.sum("n").over(everything), 4).alias("per_thousand"), F.round(F.col("n") / F.sum("n").over(same), 4).alias("fraction"))


def find_motifs(df: DataFrame, record: str, sequence: str, motifs: dict[str, str], both_strands: bool = True) -> DataFrame:
    """All, also overlapping, places of IUPAC motifs: record, motif, strand, start, end (1-based on the given strand's letters as stored)."""
    forward = {name: iupac_regex(m) for name, m in motifs.items()}
    turn = str.maketrans("ACGTURYSWKMBDHVN", "TGCAAYRSWMKVHDBN")
    backward = {name: iupac_regex(m.upper()[::-1].translate(turn)) for name, m in motifs.items()}
    sizes = {name: len(m) for name, m in motifs.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [(name, "+", re.compile(f"(?={r})")) for name, r in forward.items()]
        if both_strands:
            tests += [(name, "-", re.compile(f"(?={r})")) for name, r in backward.items() if r != forward[name]]
        for batch in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, strand, r in tests:
                    for hit in r.finditer(text):
                        for column, v in zip(out, (row, name, strand, hit.start() + 1, hit.start() + sizes[name]), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], names=["record_id", "motif", "strand", "start", "end"])

    rows = df.where(F.col(sequence).isNotNull()).select(F.col(record).cast("long").alias("record_id"), F.upper(sequence).alias("s"))
    return rows.mapInArrow(scan, "record_id long, motif string, strand string, start long, end long")


def fragments(sites: DataFrame, lengths: DataFrame, offset: int = 1) -> DataFrame:
    """Linear fragments between cuts, each ``offset`` letters behind a site's start: record_id, start, end. Records without a cut stay whole.

    A record's cuts are bounded by its length.
    """
    cuts = sites.select("record_id", (F.col("start") + offset - 1).alias("cut")).distinct().join(lengths, "record_id").where("cut >= 1 AND cut < length").select("record_id", "cut")
    ends = cuts.unionByName(lengths.where("length > 0").select("record_id", F.col("length").alias("cut")))
    order = Window.partitionBy("record_id").orderBy("cut")
    return ends.select("record_id", (F.coalesce(F.lag("cut").over(order), F.lit(0)) + 1).alias("start"), F.col("cut").alias("end"))


def products(forward: DataFrame, reverse: DataFrame, least: int, most: int) -> DataFrame:
    """Pairs of a forward site and a reverse site behind it with a product of ``least`` to ``most`` letters: record_id, start, end, length.

    Sites meet per record and stretch of ``most`` letters, so a long record is spread and distant sites never meet.
    """
    f = forward.select("record_id", F.col("start").alias("f_start"), F.col("end").alias("f_end")).withColumn("bin", F.explode(F.array(F.floor(F.col("f_start") / most), F.floor(F.col("f_start") / most) + 1)))
    r = reverse.select("record_id", F.col("start").alias("r_start"), F.col("end").alias("r_end")).withColumn("bin", F.floor(F.col("r_end") / most))
    size = F.col("r_end") - F.col("f_start") + 1
    return f.join(r, ["record_id", "bin"]).where((F.col("r_start") > F.col("f_end")) & size.between(least, most)).select("record_id", F.col("f_start").alias("start"), F.col("r_end").alias("end"), size.alias("length"))


def find_orfs(df: DataFrame, record: str, sequence: str, min_codons: int = 30) -> DataFrame:
    """Open reading frames ATG ... stop in all six frames: record, strand, frame, start, end (on the forward strand), n_codons (stop not counted).

    The first start of each frame's stretch between stops counts; frames that run off the end are left out.
    Everything but nucleotide letters (layout, digits, gaps) is removed first, as in the reference; positions count the letters that remain.
    """
    turn = str.maketrans("ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orf = re.compile("ATG(?:(?!TAA|TAG|TGA)[A-Z]{3})*+(?:TAA|TAG|TGA)")
        for batch in batches:
            rows = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for strand, s in (("+", text), ("-", text[::-1].translate(turn))):
                    for frame in range(3):
                        at, last = frame, len(s) - 2
                        while at < last:
                            if s[at : at + 3] != "ATG":
                                at += 3
                                continue
                            hit = orf.match(s, at)
                            if not hit:
                                break
                            n = (hit.end() - at) // 3 - 1
                            if n >= min_codons:
                                a, b = (at + 1, hit.end()) if strand == "+" else (len(s) - hit.end() + 1, len(s) - at)
                                rows.append((row, strand, frame + 1, a, b, n))
                            at = hit.end()
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], [], []]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["record_id", "strand", "frame", "start", "end", "n_codons"])

    rows = df.where(F.col(sequence).isNotNull()).select(F.col(record).cast("long").alias("record_id"), F.translate(F.regexp_replace(F.upper(sequence), "[^ACGTURYSWKMBDHVNX]+", ""), "U", "T").alias("s"))
    return rows.mapInArrow(scan, "record_id long, strand string, frame int, start long, end long, n_codons long")


def _both_strands(patterns: DataFrame) -> DataFrame:
    upper = patterns.select("id", F.upper("pattern").alias("pattern")).where(F.length("pattern") > 0)
    return upper.withColumn("strand", F.lit("+")).unionByName(upper.select("id", reverse_complement(F.col("pattern")).alias("pattern"), F.lit("-").alias("strand")))


def _letters(df: DataFrame, record: str, sequence: str) -> DataFrame:
    return df.where(F.col(sequence).isNotNull()).select(F.col(record).alias("record_id"), F.upper(F.regexp_replace(sequence, r"\s+", "")).alias("s"))


def _seeded(rows: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """Places at which a seed stands in a record: ``seeds`` (seed, at and more; at is its offset in the pattern) with record_id and ``start``, the place of the pattern's first letter.

    Seeds have up to ``most`` letters; each of their lengths, ``most`` at most, is one pass over the windows of the records.
    """
    sizes = sorted(r[0] for r in seeds.select(F.length("seed")).distinct().collect())
    out = None
    for k in sizes or [most]:
        places = rows.select("record_id", F.explode(windows(F.col("s"), k, 1)).alias("w")).select("record_id", F.col("w.start").alias("_at"), F.col("w.text").alias("seed"))
        found = places.join(seeds.where(F.length("seed") == k), "seed").withColumn("start", F.col("_at") - F.col("at")).drop("_at", "seed", "at")
        out = found if out is None else out.unionByName(found)
    return out


def find_patterns(df: DataFrame, record: str, sequence: str, patterns: DataFrame, seed: int = 16) -> DataFrame:
    """All places of literal patterns, both strands: record_id, id, strand, start, end.

    ``patterns`` has (id, pattern) of any length. Every window of ``seed`` letters (fewer
    for shorter patterns) is looked up among the patterns' beginnings; the hits take
    the record's letters and are compared in full. Record ids are unique.
    """
    rows = _letters(df, record, sequence)
    seeds = _both_strands(patterns).withColumns({"seed": F.substring("pattern", 1, seed), "at": F.lit(0)})
    # written, so that Spark knows whether the hits are few enough to be sent to the records
    hits = written(_seeded(rows, seeds, seed)).join(rows, "record_id").where(F.substring(F.col("s"), F.col("start"), F.length("pattern")) == F.col("pattern"))
    return hits.select("record_id", "id", "strand", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("pattern") - 1).cast("long").alias("end"))


@F.pandas_udf(T.IntegerType())
def mismatches(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many letters of two texts of one length differ; null for other lengths."""
    return pd.Series([sum(map(operator.ne, x, y)) if x is not None and y is not None and len(x) == len(y) else None for x, y in zip(a, b, strict=True)], dtype="Int32")


def find_near_patterns(df: DataFrame, record: str, sequence: str, patterns: DataFrame, most: int = 1, seed: int = 12) -> DataFrame:
    """Places of literal patterns with at most ``most`` differing letters, both strands: record_id, id, strand, start, end, n_mismatches.

    A pattern is cut into ``most`` + 1 pieces, of which one is free of mismatches; the
    first ``seed`` letters of each are looked up among the records' windows. Patterns of
    ``most`` letters and fewer are left out, since they would match anywhere.
    """
    rows = _letters(df, record, sequence)
    size = F.length("pattern")
    piece = F.explode(F.sequence(F.lit(0), F.lit(most)))
    cut = _both_strands(patterns).where(size > most).withColumn("i", piece).withColumn("at", F.floor(F.col("i") * size / (most + 1)).cast("int"))
    width = F.floor((F.col("i") + 1) * size / (most + 1)).cast("int") - F.col("at")
    seeds = cut.select("id", "pattern", "strand", "at", F.substring(F.col("pattern"), F.col("at") + 1, F.least(width, F.lit(seed))).alias("seed"))
    places = written(_seeded(rows, seeds, seed).where("start >= 1").distinct())
    seen = places.join(rows, "record_id").where(F.col("start") + size - 1 <= F.length("s"))
    counted = seen.withColumn("n_mismatches", mismatches(F.substring(F.col("s"), F.col("start"), size), F.col("pattern"))).where(F.col("n_mismatches") <= most)
    return counted.select("record_id", "id", "strand", F.col("start").cast("long").alias("start"), (F.col("start") + size - 1).cast("long").alias("end"), "n_mismatches")


def find_partial_ends(df: DataFrame, record: str, sequence: str, patterns: DataFrame, least: int = 12) -> DataFrame:
    """Pieces of patterns at the ends of records, both strands: record_id, id, strand, side, start, end.

    Side ``5`` is the longest end of a pattern with which the record begins, side ``3``
    the longest beginning of one with which it ends, of ``least`` letters or more but
    not the whole pattern; of both sides of a pattern and strand the longer one counts, at a tie ``5``.
    Sides are those of the strand read; places are those of the record as stored.
    """
    rows = _letters(df, record, sequence).where(F.length("s") >= least)
    n, size = F.length("s"), F.length("pattern")
    turned = rows.select("record_id", "s", F.lit("+").alias("strand")).unionByName(rows.select("record_id", reverse_complement(F.col("s")).alias("s"), F.lit("-").alias("strand")))
    wanted = patterns.select("id", F.upper("pattern").alias("pattern")).where(size > least)
    pieces = wanted.select("id", "pattern", F.explode(windows(F.col("pattern"), least, 1)).alias("w")).select("id", "pattern", F.col("w.start").alias("at"), F.col("w.text").alias("seed"))
    begins = turned.withColumn("seed", F.substring("s", 1, least)).join(pieces.where("at > 1"), "seed").withColumn("k", size - F.col("at") + 1)
    five = begins.where((F.col("k") <= n) & (F.substring(F.col("s"), F.lit(1), F.col("k")) == F.substring(F.col("pattern"), F.col("at"), F.col("k")))).withColumn("side", F.lit("5"))
    ends = turned.withColumn("seed", F.right("s", F.lit(least))).join(pieces.where(F.col("at") + least - 1 < size), "seed").withColumn("k", F.col("at") + least - 1)
    three = ends.where((F.col("k") <= n) & (F.right(F.col("s"), F.col("k")) == F.substring(F.col("pattern"), F.lit(1), F.col("k")))).withColumn("side", F.lit("3"))
    columns = ["record_id", "id", "strand", "side", "k", n.cast("int").alias("n")]
    best = five.select(*columns).unionByName(three.select(*columns)).groupBy("record_id", "id", "strand", "n").agg(F.max(F.struct("k", "side")).alias("b"))
    first = ((F.col("b.side") == "5") == (F.col("strand") == "+"))
    start = F.when(first, 1).otherwise(F.col("n") - F.col("b.k") + 1)
    return best.select("record_id", "id", "strand", F.col("b.side").alias("side"), start.cast("long").alias("start"), (start + F.col("b.k") - 1).cast("long").alias("end"))


def equal_classes(df: DataFrame) -> DataFrame:
    """Members of the classes of equal sequences of (key, sequence): key, class_key (the smallest of the class), without regard to case; null sequences drop out."""
    rows = df.where(F.col("sequence").isNotNull()).select("key", F.upper("sequence").alias("s"))
    return spread_join(rows, rows.groupBy("s").agg(F.min("key").alias("class_key")), ["s"], F.pmod(F.xxhash64("key"), F.lit(64))).select("key", "class_key")


def kmer_pairs(a: DataFrame, b: DataFrame, k: int = 8, least: int = 1) -> DataFrame:
    """Pairs of two sets of (key, sequence) by shared distinct k-mers: key_a, key_b, shared (``least`` or more).

    Equal sequences are one entry of their smallest key on each side (``equal_classes``
    gives the members), so copies do not multiply pairs. A frequent k-mer of side a is
    spread over salts.
    """

    def kmers(df: DataFrame, key: str) -> DataFrame:
        one = df.where(F.col("sequence").isNotNull()).groupBy(F.upper("sequence").alias("s")).agg(F.min("key").alias(key))
        return one.select(key, F.explode(F.array_distinct(F.transform(windows(F.col("s"), k, 1), lambda w: w["text"]))).alias("kmer"))

    met = spread_join(kmers(a, "key_a"), kmers(b, "key_b"), ["kmer"], F.pmod(F.xxhash64("key_a"), F.lit(16)))
    return met.groupBy("key_a", "key_b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def reciprocal_best(a: DataFrame, b: DataFrame, k: int = 8, least: int = 1) -> DataFrame:
    """Reciprocal best matches among ``kmer_pairs``: key_a, key_b, shared. Ties go to the smaller key."""
    pairs = written(kmer_pairs(a, b, k, least))
    best_a = pairs.groupBy("key_a").agg(F.min_by("key_b", F.struct(-F.col("shared"), "key_b")).alias("key_b"))
    best_b = pairs.groupBy("key_b").agg(F.min_by("key_a", F.struct(-F.col("shared"), "key_a")).alias("key_a"))
    return pairs.join(best_a, ["key_a", "key_b"], "left_semi").join(best_b, ["key_a", "key_b"], "left_semi")


def first_hits(reads: DataFrame, references: DataFrame, seed: int = 16) -> DataFrame:
    """The first exact place of each read: id, record_id, strand, start, end. The smallest record id comes first, in it the forward strand, then the smallest start.

    ``reads`` has (id, pattern), ``references`` (record_id, sequence) with long ids; reads without a place drop out.
    """
    hits = find_patterns(references, "record_id", "sequence", reads, seed)
    best = hits.groupBy("id").agg(F.min(F.struct("record_id", (F.col("strand") == "-").alias("turned"), "start", "end", "strand")).alias("h"))
    return best.select("id", "h.record_id", "h.strand", "h.start", "h.end")


def best_unmatched(pairs: DataFrame, matched: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries of side a without a reciprocal match, each with its best partner: key_a, key_b and shared (null without any).

    ``pairs`` are all (key_a, key_b, shared), ``matched`` those of ``reciprocal_best``, ``keys`` the entries of side a (key_a).
    """
    best = pairs.groupBy("key_a").agg(F.min_by(F.struct("key_b", "shared"), F.struct(-F.col("shared"), "key_b")).alias("best"))
    return keys.select("key_a").join(matched.select("key_a"), "key_a", "left_anti").join(best, "key_a", "left").select("key_a", "best.key_b", "best.shared")
