"""Alignments, variants, reads and features as tables."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.seq import FLAGS, covered_blocks, gc_percent, reference_span, variant_kind
from strandloom.operators.grouping import ordered_totals
from strandloom.operators.intervals import depth
from strandloom.operators.periods import periods_and_gaps

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def flag_counts(sam: DataFrame, flag: str = "flag") -> DataFrame:
    """Rows per FLAG bit: flag_name, bit, n. One pass, all bits listed."""
    bits = F.array(*(F.struct(F.lit(name).alias("flag_name"), F.lit(bit).alias("bit")) for bit, name in FLAGS.items()))
    counts = sam.agg(*(F.count_if(F.col(flag).bitwiseAND(F.lit(bit)) != 0).alias(f"b{bit}") for bit in FLAGS))
    return counts.select("*", F.explode(bits).alias("f")).select("f.flag_name", "f.bit", F.coalesce(*(F.when(F.col("f.bit") == bit, F.col(f"b{bit}")) for bit in FLAGS)).alias("n"))


def reference_summary(sam: DataFrame) -> DataFrame:
    """Per reference: alignments, mapped ones, strands, mean mapq and read length, spanned positions. Rows on ``*`` are unmapped."""
    mapped = (F.col("flag").bitwiseAND(F.lit(4)) == 0) & (F.col("reference") != "*")
    return sam.groupBy("reference").agg(
        F.count("*").alias("n_rows"), F.count_if(mapped).alias("n_mapped"), F.count_if(F.col("strand") == "+").alias("n_plus"), F.count_if(F.col("strand") == "-").alias("n_minus"),
        F.round(F.avg("mapq"), 6).alias("mean_mapq"), F.round(F.avg("read_length"), 6).alias("mean_read_length"), F.sum(F.when(mapped, reference_span(F.col("cigar")))).alias("span_bp"),
    )


def alignment_depth(sam: DataFrame) -> DataFrame:
    """Runs of equal depth per reference from the aligned blocks (M, =, X) of mapped rows: reference, start, end, depth."""
    mapped = sam.where("flag IS NOT NULL AND reference <> '*' AND start >= 1 AND flag & 4 = 0")
    blocks = mapped.select("reference", F.explode(covered_blocks(F.col("start"), F.col("cigar"))).alias("b")).select("reference", "b.start", "b.end")
    return depth(blocks, ["reference"])


def window_depth(runs: DataFrame, width: int = 100_000) -> DataFrame:
    """Depth per window of a reference: reference, window_start, covered, mean_depth over the window's positions, max_depth."""
    split = runs.withColumn("w", F.explode(F.sequence(F.floor((F.col("start") - 1) / width), F.floor((F.col("end") - 1) / width))))
    size = F.least("end", (F.col("w") + 1) * width) - F.greatest("start", F.col("w") * width + 1) + 1
    return split.groupBy("reference", (F.col("w") * width + 1).alias("window_start")).agg(F.sum(size).alias("covered"), F.round(F.sum(size * F.col("depth")) / width, 6).alias("mean_depth"), F.max("depth").alias("max_depth"))


def parse_vcf(lines: DataFrame, line: str = "value") -> DataFrame:
    """VCF data lines as rows: chrom, pos, end, id, ref, alt, qual, filter, info (map), format (array), samples (array), kind.

    ``end`` is INFO/END, else pos + length(ref) - 1. Header lines, lines of fewer than
    8 fields and positions below 1 drop out; of a repeated INFO key the last counts; a key without
    value maps to an empty text.
    """
    f = F.split(F.col(line), "\t")
    rows = lines.where(~F.startswith(F.col(line), F.lit("#"))).select(f.alias("f")).where(F.size("f") >= 8)
    at = lambda i: F.get("f", F.lit(i))
    entries = F.transform(F.filter(F.split(at(7), ";"), lambda x: (x != "") & (x != ".")), lambda x: F.struct(F.split(x, "=", 2)[0].alias("k"), F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit("")).alias("v")))
    keys = F.array_distinct(F.transform(F.col("e"), lambda x: x["k"]))
    last = lambda k: F.element_at(F.filter(F.col("e"), lambda x: x["k"] == k), -1)["v"]
    out = rows.withColumn("e", entries).withColumn("info", F.map_from_arrays(keys, F.transform(keys, last))).withColumn("pos", at(1).try_cast("long")).where("pos >= 1")
    stop = F.coalesce(F.try_element_at("info", F.lit("END")).try_cast("long"), F.col("pos") + F.length(at(3)) - 1)
    many = F.size("f") > 9
    return out.select(
        at(0).alias("chrom"), "pos", stop.alias("end"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"), at(5).try_cast("double").alias("qual"), at(6).alias("filter"), "info",
        F.when(F.size("f") > 8, F.split(F.get("f", F.lit(8)), ":")).alias("format"), F.when(many, F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("samples"), variant_kind(at(3), at(4)).alias("kind"),
    )


def filter_variants(vcf: DataFrame, chrom: str | None = None, start: int | None = None, end: int | None = None, passed: bool = True, min_qual: float | None = None, kinds: Sequence[str] = (), info: Column | None = None, ids: Sequence[str] = (), by_position: bool = False) -> DataFrame:
    """Variants whose span (with ``by_position``, whose first position) meets the region and that pass the filters; ``passed`` keeps FILTER PASS or ``.``, ``ids`` those with one of the ids."""
    tests = [F.lit(True)]
    if chrom is not None:
        tests.append(F.col("chrom") == chrom)
    if start is not None:
        tests.append(F.col("pos" if by_position else "end") >= start)
    if ids:
        tests.append(F.arrays_overlap(F.split("id", ";"), F.array(*(F.lit(i) for i in ids))))
    if end is not None:
        tests.append(F.col("pos") <= end)
    if passed:
        tests.append(F.col("filter").isin("PASS", "."))
    if min_qual is not None:
        tests.append(F.col("qual") >= min_qual)
    if kinds:
        tests.append(F.col("kind").isin(*kinds))
    if info is not None:
        tests.append(info)
    for t in tests:
        vcf = vcf.where(t)
    return vcf


def genotypes(vcf: DataFrame, sample_names: Sequence[str] = ()) -> DataFrame:
    """One row per variant and sample: chrom, pos, ref, alt, sample_no, sample, gt, and ``fields`` (FORMAT key to value)."""
    names = F.array(*(F.lit(n) for n in sample_names)) if sample_names else F.array().cast("array<string>")
    rows = vcf.select("chrom", "pos", "ref", "alt", "format", F.posexplode("samples").alias("sample_no", "s"))
    values = F.split("s", ":")
    fields = F.map_from_arrays("format", F.transform("format", lambda k, i: F.get(values, i)))
    out = rows.withColumn("fields", F.when(F.size(F.array_distinct("format")) == F.size("format"), fields))
    return out.select("chrom", "pos", "ref", "alt", "sample_no", F.coalesce(F.get(names, F.col("sample_no")), F.concat(F.lit("sample_"), F.col("sample_no") + 1)).alias("sample"), F.try_element_at("fields", F.lit("GT")).alias("gt"), "fields")


def genotype_class(gt: Column) -> Column:
    """missing, hom_ref, het or hom_alt."""
    alleles = F.split(gt, r"[/|]")
    return F.when(gt.isNull() | F.exists(alleles, lambda a: a.isin(".", "")), "missing").when(F.forall(alleles, lambda a: a == "0"), "hom_ref").when(F.size(F.array_distinct(alleles)) == 1, "hom_alt").otherwise("het")


def parse_features(lines: DataFrame, line: str = "value", gtf: bool = False) -> DataFrame:
    """GFF3 or GTF lines as rows: record, source, type, start, end, score, strand, phase, attributes (map). Comments and short or impossible lines drop out."""
    f = F.split(F.col(line), "\t")
    rows = lines.where(~F.startswith(F.col(line), F.lit("#"))).select(f.alias("f")).where(F.size("f") >= 9)
    at = lambda i: F.get("f", F.lit(i))
    if gtf:
        entries = F.transform(F.regexp_extract_all(at(8), F.lit(r'\w+\s+"[^"]*"|\w+\s+[^";\s]+'), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("k"), F.regexp_replace(F.regexp_replace(x, r"^\w+\s+", ""), '"', "").alias("v")))
    else:
        entries = F.transform(F.filter(F.split(at(8), ";"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.trim(F.get(F.split(x, "=", 2), F.lit(0))).alias("k"), F.try_url_decode(F.get(F.split(x, "=", 2), F.lit(1))).alias("v")))
    keys = F.array_distinct(F.transform(F.col("e"), lambda x: x["k"]))
    joined = lambda k: F.array_join(F.transform(F.filter(F.col("e"), lambda x: x["k"] == k), lambda x: x["v"]), ",")
    out = rows.withColumn("e", entries).withColumn("attributes", F.map_from_arrays(keys, F.transform(keys, joined))).withColumns({"start": at(3).try_cast("long"), "end": at(4).try_cast("long")})
    return out.where("start >= 1 AND end >= start").select(at(0).alias("record"), at(1).alias("source"), at(2).alias("type"), "start", "end", at(5).try_cast("double").alias("score"), at(6).alias("strand"), at(7).alias("phase"), "attributes")


def features_of_type(features: DataFrame, types: Sequence[str]) -> DataFrame:
    """Features of the given types, without regard to case; no type keeps all."""
    return features.where(F.lower("type").isin(*(t.lower() for t in types))) if types else features


def overlaps_region(reference: str | None = None, start: int | None = None, end: int | None = None) -> Column:
    """Whether a mapped alignment (reference, start, end, status) overlaps a region; missing bounds are open."""
    test = ~F.contains(F.coalesce("status", F.lit("")), F.lit("unmapped"))
    if reference:
        test &= F.col("reference") == reference
    if start:
        test &= F.col("end") >= start
    if end:
        test &= F.col("start") <= end
    return test


def transcript_parts(features: DataFrame) -> DataFrame:
    """Children of each parent: parent, type, n, start, end, bp. A feature of several parents counts for each."""
    parents = features.select("type", "start", "end", F.explode(F.split(F.col("attributes")["Parent"], ",")).alias("parent"))
    return parents.groupBy("parent", "type").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start") + 1).alias("bp"))


def parse_bed(lines: DataFrame, line: str = "value") -> DataFrame:
    """BED lines as 1-based closed intervals: record, start, end, name, score, strand."""
    f = F.split(F.col(line), r"\t|\s+")
    at = lambda i: F.get("f", F.lit(i))
    rows = lines.where(~F.col(line).rlike(r"^(#|track|browser|\s*$)")).select(f.alias("f"))
    return rows.select(at(0).alias("record"), (at(1).try_cast("long") + 1).alias("start"), at(2).try_cast("long").alias("end"), at(3).alias("name"), at(4).try_cast("double").alias("score"), at(5).alias("strand")).where("start >= 1 AND end >= start")


def read_summary(reads: DataFrame) -> DataFrame:
    """Totals over reads (sequence, quality): reads, bases, lengths, GC and N percent of all bases, Q20 and Q30 percent (Phred+33)."""
    s = F.upper("sequence")
    n = lambda letters: F.sum(F.length("sequence") - F.length(F.translate(s, letters, "")))
    bases = F.sum(F.length("sequence"))
    good = lambda q: F.sum(F.length(F.regexp_replace("quality", f"[!-{chr(33 + q - 1)}]", "")))
    out = reads.agg(F.count("*").alias("n_reads"), bases.alias("n_bases"), F.min(F.length("sequence")).alias("min_length"), F.max(F.length("sequence")).alias("max_length"), F.round(n("GC") * 100 / bases, 2).alias("gc_percent"), F.round(n("N") * 100 / bases, 2).alias("n_percent"),
                    F.round(good(20) * 100 / F.sum(F.length("quality")), 2).alias("q20_percent"), F.round(good(30) * 100 / F.sum(F.length("quality")), 2).alias("q30_percent"))
    return out


def position_qualities(reads: DataFrame) -> DataFrame:
    """Per cycle: n, mean quality and quartiles, from counts per (cycle, quality)."""
    scores = reads.select(F.posexplode(F.split("quality", "")).alias("i", "q")).where("q <> ''").select((F.col("i") + 1).alias("cycle"), (F.ascii("q") - 33).alias("q")).groupBy("cycle", "q").agg(F.count("*").alias("n"))
    p = lambda x: F.percentile("q", x, F.col("n"))
    return scores.groupBy("cycle").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("q") * F.col("n")) / F.sum("n"), 6).alias("mean"), p(0.25).alias("q1"), p(0.5).alias("median"), p(0.75).alias("q3"))


def exact_duplicates(df: DataFrame, sequence: str) -> DataFrame:
    """Rows, distinct sequences and surplus copies."""
    counts = df.where(F.col(sequence).isNotNull()).groupBy(F.xxhash64(sequence).alias("_h"), sequence).agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.sum(F.col("n") - 1).alias("n_surplus"))


def binned(df: DataFrame, value: Column, low: float, high: float, step: float) -> DataFrame:
    """Counts in fixed bins from ``low`` to ``high``, outer values in the edge bins, empty bins included."""
    bins = round((high - low) / step)
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value - low) / step))).cast("int")
    counts = df.where(value.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", (F.lit(low) + F.col("bin") * step).alias("bin_start"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def record_stats(df: DataFrame, ids: Sequence[str], sequence: Column) -> DataFrame:
    """Length, GC percent, and numbers of ambiguous and gap letters of each sequence."""
    s = F.upper(sequence)
    count = lambda letters: (F.length(s) - F.length(F.translate(s, letters, ""))).cast("long")
    return df.select(*ids, F.length(s).cast("long").alias("length"), F.round(gc_percent(s), 4).alias("gc_percent"), count("RYSWKMBDHVN").alias("n_ambiguous"), count("-.").alias("n_gaps"))


def assign_lanes(df: DataFrame, group: str, start: str, end: str, ties: Sequence[str] = (), gap: int = 0) -> DataFrame:
    """Every valid interval with its ``lane`` (from 0): the first one whose last interval of the group ends more than ``gap`` positions before.

    Intervals are taken in the order of start, end and ``ties``. All lanes are free
    where nothing covers the positions before a start, so each continuous stretch of a
    group is packed on its own: its intervals stream, sorted, through one task that holds the
    ends of the lanes only. Null groups, null bounds and intervals that end before their start drop out.
    """
    rows = df.where(F.col(group).isNotNull() & (F.col(start) <= F.col(end)))
    wide = rows.select(F.col(group).alias("_k"), F.col(start).cast("long").alias("seg_start"), (F.col(end) + gap).cast("long").alias("seg_end"))
    first = periods_and_gaps(wide, ["_k"]).where("kind = 'period'").select("_k", F.col("seg_start").alias("_a"), F.lit(0).alias("_own"), F.lit(1).cast("long").alias("_mark"))
    own = rows.withColumns({"_k": F.col(group), "_a": F.col(start).cast("long"), "_b": F.col(end).cast("long"), "_own": F.lit(1), "_mark": F.lit(0).cast("long")})
    placed = ordered_totals(own.unionByName(first, allowMissingColumns=True), ["_k", "_a", "_own", "_b", *ties], ["_mark"]).where("_own = 1")
    columns = list(df.columns)
    sorted_ = placed.select(*columns, "_mark_upto", "_a", "_b").repartition("_mark_upto").sortWithinPartitions("_mark_upto", "_a", "_b", *ties)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, ends = None, np.empty(0, np.int64)
        for batch in batches:
            k = batch.num_columns
            lanes = []
            for mark, a, b in zip(*(batch.column(i).to_pylist() for i in (k - 3, k - 2, k - 1)), strict=True):
                if mark != stretch:
                    stretch, ends = mark, np.empty(0, np.int64)
                free = np.flatnonzero(ends + gap < a)
                lane = int(free[0]) if len(free) else len(ends)
                if lane == len(ends):
                    ends = np.append(ends, b)
                ends[lane] = b
                lanes.append(lane)
            yield pa.RecordBatch.from_arrays([*batch.columns[: k - 3], pa.array(lanes, pa.int32())], names=[*columns, "lane"])

    return sorted_.mapInArrow(pack, T.StructType([*df.schema.fields, T.StructField("lane", T.IntegerType())]))


def best_first(df: DataFrame, groups: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where("_r = 1").drop("_r")
