"""Sequence records: selection by id, filters with reasons, renaming, validation, position weight scans."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.exprs import natural_key
from strandloom.functions.seq import count_of, gc_percent
from strandloom.operators.grouping import with_group_figures
from strandloom.sources.writers import fasta_text, gff3_lines

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def record_name(title: Column) -> Column:
    """The first word of a title without a leading ``>``; null where there is none."""
    name = F.regexp_extract(F.coalesce(title, F.lit("")), r"^>?\s*(\S+)", 1)
    return F.when(name != "", name)


def extract_by_id(records: DataFrame, ids: DataFrame, title: str = "title", keep: bool = True) -> DataFrame:
    """Records whose first title word is (or, with ``keep=False``, is not) in the one-column ``ids``; case counts. Records without a name are in no list."""
    wanted = ids.select(F.trim(F.col(ids.columns[0])).alias("_wanted")).where("_wanted <> ''").distinct()
    return records.withColumn("_name", record_name(F.col(title))).join(wanted, F.col("_name") == F.col("_wanted"), "left_semi" if keep else "left_anti").select(*records.columns)


def with_reasons(records: DataFrame, sequence: str = "sequence", least: int | None = None, most: int | None = None, min_gc: float | None = None, max_gc: float | None = None, max_ambiguous: int | None = None) -> DataFrame:
    """Adds ``reasons``, the broken limits joined by ``; `` (blank: the record passes). A null sequence has length 0 and no GC."""
    s = F.upper(F.regexp_replace(F.coalesce(F.col(sequence), F.lit("")), r"\s+", ""))
    n, gc, ambiguous = F.length(s), gc_percent(s), F.length(s) - F.length(F.translate(s, "RYSWKMBDHVN", ""))
    tests = []
    if least is not None:
        tests.append(F.when(n < least, "too short"))
    if most is not None:
        tests.append(F.when(n > most, "too long"))
    if min_gc is not None:
        tests.append(F.when(gc < min_gc, "GC too low"))
    if max_gc is not None:
        tests.append(F.when(gc > max_gc, "GC too high"))
    if max_ambiguous is not None:
        tests.append(F.when(ambiguous > max_ambiguous, "too ambiguous"))
    return records.withColumn("reasons", F.concat_ws("; ", *tests) if tests else F.lit(""))


def trim_poly_ends(sequence: Column, letter: str = "A", least: int = 10) -> Column:
    """The sequence without a run of at least ``least`` of a letter at its end."""
    return F.regexp_replace(sequence, f"(?i){letter}{{{least},}}$", "")


def rename(records: DataFrame, title: str, pattern: str, replacement: str, prefix: str = "") -> DataFrame:
    """Replaces in titles by a regular expression and sets a prefix; null titles stay null."""
    return records.withColumn(title, F.concat(F.lit(prefix), F.regexp_replace(F.col(title), pattern, replacement)))


def validate(records: DataFrame, key: str, title: str = "title", sequence: str = "sequence", letters: str = "ACGTURYSWKMBDHVN-.*") -> DataFrame:
    """One row per record and problem: key, problem (no name, repeated name, empty sequence, illegal letters)."""
    named = records.select(key, record_name(F.col(title)).alias("_name"), F.upper(F.regexp_replace(F.coalesce(F.col(sequence), F.lit("")), r"\s+", "")).alias("_s"))
    salt = F.pmod(F.xxhash64(key), F.lit(64))
    twice = with_group_figures(named.where("_name IS NOT NULL").select(key, "_name"), ["_name"], salt, {"part": F.count("*")}, {"n": F.sum("part")}).where("n > 1").select(key, F.lit("repeated name").alias("problem"))
    own = F.array_compact(F.array(F.when(F.col("_name").isNull(), "no name"), F.when(F.col("_s") == "", "empty sequence"), F.when(F.translate("_s", letters, "") != "", "illegal letters")))
    return named.select(key, F.explode(own).alias("problem")).unionByName(twice)


def scan_weights(records: DataFrame, record: str, sequence: str, weights: dict[str, Sequence[float]], threshold: float) -> DataFrame:
    """Places where a position weight matrix reaches a share of its score range: record_id, start, end, score, relative.

    ``weights`` has one score per position for A, C, G and T; other letters score the
    lowest of their position. relative = (score - min) / (max - min) >= threshold.
    """
    table = np.array([weights[c] for c in "ACGT"], dtype=float)
    low, high, width = table.min(0).sum(), table.max(0).sum(), table.shape[1]
    scores = np.vstack([table, table.min(0)])
    codes = np.full(256, 4)
    codes[[ord(c) for c in "ACGT"]] = range(4)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, found = [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                letters = codes[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
                n = len(letters) - width + 1
                if n < 1:
                    continue
                total = np.zeros(n)
                for j in range(width):
                    total += scores[letters[j : j + n], j]
                hit = np.flatnonzero((total - low) / (high - low) >= threshold) if high > low else np.arange(0)
                ids.append(np.full(len(hit), row, np.int64))
                starts.append(hit.astype(np.int64) + 1)
                found.append(total[hit])
            if ids:
                a, b, c = np.concatenate(ids), np.concatenate(starts), np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(b + width - 1), pa.array(c), pa.array((c - low) / (high - low))], names=["record_id", "start", "end", "score", "relative"])

    rows = records.where(F.col(sequence).isNotNull()).select(F.col(record).cast("long").alias("record_id"), F.translate(F.upper(F.regexp_replace(sequence, r"\s+", "")), "U", "T").alias("s"))
    return rows.mapInArrow(scan, "record_id long, start long, end long, score double, relative double")


def parse_regions(regions: DataFrame, text: str = "region") -> DataFrame:
    """Regions ``name:start-end``, ``name:start`` or ``name`` as name, region_start, region_end; thousands separators are dropped, missing bounds null, blank texts left out."""
    rows = regions.select(F.regexp_replace(text, r"[\s,]", "").alias("_t")).where("_t <> ''")
    bound = lambda i: F.nullif(F.regexp_extract("_t", r":([0-9]+)(?:-([0-9]+))?$", i), F.lit("")).try_cast("long")
    return rows.select(F.regexp_replace("_t", r":[0-9]+(?:-[0-9]+)?$", "").alias("name"), bound(1).alias("region_start"), bound(2).alias("region_end"))


def fetch_regions(records: DataFrame, regions: DataFrame, name: str = "name", sequence: str = "sequence") -> DataFrame:
    """The letters of each region in each record of its name: name, region_start, region_end, letters.

    ``regions`` has name, region_start, region_end; missing bounds are the record's ends, bounds outside are moved inside, and a
    region outside altogether gives no row. Records of one name all answer; null names and sequences match nothing.
    """
    found = records.where(F.col(sequence).isNotNull()).select(F.col(name).alias("name"), F.regexp_replace(sequence, r"\s+", "").alias("_s")).join(regions.select("name", "region_start", "region_end"), "name")
    n = F.length("_s").cast("long")
    inside = found.select("name", "_s", F.greatest(F.coalesce("region_start", F.lit(1).cast("long")), F.lit(1).cast("long")).alias("region_start"), F.least(F.coalesce("region_end", n), n).alias("region_end")).where("region_start <= region_end")
    size = (F.col("region_end") - F.col("region_start") + 1).cast("int")
    return inside.select("name", "region_start", "region_end", F.substring(F.col("_s"), F.col("region_start").cast("int"), size).alias("letters"))


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """What became of each key between two tables: keys, change (added, removed, changed, same), changed (names of the differing columns).

    Two nulls are equal; null keys match each other. Give each key once on either side; a repeated one is compared with every
    row of that key.
    """
    side = lambda df, mark: df.select(*keys, F.struct(*values).alias(mark))
    a, b = side(before, "_a").alias("a"), side(after, "_b").alias("b")
    same_key = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.join(b, same_key, "full").select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), "_a", "_b")
    differing = F.filter(F.array(*(F.when(~F.col(f"_a.{v}").eqNullSafe(F.col(f"_b.{v}")), F.lit(v)) for v in values)), lambda x: x.isNotNull())
    paired = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    named = F.when(paired, differing).otherwise(F.array().cast("array<string>"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(named) > 0, "changed").otherwise("same")
    return both.select(*keys, change.alias("change"), F.array_join(named, ",").alias("changed"))


def edit_letters(sequence: Column, start: Column, end: Column, text: Column) -> Column:
    """The sequence with the letters ``start`` to ``end`` replaced by ``text``; ``end`` = ``start`` - 1 inserts, an empty text deletes. A place outside 1 to n + 1 leaves it unchanged."""
    a, b = start.cast("int"), end.cast("int")
    fits = (a >= 1) & (b >= a - 1) & (b <= F.length(sequence))
    return F.when(fits, F.concat(F.left(sequence, a - 1), text, F.substring(sequence, b + 1, F.length(sequence)))).otherwise(sequence)


def moved_place(start: Column, end: Column, edit_start: Column, edit_end: Column, text: Column) -> Column:
    """Struct (start, end) of a feature after an edit: behind it, it shifts; around it, it grows or shrinks; one that lies in replaced letters becomes null, a partly replaced one keeps its rest."""
    by = F.length(text) - (edit_end - edit_start + 1)
    place = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    return (
        F.when(end < edit_start, place(start, end))
        .when(start > edit_end, place(start + by, end + by))
        .when((start < edit_start) & (end > edit_end), place(start, end + by))
        .when((start >= edit_start) & (end <= edit_end), None)
        .when(start < edit_start, place(start, edit_start - 1))
        .otherwise(place(edit_start + F.length(text), end + by))
    )


def sort_records(records: DataFrame, mode: str = "length-desc", title: str = "title", sequence: str = "sequence") -> DataFrame:
    """Records ordered by length, title, gc or ambiguous, each with ``-asc`` or ``-desc``; ties by title in natural order. Null sequences count as empty, missing GC as -1."""
    s = F.coalesce(F.col(sequence), F.lit(""))
    name = natural_key(F.col(title))
    keys = {"length": F.length(s), "title": name, "gc": F.coalesce(gc_percent(s), F.lit(-1.0)), "ambiguous": count_of(F.upper(s), "RYSWKMBDHVNX")}
    by, _, way = mode.rpartition("-")
    if by not in keys or way not in ("asc", "desc"):
        raise ValueError(f"unknown order {mode!r}")
    return records.orderBy(keys[by].desc() if way == "desc" else keys[by].asc(), name, title)


def id_list(text: str) -> list[str]:
    """Record ids of a pasted list: separated by line breaks, commas, semicolons or tabs; ``#`` lines are comments, ``>`` before an id is dropped."""
    lines = [line for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if not line.strip().startswith("#")]
    return [p for line in lines for part in re.split(r"[,;\t]", line) if (p := part.strip().lstrip(">").strip())]


def gff3_bundle(records: DataFrame, features: DataFrame, name: str = "name", sequence: str = "sequence") -> DataFrame:
    """Features and the letters of their records as GFF3 with a FASTA part: part (0 head, 1 features, 2 FASTA mark, 3 records), name, value, to be written in this order.

    Features (see ``writers.gff3_lines``) whose record is not there drop out; records without features stay.
    """
    known = records.where(F.col(name).isNotNull() & F.col(sequence).isNotNull()).select(F.col(name).alias("name"), F.col(sequence).alias("_s"))
    kept = features.join(known.select(F.col("name").alias("record")).distinct(), "record", "left_semi")
    lines = gff3_lines(kept).select(F.lit(1).alias("part"), F.substring_index("value", "\t", 1).alias("name"), "value")
    letters = known.select(F.lit(3).alias("part"), "name", fasta_text(F.col("name"), F.col("_s")).alias("value"))
    marks = records.sparkSession.createDataFrame([(0, "", "##gff-version 3"), (2, "", "##FASTA")], "part int, name string, value string")
    return marks.unionByName(lines).unionByName(letters)
