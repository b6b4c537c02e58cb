"""Guide candidates, their other targets, and fragments of circular molecules."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.seq import count_of, iupac_regex, reverse_complement
from strandloom.operators.align import stretches
from strandloom.operators.marks import BASE, BITS, bitmap_of, marked, mixed
from strandloom.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def longest_run(sequence: Column, alphabet: str = "ACGT") -> Column:
    """The length of the longest run of one letter of the alphabet; 0 without any, null for null."""
    runs = F.regexp_extract_all(sequence, F.lit("|".join(f"{c}+" for c in alphabet)), F.lit(0))
    return F.when(sequence.isNotNull(), F.aggregate(runs, F.lit(0), lambda acc, r: F.greatest(acc, F.length(r))))


def sites(df: DataFrame, record: str, sequence: str, size: int = 20, pam: str = "NGG") -> DataFrame:
    """Places of ``size`` plain letters before a PAM, both strands: record, strand, start, end (on the forward strand), guide, pam_text.

    Start and end are those of the guide. White space is dropped and U read as T; null sequences give no rows.
    """
    clean = F.translate(F.upper(F.regexp_replace(sequence, r"\s+", "")), "U", "T")
    both = F.array(F.struct(F.lit("+").alias("strand"), F.col("_s").alias("s")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("_s")).alias("s")))
    rows = df.where(F.col(sequence).isNotNull()).select(record, clean.alias("_s")).select(record, F.length("_s").alias("_n"), F.explode(both).alias("_b"))
    width = size + len(pam)
    tables = [np.array([chr(c) in letters for c in range(256)]) for letters in ("ACGT", *("".join(x for x in "ACGTU" if re.fullmatch(iupac_regex(c), x)) for c in pam))]

    def column(letters: np.ndarray) -> pa.Array:
        n, each = letters.shape
        return pa.StringArray.from_buffers(n, pa.py_buffer((np.arange(n + 1) * each).astype(np.int32)), pa.py_buffer(letters.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in stretches(batch.column(3).to_pylist(), width):
                codes = np.minimum(np.frombuffer("".join(x for _, _, x in block).encode("utf-32-le"), np.uint32), 255).astype(np.uint8)
                sizes = np.array([len(x) for _, _, x in block])
                ends = np.cumsum(sizes)
                most = len(codes) - width + 1
                plain = np.concatenate(([0], np.cumsum(tables[0][codes])))
                fits = plain[size : size + most] - plain[:most] == size
                for j, allowed in enumerate(tables[1:], size):
                    fits &= allowed[codes[j : j + most]]
                at = np.flatnonzero(fits)
                row = np.searchsorted(ends, at, "right")
                inside = at + width <= ends[row]
                row, at = row[inside], at[inside]
                found = codes[at[:, None] + np.arange(width)]
                origin, before = (np.array([x[c] for x in block])[row] for c in (0, 1))
                kept = [batch.column(c).take(pa.array(origin)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(before + at - (ends - sizes)[row] + 1), column(found[:, :size]), column(found[:, size:])], names=[record, "_n", "strand", "_at", "guide", "pam_text"])

    found = rows.select(record, "_n", "_b.strand", "_b.s").mapInArrow(run, f"`{record}` {dict(rows.dtypes)[record]}, _n int, strand string, _at long, guide string, pam_text string")
    start = F.when(F.col("strand") == "+", F.col("_at")).otherwise(F.col("_n") - F.col("_at") - size + 2)
    return found.select(record, "strand", start.alias("start"), (start + size - 1).alias("end"), "guide", "pam_text")


def rated(found: DataFrame, low: float = 35, high: float = 75) -> DataFrame:
    """Guides with gc_percent between the limits, longest_run, has_tttt and a review score.

    The score starts at 100; a GC share outside 40 to 60 % costs 1.2 a point from 50 (35 at most),
    a run of four and more letters 8 for each letter beyond three, a TTTT 18.
    """
    gc = count_of(F.col("guide"), "GC") * 100 / F.length("guide")
    rows = found.withColumns({"gc_percent": gc, "longest_run": longest_run(F.col("guide")), "has_tttt": F.contains("guide", F.lit("TTTT"))}).where(F.col("gc_percent").between(low, high))
    # fixed values: the weights of the review score
    cost = (
        F.when(F.col("gc_percent").between(40, 60), 0.0).otherwise(F.least(F.lit(35.0), F.abs(F.col("gc_percent") - 50) * 1.2))
        + F.greatest(F.lit(0), F.col("longest_run") - 3) * 8
        + F.when(F.col("has_tttt"), 18).otherwise(0)
    )
    return rows.withColumn("score", F.round(F.greatest(F.lit(0.0), 100 - cost), 1))


def hashed_pieces(texts: list[str], parts: int, choices: list[tuple[int, ...]]) -> np.ndarray:
    """Of each text, cut into ``parts`` pieces of nearly one length, a hash for each choice of pieces."""
    out = np.empty((len(choices), len(texts)), np.uint64)
    sizes = np.array([len(t) for t in texts])
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        codes = np.frombuffer("".join(texts[r] for r in rows.tolist()).encode("utf-32-le"), np.uint32).reshape(len(rows), size).T.astype(np.uint64)
        pieces = []
        for i in range(parts):
            h = np.zeros(len(rows), np.uint64)
            for letters in codes[size * i // parts : size * (i + 1) // parts]:
                h = h * np.uint64(BASE) + letters
            pieces.append(h)
        known = {(): np.ones(len(rows), np.uint64)}
        for no, choice in enumerate(choices):
            for i in range(1, len(choice) + 1):
                if choice[:i] not in known:
                    known[choice[:i]] = mixed(mixed(known[choice[: i - 1]] + np.uint64(choice[i - 1] + 1)) + pieces[choice[i - 1]])
            out[no, rows] = known[choice]
    return out


def off_targets(guides: DataFrame, targets: DataFrame, mismatches: int = 2) -> DataFrame:
    """How many targets lie within a number of mismatches of each guide: guide, n_mismatches, n_sites.

    Both tables have a column ``guide`` of texts of one length. With m mismatches three of m + 3
    pieces are unharmed, so each text meets the guides that share three pieces with it; a pair that shares
    several threes is kept at the first one only. The threes of the guides are marked by their hashes in a bitmap
    of fixed size, and targets without a marked one drop out before they are moved; equal ones of the rest
    are counted. Every pair within the limit is found. Null texts match nothing.
    """
    parts = mismatches + 3
    choices = list(combinations(range(parts), 3))
    queries = written(guides.where("guide IS NOT NULL").select("guide").distinct())

    def filed(df: DataFrame, bitmap: Broadcast | None = None) -> DataFrame:
        """The rows, whose first column is the text, under the number and hash of each (marked) three of pieces."""
        names = [*df.columns, "no", "key"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = hashed_pieces(batch.column(0).to_pylist(), parts, choices)
                no, row = np.nonzero(np.ones(h.shape, bool) if bitmap is None else marked(bitmap.value, h))
                kept = [c.take(pa.array(row)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(no.astype(np.int32)), pa.array(h[no, row].view(np.int64))], names=names)

        return df.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", no int, key long")

    asked = filed(queries)
    bitmap = queries.sparkSession.sparkContext.broadcast(bitmap_of(asked.select(F.shiftrightunsigned("key", 64 - BITS).alias("place"))))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(bitmap.value, hashed_pieces(batch.column(0).to_pylist(), parts, choices)).any(axis=0)))

    near_by = targets.where("guide IS NOT NULL").select(F.col("guide").alias("target")).mapInArrow(possible, "target string")
    texts = near_by.groupBy("target").agg(F.count("*").alias("n"))
    met = asked.hint("merge").join(filed(texts, bitmap), ["no", "key"])

    def piece(text: str, i: int) -> Column:
        n = F.length(text)
        a = F.floor(n * i / parts).cast("int")
        return F.substring(F.col(text), a + 1, F.floor(n * (i + 1) / parts).cast("int") - a)

    letters = lambda c: F.regexp_extract_all(F.col(c), F.lit("."), F.lit(0))
    differ = F.size(F.filter(F.zip_with(letters("guide"), letters("target"), lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    near = met.withColumn("n_mismatches", differ).where(F.col("n_mismatches") <= mismatches)
    same = near.withColumns({f"_{i}": piece("guide", i) == piece("target", i) for i in range(parts)})
    first = F.coalesce(*(F.when(F.col(f"_{x}") & F.col(f"_{y}") & F.col(f"_{z}"), F.lit(no)) for no, (x, y, z) in enumerate(choices)))
    return same.where(F.col("no") == first).groupBy("guide", "n_mismatches").agg(F.sum("n").alias("n_sites"))


def circular_fragments(found: DataFrame, lengths: DataFrame, offset: int = 1) -> DataFrame:
    """Fragments of circular molecules between cuts, each ``offset`` letters behind a site's start: record_id, start, end, length.

    The fragment over the origin has an end before its start. A molecule cut once has one
    fragment of full length, one without cuts is returned whole, as 1 to its length. Cuts on the far side of the origin wrap.
    """
    place = F.pmod(F.col("start") + offset - 2, F.col("length")) + 1
    cuts = found.select("record_id", "start").join(lengths.where("length > 0"), "record_id").select("record_id", "length", place.alias("cut")).distinct()
    order = Window.partitionBy("record_id").orderBy("cut")
    whole = Window.partitionBy("record_id")
    after = F.coalesce(F.lag("cut").over(order), F.max("cut").over(whole))
    n = F.col("length")
    cut = cuts.withColumn("_after", after).select("record_id", (F.pmod(F.col("_after"), n) + 1).alias("start"), F.col("cut").alias("end"), (F.pmod(F.col("cut") - F.col("_after") - 1, n) + 1).alias("length"))
    uncut = lengths.where("length > 0").join(found.select("record_id").distinct(), "record_id", "left_anti").select("record_id", F.lit(1).cast("long").alias("start"), F.col("length").cast("long").alias("end"), F.col("length").cast("long").alias("length"))
    return cut.unionByName(uncut)
