"""Alignment of pairs, and word matches along diagonals."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.seq import reverse_complement
from strandloom.operators.grouping import spread_join
from strandloom.operators.marks import bitmap_of, marked, mixed, places, rolled
from strandloom.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _pick(*options: np.ndarray) -> np.ndarray:
    """Column by column the option (score, matches, length) with the highest score, the earlier one on ties."""
    best = options[0]
    for other in options[1:]:
        best = np.where(other[0] > best[0], other, best)
    return best


def affine(a: str, b: str, match: float, mismatch: float, opening: float, extension: float, local: bool) -> tuple[float, int, int]:
    """Score, matches and columns of the best alignment; a gap of n letters costs opening + n * extension.

    One row of cells is kept, each with the figures of its best path, so memory grows with the shorter text's length only.
    """
    if len(b) > len(a):
        a, b = b, a
    x, y, n = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32), len(b)
    at = np.arange(n + 1)
    row = np.zeros((3, n + 1))
    if not local:
        row[0, 1:], row[2] = -opening - extension * at[1:], at
    down = np.vstack([np.full(n + 1, -np.inf), np.zeros((2, n + 1))])
    best = np.zeros(3)
    for i, letter in enumerate(x, 1):
        down = _pick(row - np.array([[opening + extension], [0], [-1]]), down - np.array([[extension], [0], [-1]]))
        same = y == letter
        step = np.zeros((3, n + 1))
        step[:, 1:] = row[:, :-1] + np.vstack([np.where(same, match, -mismatch), same, np.ones(n)])
        step[:, 0] = 0 if local else down[:, 0]
        row = _pick(step, down)
        if local:
            row = _pick(row, np.zeros((3, n + 1)))
        # gaps along the row: the best cell to the left, its gap growing by one a column
        level = row[0] + extension * at
        first = np.maximum.accumulate(np.where(level > np.maximum.accumulate(np.concatenate(([-np.inf], level[:-1]))), at, 0))
        across = np.full((3, n + 1), -np.inf)
        source = first[:-1]
        across[:, 1:] = np.vstack([level[source] - opening - extension * at[1:], row[1][source], row[2][source] + at[1:] - source])
        row = _pick(row, across)
        if local:
            top = int(row[0].argmax())
            if row[0, top] > best[0]:
                best = row[:, top]
    score, matches, columns = best if local else row[:, -1]
    return float(score), int(matches), int(columns)


def align_pairs(pairs: DataFrame, left: str, right: str, match: float = 2, mismatch: float = 1, opening: float = 4, extension: float = 1, local: bool = False) -> DataFrame:
    """Aligns two text columns row by row with affine gaps: all columns, plus score, n_matches, n_columns, identity (null without columns).

    Case does not count. Ties go to the pairing of letters, then to a gap in the
    shorter text. A null side gives nulls, an empty side only gaps. Spark spreads
    the pairs; find them by an index (``scan.reciprocal_best``, ``diagonals``), not by a cross join.
    """
    out = "score double, n_matches long, n_columns long"
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ls, rs = batch.column(names.index(left)).to_pylist(), batch.column(names.index(right)).to_pylist()
            got = [(None, None, None) if a is None or b is None else affine(a.upper(), b.upper(), match, mismatch, opening, extension, local) for a, b in zip(ls, rs, strict=True)]
            columns = list(zip(*got, strict=True)) or [[], [], []]
            kinds = (pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*names, "score", "n_matches", "n_columns"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, f"{fields}, {out}").withColumn("identity", F.round(F.col("n_matches") / F.when(F.col("n_columns") > 0, F.col("n_columns")), 4))


def stretches(texts: list[str | None], k: int, letters: int = 1 << 16) -> Iterator[list[tuple[int, int, str]]]:
    """Blocks of (number of the text, place before the stretch, stretch) with every run of ``k`` letters once.

    A block has about ``letters`` letters; longer texts are cut, their stretches having k - 1 letters in common.
    """
    block, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or "") - k + 1, letters):
            block.append((i, at, text[at : at + letters + k - 1]))
            size += len(block[-1][2])
            if size >= letters:
                yield block
                block, size = [], 0
    if block:
        yield block


def words_in(block: list[tuple[int, int, str]], k: int, bitmap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of ``k`` letters in a block, or those with a marked hash: number of the stretch, place in it (from 0), hash."""
    codes = np.frombuffer("".join(s for _, _, s in block).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(s) for _, _, s in block])
    ends = np.cumsum(sizes)
    h = mixed(rolled(codes, k))
    at = np.arange(len(h)) if bitmap is None else np.flatnonzero(marked(bitmap, h))
    row = np.searchsorted(ends, at, "right")
    inside = at + k <= ends[row]
    row, at = row[inside], at[inside]
    return row, at - (ends - sizes)[row], h[at]


def diagonals(a: DataFrame, b: DataFrame, k: int = 12) -> DataFrame:
    """Runs of equal letters of two sets of (key, sequence), as in a dot plot: key_a, key_b, start_a, start_b, length (>= k).

    The words of ``k`` letters of ``b`` are marked in a bitmap of fixed size; only words of ``a`` with a marked
    hash are written, and meet those of ``b`` in an equi-join by their letters, the places of a frequent word of ``a`` being spread over salts;
    neighbouring words of a diagonal are one run. Nothing is broadcast but the bitmap. Equal texts of ``b`` are compared once. Case does not count;
    short and null sequences have no words. Give ``a`` each key once, and likewise ``b``.
    """
    spark = a.sparkSession
    upper = F.upper("sequence").alias("sequence")
    named = b.where(F.length("sequence") >= k).select("key", upper)
    texts = named.groupBy("sequence").agg(F.min("key").alias("key")).select("key", "sequence")

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in stretches(batch.column(0).to_pylist(), k):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(places(words_in(block, k)[2])))], names=["place"])

    shared = spark.sparkContext.broadcast(bitmap_of(named.select("sequence").mapInArrow(places_of, "place long")))

    def words_of(df: DataFrame, side: str, those_marked: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in stretches(batch.column(1).to_pylist(), k):
                    row, at, _ = words_in(block, k, shared.value if those_marked else None)
                    origin, before = (np.array([x[c] for x in block])[row] for c in (0, 1))
                    words = [block[r][2][i : i + k] for r, i in zip(row.tolist(), at.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(origin)), pa.array(before + at + 1), pa.array(words, pa.string())], names=[f"key_{side}", f"at_{side}", "word"])

        return df.mapInArrow(run, f"key_{side} {dict(df.dtypes)['key']}, at_{side} long, word string").hint("merge")

    met_a = written(words_of(a.where(F.length("sequence") >= k).select("key", upper), "a", True)).hint("merge")
    met = spread_join(met_a, words_of(texts, "b", False), ["word"], F.pmod(F.xxhash64("key_a", "at_a"), F.lit(16)))
    hits = met.select("key_a", "key_b", "at_a", (F.col("at_a") - F.col("at_b")).alias("shift"))
    order = Window.partitionBy("key_a", "key_b", "shift").orderBy("at_a")  # at most as many rows as the shorter text has words
    runs = hits.withColumn("run", F.col("at_a") - F.row_number().over(order))
    found = runs.groupBy("key_a", "key_b", "shift", "run").agg(F.min("at_a").alias("start_a"), F.count("*").alias("_n"))
    again = spread_join(named.hint("merge"), texts.withColumnRenamed("key", "key_b"), ["sequence"], F.pmod(F.xxhash64("key"), F.lit(16))).select("key_b", "key")
    return found.join(again.hint("merge"), "key_b").select("key_a", F.col("key").alias("key_b"), "start_a", (F.col("start_a") - F.col("shift")).alias("start_b"), (F.col("_n") + k - 1).alias("length"))


def extended(a: str, b: str, i: int, j: int, n: int, penalty: int, drop: int) -> tuple[int, int]:
    """First and last place in ``a`` (from 0) of an equal run of ``n`` letters at i and j, extended both ways without gaps.

    A letter counts 1 or ``-penalty``; each side ends at its best sum, and stops when it falls more than ``drop`` below that.
    """

    def reach(step: int, x: int, y: int, most: int) -> int:
        total = best = far = 0
        for k in range(1, most + 1):
            total += 1 if a[x + step * k] == b[y + step * k] else -penalty
            if total > best:
                best, far = total, k
            if best - total > drop:
                break
        return far

    return i - reach(-1, i, j, min(i, j)), i + n - 1 + reach(1, i + n - 1, j + n - 1, min(len(a) - i, len(b) - j) - n)


def similar_stretches(records: DataFrame, references: DataFrame, k: int = 11, least: int = 30, identity: float = 90.0, penalty: int = 5, drop: int = 12, same: float = 0.8) -> DataFrame:
    """Stretches of (key, sequence) records that resemble references (key, sequence) of either strand, without gaps: contaminations.

    Equal runs of ``k`` nucleotides seed a stretch, which is extended both ways
    (``extended``); it counts with ``least`` letters and ``identity`` percent. Of
    stretches of one record, reference and strand that share ``same`` of the shorter one, the one
    of the best score (length - ``penalty`` x mismatches) stays, ties by length and place.

    Returns key, reference, strand, start, end (on the record as stored), reference_start,
    reference_end, mismatches, identity, score. Runs of a pair are bounded by its two texts. Letters other than nucleotides drop out first.
    """
    letters = lambda c: F.translate(F.regexp_replace(F.upper(c), "[^ACGTURYSWKMBDHVN]+", ""), "U", "T")
    plus = records.where(F.col("sequence").isNotNull()).select("key", F.lit("+").alias("strand"), letters("sequence").alias("s"))
    both = plus.unionByName(plus.select("key", F.lit("-").alias("strand"), reverse_complement(F.col("s")).alias("s")))
    targets = references.where(F.col("sequence").isNotNull()).select(F.col("key").alias("reference"), letters("sequence").alias("t"))
    runs = diagonals(both.select(F.struct("key", "strand").alias("key"), F.col("s").alias("sequence")), targets.select(F.col("reference").alias("key"), F.col("t").alias("sequence")), k)
    seeds = runs.groupBy(F.col("key_a.key").alias("key"), F.col("key_a.strand").alias("strand"), F.col("key_b").alias("reference")).agg(F.collect_list(F.struct("start_a", "start_b", "length")).alias("runs"))
    pairs = seeds.join(both, ["key", "strand"]).join(targets, "reference").select("key", "reference", "strand", "s", "t", "runs")

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = re.compile(f"[ACGT]{{{k}}}")  # a run of ambiguous letters seeds nothing
        for batch in batches:
            origin, out = [], []
            for row, (strand, s, t, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)):
                seen = set()
                for run in found:
                    i, j, n = run["start_a"] - 1, run["start_b"] - 1, run["length"]
                    if plain.search(s, i, i + n):
                        first, last = extended(s, t, i, j, n, penalty, drop)
                        seen.add((first, last, j - i + first))
                kept: list[tuple[int, int, int, int, int]] = []
                rated = []
                for first, last, at in seen:
                    n = last - first + 1
                    wrong = sum(x != y for x, y in zip(s[first : last + 1], t[at : at + n], strict=True))
                    if n >= least and round((n - wrong) / n * 100, 2) >= identity:
                        a, b = (first + 1, last + 1) if strand == "+" else (len(s) - last, len(s) - first)
                        rated.append((penalty * wrong - n, -n, a, b, at + 1, wrong))
                for score, n, a, b, at, wrong in sorted(rated):
                    if all(min(b, d) - max(a, c) + 1 < same * min(b - a, d - c) + same for c, d, *_ in kept):
                        kept.append((a, b, at, wrong, -score))
                origin += [row] * len(kept)
                out += [(a, b, at, at + b - a, wrong, round((b - a + 1 - wrong) / (b - a + 1) * 100, 2), score) for a, b, at, wrong, score in kept]
            if out:
                taken = [batch.column(c).take(pa.array(origin)) for c in range(3)]
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, x) for c, x in zip(columns, kinds, strict=True))], names=["key", "reference", "strand", "start", "end", "reference_start", "reference_end", "mismatches", "identity", "score"])

    kinds = dict(pairs.dtypes)
    schema = f"key {kinds['key']}, reference {kinds['reference']}, strand string, start long, end long, reference_start long, reference_end long, mismatches long, identity double, score long"
    return pairs.mapInArrow(stretch, schema)
