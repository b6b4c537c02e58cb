"""Long exact spans shared between records, located by sharded Aho-Corasick automata."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.words import without_space
from strandloom.operators.grouping import with_group_figures
from strandloom.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Letters of a seed. A window of ``span`` letters is filed under the smallest seed hash in it.
SEED = 24
#: Letters of text that should stream through one automaton; its passages are cut from the same text.
SHARD_LETTERS = 400_000
SALTS = 64
#: Letters that a task cuts at a time; a longer text makes a block of its own.
BLOCK_LETTERS = 1_000_000


def seed_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k letters, in wrapping arithmetic."""
    with np.errstate(over="ignore"):
        x, have_width, bits = None, 0, k
        out, width, factor = codes.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
        while True:  # by doubling: out has the hashes of width letters, x those of the lower bits of k
            if bits & 1:
                n = max(0, len(codes) - have_width - width + 1)
                x = out if x is None else x[:n] * factor + out[have_width:][:n]
                have_width += width
            bits >>= 1
            if not bits:
                break
            out = out[: max(0, len(out) - width)] * factor + out[width:]
            factor, width = factor * factor, width * 2
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every w neighbours."""
    m, width = h, 1
    while width * 2 <= w:
        m = np.minimum(m[:-width], m[width:]) if len(m) > width else m[:0]
        width *= 2
    rest = w - width
    return (np.minimum(m[:-rest], m[rest:]) if len(m) > rest else m[:0]) if rest else m


def stretches(span: int, seed: int):
    """For ``mapInArrow``: (row, text) to runs of windows with one seed hash: row, first (window, from 0), n (windows), seed. Texts have ``span`` letters at least.

    The texts of a block lie behind one another in one array, so the kernels run once per block.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            block = np.cumsum(sizes) // BLOCK_LETTERS
            edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                codes = np.frombuffer("".join(texts[i:j]).encode("utf-32-le"), np.uint32)
                ends = np.cumsum(sizes[i:j])
                starts = ends - sizes[i:j]
                m = window_minima(seed_hashes(codes, seed), span - seed + 1)
                fresh = np.empty(len(m), bool)
                fresh[0] = True
                np.not_equal(m[1:], m[:-1], out=fresh[1:])
                fresh[starts] = True
                if span > 1:  # windows that reach into the next text
                    fresh[(ends[:-1, None] - np.arange(1, span)).ravel()] = False
                firsts = np.flatnonzero(fresh)
                of = np.searchsorted(ends, firsts, side="right")
                n = np.minimum(np.append(firsts[1:], len(m)), ends[of] - span + 1) - firsts
                columns = [pa.array(rows[i:j][of]), pa.array((firsts - starts[of]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(m[firsts].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "first", "n", "seed"])

    return cut


def cut_out(span: int):
    """For ``mapInArrow``: (row, text, [(first, n, seed, letters)]) to one row per stretch with its letters."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(1).to_pylist(), batch.column(2)
            each = lists.flatten()
            sizes = np.asarray(lists.value_lengths())
            first, n = (each.field(c).to_numpy(zero_copy_only=False) for c in ("first", "n"))
            of = np.repeat(np.arange(len(texts)), sizes)
            parts = [texts[i][a:b] for i, a, b in zip(of.tolist(), first.tolist(), (first + n + span - 1).tolist(), strict=True)]
            columns = [pa.array(batch.column(0).to_numpy(zero_copy_only=False)[of]), pa.array(first), each.field("seed"), each.field("letters"), pa.array(parts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "first", "seed", "letters", "stretch"])

    return cut


def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, passages before texts: one automaton per shard, through which its texts stream.

    Yields the covered runs of each text, from its first to its last covered letter.
    """
    shard, words, automaton = None, [], None
    for batch in batches:
        kinds, shards = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows, firsts, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
        out: list[tuple[int, int, int]] = []
        for kind, s, row, first, text in zip(kinds, shards, rows, firsts, texts, strict=True):
            if s != shard:
                shard, words, automaton = s, [], None
            if kind == 0:
                words.append(text)
                continue
            if automaton is None:
                automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
                for w in words:
                    automaton.add_word(w)
                automaton.make_automaton()
                words = []
            if not len(automaton):
                continue
            runs: list[list[int]] = []
            for last, length in automaton.iter(text):  # endings never go back; a longer passage may reach over earlier runs
                a = last - length + 1
                while runs and a <= runs[-1][1] + 1:
                    a = min(a, runs.pop()[0])
                runs.append([a, last])
            out.extend((row, first + a + 1, first + b + 1) for a, b in runs)
        if out:
            r, a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["row", "a", "b"])


def shared_spans(texts: DataFrame, patterns: DataFrame, span: int = 50, seed: int = SEED) -> DataFrame:
    """The longest runs of positions that lie in ``span`` letters found verbatim in another row or in a pattern.

    ``texts`` has (row, text) with unique non-negative longs, ``patterns`` one
    column of texts. White space is dropped, everything else compares as stored.

    1. Each window of ``span`` letters is filed under the smallest hash of its
       ``seed``-letter parts; equal windows get equal seeds. Neighbouring windows
       of one seed form a stretch, the unit that moves.
       Stretches are written once as numbers (row, place, size, seed); their letters
       stay where they are.
    2. Seeds that occur in one row only drop out; the rows of a hot seed are split by
       Spark's skew join. Each text that is left is shuffled once, by row, and its
       stretches are cut out. Passages are confirmed: a stretch or window counts if it
       occurs in two different rows (or a row and a pattern).
    3. Passages are compiled into Aho-Corasick automata sharded by seed, and all
       stretches filed under a shard's seeds stream through its automaton.

    The windows of a hot seed, one with more text than a shard should stream, are
    filed once more, each under its own hash; if the same window is still hot,
    its one passage goes to several parts among which its rows are spread.

    Returns ``row``, ``span_start``, ``span_end``, 1-based and inclusive in the text
    without white space. Null and short texts give no rows; a row that repeats only
    itself shares nothing. Rows of one number must have one text.
    """
    rows = texts.select(F.col(texts.columns[0]).cast("long").alias("row"), without_space(F.col(texts.columns[1])).alias("text"))
    ids = patterns.select(without_space(F.col(patterns.columns[0])).alias("text")).where("text IS NOT NULL").distinct()
    others = ids.select((-1 - F.shiftright(F.xxhash64("text"), 1).bitwiseAND(F.lit((1 << 62) - 1))).alias("row"), "text")
    source = rows.unionByName(others).where(F.length("text") >= span)
    cut = written(source.mapInArrow(stretches(span, seed), "row long, first int, n int, seed long"))
    letters = F.sum(F.col("n").cast("long") + (span - 1))
    seeds = cut.groupBy("seed").agg(F.min("row").alias("low"), F.max("row").alias("high"), letters.alias("letters")).where("low <> high").select("seed", "letters")
    # stretches of a row are bounded by its length
    kept = cut.join(seeds, "seed").groupBy("row").agg(F.collect_list(F.struct("first", "n", "seed", "letters")).alias("kept"))
    repeated = written(source.join(kept, "row").select("row", "text", "kept").mapInArrow(cut_out(span), "row long, first int, seed long, letters long, stretch string"))
    columns = ["row", "first", "seed", "letters", "stretch"]
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    pieces = F.transform(F.regexp_extract_all("stretch", F.lit(f"(?s)(?=(.{{{span}}}))."), F.lit(1)), lambda w, i: F.struct(i.alias("i"), w.alias("w")))  # all windows in one pass
    hot = F.col("letters") > SHARD_LETTERS
    refiled = repeated.where(hot).select("row", "first", F.explode(pieces).alias("p")).select("row", (F.col("first") + F.col("p.i")).alias("first"), F.xxhash64("p.w").alias("seed"), F.col("p.w").alias("stretch"))
    refiled = with_group_figures(
        refiled,
        ["seed"],
        salt,
        {"low_part": F.min("row"), "high_part": F.max("row"), "letters_part": F.sum(F.length("stretch"))},
        {"low": F.min("low_part"), "high": F.max("high_part"), "letters": F.sum("letters_part")},
    ).where("low <> high")
    filed = repeated.where(~hot).unionByName(refiled.select(*columns))

    # passages: whole stretches found in two rows, and windows of stretches whose seed has others
    distinct = filed.groupBy("seed", "stretch").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.max("letters").alias("letters"))
    # a seed has SHARD_LETTERS of text at most here, or is the hash of its one text
    counts = distinct.withColumn("n_texts", F.count("*").over(Window.partitionBy("seed")))
    whole = counts.where("n_texts = 1 AND low <> high").select("seed", "letters", F.col("stretch").alias("passage"))
    windows = (
        counts.where("n_texts > 1")
        .select("seed", "letters", "low", "high", F.explode(pieces).alias("p"))
        .groupBy("seed", F.col("p.w").alias("passage"))
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("letters").alias("letters"))
        .where("low <> high")
        .select("seed", "letters", "passage")
    )
    total = repeated.agg(F.sum(F.length("stretch"))).first()[0] or 0
    shards = max(16, int(total // SHARD_LETTERS) + 1)
    shard = F.pmod(F.xxhash64("seed"), F.lit(shards))
    parts = F.ceil(F.col("letters") / F.lit(SHARD_LETTERS)).cast("int")  # more than one for a hot seed only
    passages = whole.unionByName(windows).select(
        F.lit(0).alias("kind"), shard.alias("shard"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(-1).cast("long").alias("row"), F.lit(0).cast("long").alias("first"), F.col("passage").alias("text")
    )
    streamed = filed.where("row >= 0").select(F.lit(1).alias("kind"), shard.alias("shard"), F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"), "row", "first", F.col("stretch").alias("text"))
    routed = passages.unionByName(streamed).withColumn("shard", F.col("shard") * 100_000 + F.col("part")).repartition(F.col("shard")).sortWithinPartitions("shard", "kind")
    found = routed.select("kind", "shard", "row", "first", "text").mapInArrow(locate, "row long, a long, b long")
    # stretches of a row overlap: its runs are joined; a row's runs are bounded by its length
    order = Window.partitionBy("row").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("fresh", F.when(before.isNull() | (F.col("a") > before + 1), 1).otherwise(0)).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("row", "run").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end")).drop("run")
