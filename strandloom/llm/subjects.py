"""Subjects of documents, by anchored non-negative factorisation of the document-term matrix."""

from __future__ import annotations

import operator
import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.grouping import spread_join
from strandloom.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns of the document-term matrix, unless given: terms are hashed into so many buckets, which bounds the model.
BUCKETS = 1 << 15
#: Part of a thread's largest subject share from which a further subject counts; less is a remark in passing.
#: With two subjects this is a quarter of their mass.
RELATIVE = 1 / 3
#: Rows factored at a time inside a task, and entries they may have together.
BLOCK, CELLS = 256, 40_000
#: Smallest divisor, and the move of a share below which a row's mixture is settled.
TINY, SETTLED = np.float32(1e-12), 1e-4
#: Part of a component's mass whose move between two passes still counts as a change.
MOVED = 0.01
#: Part of a language's threads, against its most frequent term, from which a term belongs to the background.
COMMON = 0.3
#: How often a question's tags count.
TAG_WEIGHT = 4
SALTS = 64

_CODE = r"(?s)```.*?(?:```|\z)|<pre\b.*?</pre>|<code\b.*?</code>|`[^`\n]*`"
_QUOTE = r"(?s)<blockquote\b.*?</blockquote>|(?m:^[ \t]*(?:>|&gt;)[^\r\n]*)"
_LINK_TAG = r"https?://\S+|<[^>]*>"


def prose(text: Column) -> Column:
    """A post without code, quotations, links and tags."""
    # a pattern runs only over texts that have a character with which it begins
    has = lambda *parts: reduce(operator.or_, (F.contains(text, F.lit(p)) for p in parts))
    plain = F.when(has("`", "<"), F.regexp_replace(text, _CODE, " ")).otherwise(text)
    quoted = F.when(has(">", "&gt;", "<"), F.regexp_replace(plain, _QUOTE, " ")).otherwise(plain)
    return F.when(has("://", "<"), F.regexp_replace(quoted, _LINK_TAG, " ")).otherwise(quoted)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def _update(x: np.ndarray, h: np.ndarray, w: np.ndarray, rounds: int, settled: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Multiplicative updates of the row mixtures ``w`` with fixed components, until no share moves by more than ``settled``; returns them and the last ratios.

    ``x`` is rows x entries, ``h`` rows x entries x components; entries that fill up a row are 0 in x and change nothing.
    """
    for _ in range(rounds):
        ratio = x / (np.matmul(h, w[:, :, None])[:, :, 0] + TINY)
        new = w * np.matmul(ratio[:, None, :], h)[:, 0, :]
        new /= np.maximum(new.sum(1, keepdims=True), TINY)
        moved, w = np.abs(new - w).max(), new
        if moved <= settled:
            break
    return w, x / (np.matmul(h, w[:, :, None])[:, :, 0] + TINY)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows of (key, cols, counts) of similar size: their numbers, counts and cols, both filled up with zeros, and where they are filled."""
    cols, counts = batch.column(1), batch.column(2)
    sizes = np.asarray(cols.value_lengths())
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    flat, values = cols.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    order, a = np.argsort(sizes, kind="stable"), 0
    while a < len(order):
        n = min(len(order) - a, BLOCK)
        while n > 1 and n * sizes[order[a + n - 1]] > CELLS:
            n = max(1, n // 2)
        rows, a = order[a : a + n], a + n
        place = np.arange(sizes[rows[-1]])
        inside = place[None, :] < sizes[rows, None]
        at = np.where(inside, starts[rows, None] + place, 0)
        yield rows, np.where(inside, values[at], np.float32(0)), np.where(inside, flat[at], 0), inside


class SubjectModel:
    """Subject mixtures of threads from an anchored factorisation X ~ W H.

    A row of X is a thread (a question with its answers), a column a hashed term;
    a question's title counts once, its tags ``TAG_WEIGHT`` times. H starts from anchors: one component per subject
    from the rows that labels name, minus most of what all rows have in common, and
    one background component per language. W and H are then updated in turn by
    multiplicative non-negative rules (Kullback-Leibler) over all rows: tasks sum
    their parts of the update per bucket, Spark adds them, and the driver keeps H
    only, of (subjects + languages) x ``buckets`` numbers at any size of corpus. A row
    starts each pass from an even mixture, so that no mixtures are stored between
    passes; passes end when no component moves by more than ``MOVED``, after ``iterations`` at most.
    Components stay tied to their anchors, so W gives the subject mixture at once.

    Labels may be wrong, repeated or contradicting: all count as votes, spelled
    in any case. Without labels for a subject its component is only background.
    Posts with null or blank text take no part and get no subject.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, subjects: Sequence[str], languages: Sequence[str] = ("en", "de", "es"), iterations: int = 6, inner: int = 3, buckets: int = BUCKETS) -> None:
        self.docs, self.subjects, self.inner, self.buckets = docs, list(subjects), inner, buckets
        spark = docs.sparkSession
        posts = docs.where(F.length(F.regexp_replace(F.col("text"), r"(?U)\s+", "")) > 0)
        self.posts = posts.select("doc_id", F.coalesce("thread_id", "doc_id").alias("thread"))
        head = F.concat_ws(" ", "title", *["tags"] * TAG_WEIGHT)
        said = F.concat(terms(prose(F.col("text"))), terms(F.coalesce(head, F.lit(""))))
        column = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        short = F.lower(F.substring(F.trim("lang"), 1, 2))
        # numbers, since a largest text would make Spark sort where it can hash
        language = F.when(F.col("post_type") == "question", F.coalesce(*(F.when(short == name, i) for i, name in enumerate(languages)), F.lit(0)))
        flat = posts.select(F.coalesce("thread_id", "doc_id").alias("thread"), language.alias("language"), F.explode(said).alias("term")).select("thread", "language", column.alias("col"))
        counts = flat.groupBy("thread", "col").agg(F.count("*").alias("n"), F.max("language").alias("language"))
        self.matrix = written(counts.groupBy("thread").agg(F.collect_list("col").alias("cols"), F.collect_list(F.col("n").cast("float")).alias("counts"), F.max("language").alias("language")))
        self.h = self._anchors(labels, list(languages))
        for _ in range(iterations):
            before, self.h = self.h, self._step(spark)
            if np.abs(self.h - before).sum(1).max() < 2 * MOVED:
                break

    def _gather(self, sums: DataFrame, names: list[str]) -> np.ndarray:
        """(name, col, n) as an array; at most names x buckets rows by construction."""
        out, place = np.zeros((len(names), self.buckets)), {n: i for i, n in enumerate(names)}
        rows = sums.toPandas()
        if len(rows):
            out[rows["name"].map(place).to_numpy(), rows["col"].to_numpy()] = rows["n"].to_numpy()
        return out

    def _anchors(self, labels: DataFrame, languages: list[str]) -> np.ndarray:
        entries = self.matrix.select("thread", "language", F.explode(F.arrays_zip("cols", "counts")).alias("e")).select("thread", "language", F.col("e.cols").alias("col"), F.col("e.counts").alias("n"))
        votes = labels.select("doc_id", F.lower(F.trim("subject")).alias("name")).where(F.col("name").isin(self.subjects)).join(self.posts, "doc_id").groupBy("thread", "name").agg(F.count("*").alias("v"))
        shares = votes.join(votes.groupBy("thread").agg(F.sum("v").alias("all")), "thread").select("thread", "name", (F.col("v") / F.col("all")).alias("share"))
        named = spread_join(self.matrix, shares, ["thread"], F.pmod(F.xxhash64("thread"), F.lit(SALTS))).select("name", "share", F.explode(F.arrays_zip("cols", "counts")).alias("e"))
        anchors = self._gather(named.groupBy("name", F.col("e.cols").alias("col")).agg(F.sum(F.col("e.counts") * F.col("share")).alias("n")), self.subjects)
        known = F.coalesce(*(F.when(F.col("language") == i, name) for i, name in enumerate(languages)), F.lit(languages[0]))
        # a background has what many threads of its language share; rarer terms are left to the subjects
        common = entries.groupBy(known.alias("name"), "col").agg(F.sum("n").alias("n"), F.count("*").alias("threads")).withColumn("most", F.max("threads").over(Window.partitionBy("name")))
        background = self._gather(common.where(F.col("threads") >= COMMON * F.col("most")), languages)
        everything = background.sum(0) / max(background.sum(), 1)
        anchors /= np.maximum(anchors.sum(1, keepdims=True), 1e-12)
        anchors = np.maximum(anchors - 0.9 * everything, 0) + 1e-3 * everything
        h = np.vstack([anchors, background + 1e-3 * everything])
        return h / np.maximum(h.sum(1, keepdims=True), 1e-12)

    def _step(self, spark) -> np.ndarray:
        shared, k, inner, buckets = spark.sparkContext.broadcast(np.ascontiguousarray(self.h.T, np.float32)), len(self.h), self.inner, self.buckets

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h_t, sums = shared.value, np.zeros((k, buckets))
            for batch in batches:
                for _, x, cols, inside in _blocks(batch):
                    w, ratio = _update(x, h_t[cols], np.full((len(x), k), 1 / k, np.float32), inner)
                    at = cols[inside]
                    for i in range(k):
                        sums[i] += np.bincount(at, (ratio * w[:, i, None])[inside], buckets)
            used = np.flatnonzero(sums.any(0))
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(sums[i, used]) for i in range(k))], names=["col", *(f"c{i}" for i in range(k))])

        schema = "col int, " + ", ".join(f"c{i} double" for i in range(k))
        sums = self.matrix.select("thread", "cols", "counts").mapInArrow(gather, schema).groupBy("col").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(k))).toPandas()
        update = np.zeros_like(self.h)
        if len(sums):
            update[:, sums["col"].to_numpy()] = sums.drop(columns="col").to_numpy().T
        h = self.h * update
        return h / np.maximum(h.sum(1, keepdims=True), 1e-12)

    def mixtures(self, rounds: int = 20) -> DataFrame:
        """Subject shares of each thread: thread, subject, share (of the subjects' mass; background left out), of_largest (share / the largest one), first (the largest; of equal ones the first by name)."""
        shared, k, names = self.docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(self.h.T, np.float32)), len(self.h), self.subjects

        def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                threads = batch.column(0).to_numpy(zero_copy_only=False)
                for rows, x, cols, _ in _blocks(batch):
                    w = _update(x, shared.value[cols], np.full((len(x), k), 1 / k, np.float32), rounds, SETTLED)[0][:, : len(names)].astype(np.float64)
                    w = w / np.maximum(w.sum(1, keepdims=True), 1e-12)
                    first = np.arange(len(names)) == w.argmax(1)[:, None]
                    i, j = np.nonzero((w >= 0.001) | first)
                    of_largest = w / np.maximum(w.max(1, keepdims=True), 1e-12)
                    yield pa.RecordBatch.from_arrays([pa.array(threads[rows[i]]), pa.array(np.array(names, dtype=object)[j], pa.string()), pa.array(w[i, j]), pa.array(of_largest[i, j]), pa.array(first[i, j])], names=["thread", "subject", "share", "of_largest", "first"])

        return self.matrix.select("thread", "cols", "counts").mapInArrow(mix, "thread long, subject string, share double, of_largest double, first boolean")

    def of_documents(self, relative: float = RELATIVE) -> DataFrame:
        """Subjects of each post with text: doc_id, subject, share. A reply has those of its thread.

        A thread's largest share always counts, so every thread with a word has a
        subject; others count from ``relative`` of it, if they are above an even share of all subjects.
        """
        chosen = self.mixtures().where(F.col("first") | ((F.col("of_largest") >= relative) & (F.col("share") > 1 / len(self.subjects)))).drop("of_largest", "first")
        return spread_join(self.posts, chosen, ["thread"], F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).select("doc_id", "subject", "share")
