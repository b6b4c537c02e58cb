"""Mixing of sources to target weights, by weighted fair queueing."""

from __future__ import annotations

import base64
import math
import sys
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.grouping import running_totals
from strandloom.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vocabulary of the public tokenizer in which sizes are counted.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that tokenizer cuts text before it merges bytes (a fixed value of the vocabulary).
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Rows that one task should order at a time.
TILE_ROWS = 50_000
#: Bytes that a vocabulary file may have to be sent to the executors.
MOST_VOCABULARY = 64 << 20


def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Replaces the text column by ``tokens``, its size in tokens; a null text has 0.

    The vocabulary file is read once, where the query is built, and sent to the
    executors, which need no file of their own; above ``MOST_VOCABULARY`` bytes it is an error.
    """
    keep = [c for c in df.columns if c != text]
    vocabulary = Path(tokenizer).read_bytes()
    if len(vocabulary) > MOST_VOCABULARY:
        raise ValueError(f"{tokenizer} has more than {MOST_VOCABULARY} bytes")
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(shared.value)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)
    return df.select(*keep, text).mapInArrow(count, f"{schema}, tokens bigint")


def source_name(source: Column) -> Column:
    """The spelling of a source that targets use: trimmed, lower-cased, without a trailing ``.example``."""
    return F.regexp_replace(F.lower(F.trim(source)), r"\.example$", "")


def _finish(sizes: dict[str, int], weights: dict[str, float], caps: dict[str, int], budget: float) -> float:
    """The virtual time at which all sources together have given ``budget`` tokens (a source stops at its cap)."""
    time, given, left = 0.0, 0.0, sorted(weights, key=lambda s: caps[s] * sizes[s] / weights[s])
    while left:
        ends = caps[left[0]] * sizes[left[0]] / weights[left[0]]
        rate = sum(weights[s] for s in left)
        if given + (ends - time) * rate >= budget:
            return time + (budget - given) / rate
        given, time = given + (ends - time) * rate, ends
        left = left[1:]
    return time


class Mixture:
    """A mixture of sources in which each has its target share of all tokens.

    Documents of a source are shuffled by a seeded hash, anew for each repeat, and
    queue with the virtual finish time (tokens of the source so far) / weight. All
    queues are ordered together by finish time and cut where the total would pass
    the budget. No source is used more than ``max_repeats`` times in full.

    ``docs`` needs (doc_id, source, text) under the given names, ``targets`` has
    source, target_share, max_repeats. Null, empty and unlisted sources take no
    part. A target source without text can give nothing: the other weights keep
    their proportions. Without ``budget``, the largest total is chosen at which
    every other source still meets its share. Running totals are taken per tile
    of the hash or finish time, and over the tiles, so no source or cut goes
    through one task; the driver sees one row per target source.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", budget: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> None:
        self.seed = seed
        self.targets = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
        rows = docs.select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("_text")).where(F.length("_text") > 0)
        wanted = rows.join(self.targets.where("target_share > 0 AND max_repeats > 0").select("source").distinct(), "source", "left_semi")
        self.sizes = written(with_tokens(wanted, "_text", tokenizer).where("tokens > 0"))
        self.totals = self.sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"))
        held = {r["source"]: r for r in self.totals.join(self.targets, "source").collect()}
        self.size = {s: r["tokens"] for s, r in held.items()}
        self.caps = {s: r["max_repeats"] for s, r in held.items()}
        share = sum(r["target_share"] for r in held.values())
        self.weights = {s: r["target_share"] / share for s, r in held.items()}
        self.n_docs = {s: r["n_docs"] for s, r in held.items()}
        most = min((self.caps[s] * self.size[s] / self.weights[s] for s in held), default=0)
        self.budget = int(math.floor(most)) if budget is None else budget

    def chosen(self) -> DataFrame:
        """The chosen uses: doc_id, source, tokens, repeat (from 0), finish, total (tokens up to and with this one)."""
        end = _finish(self.size, self.weights, self.caps, self.budget)
        if not self.size:
            return self.sizes.select("doc_id", "source", "tokens", F.lit(0).alias("repeat"), F.lit(0.0).alias("finish"), F.lit(0).cast("long").alias("total")).where("false")
        # a repeat more than virtual time asks for, since the cut may come a document later
        uses = {s: min(self.caps[s], math.ceil(end * self.weights[s] / self.size[s]) + 1) for s in self.size}
        by_source = lambda values, kind: F.create_map(*(F.lit(x) for s in values for x in (s, values[s])))[F.col("source")].cast(kind)
        rows = max(self.n_docs.values())
        tiles = max(1, math.ceil(math.log2(rows / TILE_ROWS + 1)))
        queued = self.sizes.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(0), by_source(uses, "int") - 1)).alias("repeat")).withColumn(
            "place", F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), "repeat", "doc_id"), 1)
        )
        queued = running_totals(queued, ["source", "repeat"], "place", ["tokens"], tile_bits=63 - tiles, levels=1, ties=["doc_id"])
        before = F.col("repeat") * by_source(self.size, "long")
        timed = queued.withColumn("finish", (before + F.col("tokens_upto")) / by_source(self.weights, "double")).drop("tokens_upto")
        # whole steps of virtual time, fine enough to hold few documents each; ties go by source and place
        total_rows = sum(self.n_docs[s] * uses[s] for s in uses)
        step_bits = max(1, math.ceil(math.log2(TILE_ROWS)))
        steps = max(1, total_rows)
        timed = timed.withColumn("step", F.floor(F.col("finish") / F.lit(max(end, 1.0)) * steps).cast("long"))
        cut = running_totals(timed, [], "step", ["tokens"], tile_bits=step_bits, levels=1, ties=["finish", "source", "repeat", "place", "doc_id"])
        return cut.where(F.col("tokens_upto") <= self.budget).select("doc_id", "source", "tokens", "repeat", "finish", F.col("tokens_upto").alias("total"))

    def repeats(self) -> DataFrame:
        """How often each document is used: doc_id, source, tokens, n_repeats (1 and more)."""
        return self.chosen().groupBy("doc_id", "source", "tokens").agg(F.count("*").alias("n_repeats"))

    def shares(self) -> DataFrame:
        """Per target source: what it holds, what was taken, and the share reached."""
        taken = self.chosen().groupBy("source").agg(F.sum("tokens").alias("taken"), F.count("*").alias("n_uses"))
        zero = F.lit(0).cast("long")
        out = self.targets.join(self.totals, "source", "left").join(taken, "source", "left").withColumns({c: F.coalesce(c, zero) for c in ("n_docs", "tokens", "taken", "n_uses")})
        everyone = Window.partitionBy()  # one row per target source
        return out.select(
            "source", "target_share", "max_repeats", "n_docs", "tokens", "n_uses", "taken",
            F.round(F.col("taken") / F.sum("taken").over(everyone), 6).alias("actual_share"),
            F.round(F.col("taken") / F.when(F.col("tokens") > 0, F.col("tokens")), 6).alias("repeats_used"),
        )
