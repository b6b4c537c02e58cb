"""Evaluation passages in a corpus, by a positional inverted index."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.words import words
from strandloom.session import written

#: Words of a leaked passage.
PHRASE = 12
#: Pieces of item words that ``near`` sends to every executor, of some 40 bytes each; more are shuffled.
MOST_SENT = 1_000_000


def item_terms(items: DataFrame, id_col: str, text: str) -> DataFrame:
    """Words of the items with their places: item_id, item_pos, term; each once, however often an item is given."""
    return items.select(F.col(id_col).alias("item_id"), F.posexplode(words(F.col(text))).alias("item_pos", "term")).distinct()


def positional_index(docs: DataFrame, id_col: str, text: str, terms: DataFrame) -> DataFrame:
    """The postings (term, doc_id, pos) of all terms of interest, written once, in the order of the documents.

    Each task writes the postings of its own documents, so nothing is shuffled.
    ``terms`` has one column ``term``.
    """
    tokens = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words(F.col(text))).alias("pos", "term"))
    return written(tokens.join(terms.select("term").distinct(), "term", "left_semi"))


def phrases(terms: DataFrame, frequencies: DataFrame, length: int) -> DataFrame:
    """Each run of ``length`` item words with its two rarest terms: item_id, phrase, p1, t1, p2, t2.

    Runs with a term that the corpus lacks cannot occur and are left out. Equal
    frequencies are decided by place.
    """
    known = terms.join(frequencies, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    in_runs = known.select("*", F.explode(F.sequence(F.greatest(F.col("item_pos") - (length - 1), F.lit(0)), F.col("item_pos"))).alias("phrase"))
    ranked = in_runs.groupBy("item_id", "phrase").agg(F.array_sort(F.collect_list(F.struct("n", "item_pos", "term"))).alias("r")).where((F.size("r") == length) & (F.col("r")[0]["n"] > 0))
    second = F.col("r")[min(1, length - 1)]
    return ranked.select("item_id", "phrase", F.col("r")[0]["item_pos"].alias("p1"), F.col("r")[0]["term"].alias("t1"), second["item_pos"].alias("p2"), second["term"].alias("t2"))


def steps_within(words_: int, slop: int) -> list[tuple[int, ...]]:
    """Moves of the second and later of so many words against the first, such that all lie within ``slop``."""
    moves = product(range(-slop, slop + 1), repeat=words_ - 1)
    return [m for m in moves if max(0, *m) - min(0, *m) <= slop] if words_ > 1 else [()]


class LeakSearch:
    """Finds the places where a corpus holds passages of test items.

    Postings of the items' vocabulary are stored once, and a search takes those of the
    terms that it looks up from them in one read. Every run of ``phrase`` item
    words is looked up by its rarest term: each posting gives the offset at which
    the item would have to lie in the document (``shift`` = document place - item
    place). The postings of the second rarest term, adjusted by their offset, are
    intersected with these; what remains is compared on all words of the item with
    the texts of the few documents that are left. A hot term's postings are spread
    by Spark's skew join where its items are too many to broadcast.

    Whole texts and all documents are searched. Null texts, and items of fewer
    than ``phrase`` words, match nothing; a repeated document or item row changes nothing (one id has one text).
    The items' side is as large as the test
    set; Spark broadcasts it only under its own size threshold.
    """

    def __init__(self, docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, phrase: int = PHRASE) -> None:
        self.phrase = phrase
        self.docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
        self.terms = item_terms(items, item_id, item_text)
        every = F.transform(F.array_sort(F.array_agg(F.struct("item_pos", "term"))), lambda t: t["term"])
        self.held = written(self.terms.groupBy("item_id").agg(every.alias("w")))
        self.index = positional_index(docs, doc_id, doc_text, self.terms)
        self.frequencies = written(self.index.groupBy("term").agg(F.count("*").alias("n")))
        self.phrases = written(phrases(self.terms, self.frequencies, phrase))

    def _postings(self, terms: DataFrame) -> DataFrame:
        """The postings of the looked-up terms, read from the index once."""
        return written(self.index.join(terms.select("term").distinct(), "term", "left_semi"))

    def _matched(self, places: DataFrame) -> DataFrame:
        """The item words found at each candidate shift: doc_id, item_id, shift, item_pos.

        ``places`` has doc_id, item_id, shift, each once, and the item places low to high that are
        compared; each place takes that stretch of its document and of its item.
        """
        places = written(places)
        few = self.docs.join(places.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w"))
        low, high = F.greatest(F.col("low"), F.lit(0), -F.col("shift")), F.least(F.col("high"), F.size("w") - 1 - F.col("shift"))
        said = places.join(few, "doc_id").select("doc_id", "item_id", "shift", low.alias("low"), high.alias("high"), "w").where("low <= high")
        said = said.select("doc_id", "item_id", "shift", "low", F.slice("w", F.col("shift") + F.col("low") + 1, F.col("high") - F.col("low") + 1).alias("said"))
        asked = said.join(self.held, "item_id").withColumn("asked", F.slice("w", F.col("low") + 1, F.size("said"))).drop("w")
        same = F.filter(F.sequence(F.lit(0), F.size("said") - 1), lambda i: F.get("said", i) == F.get("asked", i))
        return asked.select("doc_id", "item_id", "shift", "low", F.explode(same).alias("i")).select("doc_id", "item_id", "shift", (F.col("i") + F.col("low")).alias("item_pos"))

    def exact(self) -> DataFrame:
        """Longest runs of consecutive words shared by a document and an item: doc_id, item_id, doc_pos, item_pos, n_words (>= phrase)."""
        postings = self._postings(self.phrases.select(F.explode(F.array("t1", "t2")).alias("term")))
        rarest = self.phrases.select("item_id", "p1", F.col("t1").alias("term")).distinct()
        pairs = self.phrases.select("item_id", "p1", "p2", F.col("t2").alias("term")).distinct()
        found = postings.join(rarest, "term").select("doc_id", "item_id", (F.col("pos") - F.col("p1")).alias("shift"), "p1")
        both = found.join(pairs, ["item_id", "p1"]).withColumn("pos", F.col("shift") + F.col("p2")).join(postings.select("doc_id", "pos", "term"), ["doc_id", "pos", "term"])
        order = Window.partitionBy("doc_id", "item_id", "shift").orderBy("item_pos")
        whole = both.select("doc_id", "item_id", "shift").distinct().withColumns({"low": F.lit(0), "high": F.lit(1 << 30)})
        runs = self._matched(whole).withColumn("run", F.col("item_pos") - F.dense_rank().over(order))
        return (
            runs.groupBy("doc_id", "item_id", "shift", "run")
            .agg(F.min("item_pos").alias("item_pos"), (F.max("item_pos") - F.min("item_pos") + 1).cast("long").alias("n_words"))
            .where(F.col("n_words") >= self.phrase)
            .select("doc_id", "item_id", (F.col("shift") + F.col("item_pos")).alias("doc_pos"), "item_pos", "n_words")
        )

    def near(self, slop: int = 2, least: int = 9) -> DataFrame:
        """Proximity matches: doc_id, item_id, n_words.

        A document matches if at least ``least`` words of a run of ``phrase`` item
        words stand at shifts that differ by ``slop`` at most, whichever words they
        are; ``n_words`` is the most words so found for the pair. At most ``phrase - least``
        words are missing, so of one more pieces into which the run is cut, one is whole: its first
        words, up to three, stand in the document within ``slop`` of their order.
        Each place of a document is tried with all such moves of the words that
        follow, by a hash of the words; what agrees is compared on all words of the item.
        """
        piece = min(3, self.phrase // (self.phrase - least + 1))
        wanted = self.held.where(F.size("w") >= self.phrase).select("item_id", "w", F.posexplode("w").alias("at", "term")).where(F.col("at") + piece <= F.size("w"))
        keys = wanted.select("item_id", "at", F.xxhash64(*(F.get("w", F.col("at") + k) for k in range(piece))).alias("key"))
        # Spark would size the documents by their file, not by the moves of all places, and might send them instead
        keys = written(keys)
        keys = F.broadcast(keys) if keys.count() <= MOST_SENT else keys.hint("shuffle_hash")
        places = self.docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", "w", F.posexplode("w").alias("pos", "term"))
        tried = []
        for moves in steps_within(piece, slop):
            key = F.xxhash64(F.col("term"), *(F.get("w", F.col("pos") + k + 1 + m) for k, m in enumerate(moves)))
            tried.append(F.struct(key.alias("key"), F.lit(max(0, *moves) if moves else 0).alias("most"), F.lit(min(0, *moves) if moves else 0).alias("least")))
        met = places.select("doc_id", "pos", F.inline(F.array(*tried))).join(keys, "key").select("doc_id", "item_id", "at", (F.col("pos") - F.col("at")).alias("shift"), "most", "least").distinct()
        # shifts of the windows of slop that hold the piece, and the words of the runs around it
        around = F.explode(F.sequence(F.col("shift") + F.col("most") - slop, F.col("shift") + F.col("least") + slop))
        near = met.select("doc_id", "item_id", "at", around.alias("shift")).groupBy("doc_id", "item_id", "shift")
        hits = self._matched(near.agg((F.min("at") + 1 - self.phrase).alias("low"), (F.max("at") + self.phrase - 1).alias("high")))
        each = hits.select("doc_id", "item_id", "item_pos", F.explode(F.sequence(F.col("shift"), F.col("shift") + slop)).alias("upto")).repartition("doc_id", "item_id", "upto").distinct()
        # the words of the run that ends at each word found; runs that would begin before the item have no more than its first one
        run = Window.partitionBy("doc_id", "item_id", "upto").orderBy("item_pos").rangeBetween(1 - self.phrase, 0)
        counted = each.select("doc_id", "item_id", F.count("*").over(run).alias("n_words"))
        return counted.where(F.col("n_words") >= least).groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
