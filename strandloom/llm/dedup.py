"""Duplicates hidden by formatting, found by commutative multiset hashing."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.words import words
from strandloom.operators.grouping import spread_join, with_group_figures
from strandloom.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Hashes add modulo this prime, 2**61 - 1, so that sums never overflow a long.
PRIME = (1 << 61) - 1
#: Parts into which the rows of one fingerprint are spread.
SALTS = 64


def letters(text: Column) -> Column:
    """The letters of a text in order, lower-cased; everything else is dropped."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", "")


def _hasher(lane: int, name: str) -> Callable[[Column], Column]:
    return lambda value: F.pmod(F.xxhash64(F.lit(lane), F.lit(name), value), F.lit(PRIME))


def multiset_hash(pairs: Sequence[tuple[str, Column]], lane: int) -> Column:
    """Commutative hash of (field name, value) pairs: the sum of their hashes, the same in any order.

    Each value is an array and stands for one pair per element, each as often as it occurs.
    """
    total = F.lit(0).cast("long")
    for name, values in pairs:
        hashes = F.transform(values, _hasher(lane, name))
        total = F.pmod(total + F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: F.pmod(acc + h, F.lit(PRIME))), F.lit(PRIME))
    return total


@F.pandas_udf(T.BooleanType())
def same_multiset(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two arrays hold the same values equally often, by counting, without sorting; false for nulls."""
    return pd.Series([x is not None and y is not None and len(x) == len(y) and Counter(x) == Counter(y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _normal(df: DataFrame) -> DataFrame:
    """(record_id, _sequence, _title) with ``seq`` and ``words`` in place of the texts, and the fingerprint fp1, fp2."""
    keep = [c for c in df.columns if c not in ("_sequence", "_title")]
    rows = df.select(*keep, letters(F.col("_sequence")).alias("seq"), words(F.col("_title")).alias("words"))
    pairs = [("sequence", F.array("seq")), ("title", F.col("words"))]
    return rows.withColumns({"fp1": multiset_hash(pairs, 1), "fp2": multiset_hash(pairs, 2)})


def _salt() -> Column:
    return F.pmod(F.xxhash64("record_id"), F.lit(SALTS))


def _compared(rows: DataFrame) -> DataFrame:
    """``rows`` (record_id, first_id, fp1, fp2, seq, words) with ``same``: whether they equal the first record of their fingerprint."""
    fp = ["fp1", "fp2"]
    first = rows.where("record_id = first_id").select(*fp, F.col("seq").alias("first_seq"), F.col("words").alias("first_words")).dropDuplicates(fp)
    members = spread_join(rows, first, fp, _salt())  # the first record's values go once to each salt of its group
    letter, order = F.col("seq") == F.col("first_seq"), F.col("words") == F.col("first_words")
    sent = letter & ~order  # only titles in another order are counted in Python
    counted = same_multiset(F.when(sent, F.col("words")), F.when(sent, F.col("first_words")))
    return members.withColumn("same", (letter & order) | counted).drop("first_seq", "first_words")


def hidden_duplicates(df: DataFrame, id_col: str, sequence: str, title: str) -> DataFrame:
    """Members of each class of records that differ in formatting only.

    Records are the same if their sequences have the same letters in the same
    order and their titles the same words equally often; case, white space,
    punctuation and the order of title fields do not count. Each normalised
    (field, value) pair is hashed, the hashes are added into a fingerprint of two
    lanes of 61 bits, and rows are grouped by fingerprint. Only ids and
    fingerprints move for that. The texts of records whose fingerprint repeats are
    then fetched by id, and every member is compared with the first of its group.
    Members that differ from it in spite of an equal fingerprint are compared
    among themselves in the same way, until none is left.

    Returns ``keep_id`` (smallest id of the class), ``record_id`` and ``n_copies``
    (size of the class, the kept record included), for classes of two and more.
    A null or empty title or sequence takes a record out. Ids are longs; a row that
    repeats an id counts as one more copy. A fingerprint of any number of rows is
    spread over salts. Other columns do not matter.
    """
    given = df.select(F.col(id_col).alias("record_id"), F.col(sequence).alias("_sequence"), F.col(title).alias("_title")).where("_sequence <> '' AND _title <> ''")
    fp = ["fp1", "fp2"]
    keys = written(_normal(given).select("record_id", *fp))
    groups = keys.groupBy(*fp).agg(F.min("record_id").alias("first_id"), F.count("*").alias("n_copies")).where("n_copies > 1")
    repeated = written(spread_join(keys, groups, fp, _salt()).distinct())
    # an id given twice with other texts has other fingerprints; as a difference, since Spark would take an
    # equality for a join key and normalise every text for it
    wanted = repeated.select("record_id", F.col("fp1").alias("_fp1"), F.col("fp2").alias("_fp2"), "first_id", "n_copies")
    rows = written(_normal(given.join(wanted, "record_id")).where("fp1 - _fp1 = 0 AND fp2 - _fp2 = 0").drop("_fp1", "_fp2"))
    rest = written(_compared(rows).where("NOT same").drop("same"))
    if not rest.take(1):
        return rows.select(F.col("first_id").alias("keep_id"), "record_id", "n_copies")
    classed = _compared(rows).where("same").select("record_id", "first_id", *fp)
    while rest.take(1):
        least = rest.groupBy(*fp).agg(F.min("record_id").alias("first_id"))
        again = _compared(spread_join(rest.drop("first_id"), least, fp, _salt()))
        classed = classed.unionByName(again.where("same").select("record_id", "first_id", *fp))
        rest = written(again.where("NOT same").drop("same"))
    sizes = with_group_figures(classed, ["first_id", *fp], _salt(), {"n_part": F.count("*")}, {"n": F.sum("n_part")})
    return sizes.where("n > 1").select(F.col("first_id").alias("keep_id"), "record_id", F.col("n").alias("n_copies"))
