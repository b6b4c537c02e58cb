import random
import re
from collections import Counter

from strandloom.llm import dedup

SCHEMA = "record_id long, title string, sequence string, keep_id string, seq int, words int"


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return {(r["keep_id"], r["record_id"], r["n_copies"]) for r in dedup.hidden_duplicates(df, "record_id", "sequence", "title").collect()}


def brute(rows):
    classes = {}
    for i, t, s in rows:
        if t and s:
            key = ("".join(c for c in s.lower() if c.isalpha()), frozenset(Counter(re.findall(r"[^\W_]+", t.lower())).items()))
            classes.setdefault(key, []).append(i)
    return {(min(m), i, len(m)) for m in classes.values() if len(m) > 1 for i in m}


def test_formats_nulls_ties(spark):
    rows = [(1, "a b", "AC-GT"), (2, "B  A", "acgt"), (3, "a a b", "ACGT"), (4, "a b b", "ACGT"), (5, None, "ACGT"), (6, "a b", None), (7, "", "ACGT"), (8, "b=A", "A C G T*"), (9, "--", "..."), (10, "++", "1 2"), (11, "a b", "TGCA"), (12, "É x", "ÀB"), (13, "x é", "àb")]
    assert found(spark, rows) == brute(rows)
    assert (1, 8, 3) in found(spark, rows) and (9, 10, 2) in found(spark, rows) and (12, 13, 2) in found(spark, rows)


def test_hot_class_and_long_text(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice(["one two", "Two_ONE", "two; one"]), rng.choice(["ACG" * 20, "acg" * 20, "A-C G" + "ACG" * 19])) for i in range(600)]
    rows += [(i, f"t{i % 50}", "G" * (i % 7 + 1)) for i in range(600, 900)] + [(1000, "w " * 30_000, "A" * 200_000), (1001, "W-" * 30_000, "a" * 200_000)]
    assert found(spark, rows) == brute(rows)


def test_equal_fingerprints_are_verified(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(dedup, "multiset_hash", lambda pairs, lane: F.lit(0).cast("long"))
    rows = [(1, "a", "AC"), (2, "A", "ac"), (3, "b", "AC"), (4, "B.", "AC"), (5, "a a", "AC"), (6, "c", "GG")]
    assert found(spark, rows) == brute(rows)


def test_empty_and_repeated_rows(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, "a", "A"), (1, "a", "A")]) == {(1, 1, 2)}
