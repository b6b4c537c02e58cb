import random
import re

from strandloom.llm.leak import LeakSearch

WORD = re.compile(r"[^\W_]+")


def search(spark, docs, items, n=4):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, item_id string, pos int").select("doc_id", "text", "pos")
    q = spark.createDataFrame(items, "item_id long, text string")
    return LeakSearch(d, "doc_id", "text", q, "item_id", "text", n)


def brute(docs, items, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [WORD.findall((t or "").lower())] for i in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}


def pairs(s):
    return {(r["doc_id"], r["item_id"]) for r in s.exact().collect()}


def test_random_texts(spark):
    rng = random.Random(0)
    text = lambda n: " ".join(rng.choice("the a b c d e f".split()) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(60)]
    items = [(i, text(rng.randrange(0, 12))) for i in range(12)]
    assert pairs(search(spark, docs, items)) == brute(docs, items, 4)


def test_markup_nulls_repeats_and_long_text(spark):
    docs = [(1, "<p>Alpha, beta\n*gamma* DELTA</p>"), (2, None), (3, ""), (4, "alpha beta x gamma delta"), (5, "w " * 100_000 + "alpha beta gamma delta"), (1, "<p>Alpha, beta\n*gamma* DELTA</p>")]
    items = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma"), (3, None), (1, "alpha beta gamma delta")]
    assert pairs(search(spark, docs, items)) == {(1, 1), (5, 1)}
    run = [r for r in search(spark, docs, items).exact().collect() if r["doc_id"] == 5][0]
    assert (run["doc_pos"], run["n_words"]) == (100_000, 4)


def test_near(spark):
    words = [f"w{i}" for i in range(12)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:5] + ["x"] + words[5:])), (3, " ".join(words[:6])), (4, " ".join(words[::-1]))]
    near = {(r["doc_id"], r["n_words"]) for r in search(spark, docs, [(1, " ".join(words))], 12).near(2, 9).collect()}
    assert near == {(1, 12), (2, 12)}


def test_empty(spark):
    assert pairs(search(spark, [], [(1, "a b c d")])) == set()
    assert pairs(search(spark, [(1, "a b c d")], [])) == set()
