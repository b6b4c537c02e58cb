import random

import pytest

from tests.llm.test_leak import pairs, search


@pytest.mark.parametrize("copies", [2, 5])
def test_beginning_of_a_long_repeated_item(spark, copies):
    words = [f"w{i}" for i in range(18)]
    docs = [(1, "x " + " ".join(words[:12]) + " y"), (2, " ".join(words[:11]))]
    assert pairs(search(spark, docs, [(7, " ".join(words))] * copies, 12)) == {(1, 7)}


def near_by_loops(docs, items, n, slop, least):
    best = {}
    for d, t in docs:
        for i, u in items:
            doc, item = t.split(), u.split()
            for phrase in range(len(item) - n + 1):
                for low in range(-len(item), len(doc) + 1):
                    c = sum(any(0 <= s + p < len(doc) and doc[s + p] == item[p] for s in range(low, low + slop + 1)) for p in range(phrase, phrase + n))
                    if c >= least:
                        best[d, i] = max(best.get((d, i), 0), c)
    return best


def near(s, slop, least):
    return {(r["doc_id"], r["item_id"]): r["n_words"] for r in s.near(slop, least).collect()}


def test_near_with_the_rarest_word_replaced_or_unknown(spark):
    words = [f"w{i}" for i in range(12)]
    common = " ".join(words[:5] + words[6:])
    docs = [(1, " ".join(words[:5] + ["misspelt"] + words[6:])), (2, common), (3, common), (4, " ".join(words[:8]))]
    items = [(1, " ".join(words))]
    assert near(search(spark, docs, items, 12), 2, 9) == {(1, 1): 11, (2, 1): 11, (3, 1): 11}
    docs.append((5, "w5 alone"))
    assert near(search(spark, docs, items, 12), 2, 9) == {(1, 1): 11, (2, 1): 11, (3, 1): 11}


def test_near_against_loops(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("the a b".split()) for _ in range(n))
    docs, items = [(i, text(rng.randrange(0, 30))) for i in range(40)], [(i, text(rng.randrange(4, 12))) for i in range(8)]
    s = search(spark, docs, items, 6)
    for slop, least in ((1, 4), (0, 5)):
        expected = near_by_loops(docs, items, 6, slop, least)
        assert expected and near(s, slop, least) == expected
