import pytest

from strandloom.llm.mix import TOKENIZER, Mixture, with_tokens


def docs(spark, extra=()):
    rows = [(i, "big", "word " * (i % 7 + 1)) for i in range(400)] + [(1000 + i, " Small ", "tiny text") for i in range(30)] + [(2000 + i, "MID.example", "some words here " * 3) for i in range(60)]
    return spark.createDataFrame([(*r, 1, 2) for r in [*rows, *extra]], "doc_id long, source string, text string, tokens int, repeat int")


def targets(spark, rows=(("big", 0.5, 1), ("small", 0.2, 3), ("mid", 0.2, 2), ("none", 0.1, 2))):
    return spark.createDataFrame(list(rows), "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    m = Mixture(docs(spark, [(3000, None, "x"), (3001, "big", None), (3002, "other", "x"), (3003, "big", "")]), targets(spark))
    shares = {r["source"]: r for r in m.shares().collect()}
    assert set(shares) == {"big", "small", "mid", "none"} and shares["none"]["taken"] == 0
    total = sum(r["taken"] for r in shares.values())
    assert total <= m.budget and total >= m.budget - 50
    for s, w in (("big", 5 / 9), ("small", 2 / 9), ("mid", 2 / 9)):
        assert shares[s]["taken"] / total == pytest.approx(w, abs=0.03)
        assert shares[s]["repeats_used"] <= shares[s]["max_repeats"]
    uses = m.repeats().collect()
    assert all(1 <= r["n_repeats"] <= {"big": 1, "small": 3, "mid": 2}[r["source"]] for r in uses)
    spread = [r["n_repeats"] for r in uses if r["source"] == "small"]
    assert max(spread) - min(spread) <= 1


def test_running_total_and_order(spark):
    m = Mixture(docs(spark), targets(spark), budget=300)
    rows = sorted(m.chosen().collect(), key=lambda r: r["total"])
    total = 0
    for a, b in zip(rows, rows[1:]):
        assert a["finish"] <= b["finish"]
    for r in rows:
        total += r["tokens"]
        assert r["total"] == total
    assert total <= 300


def test_budget_beyond_what_sources_hold(spark):
    m = Mixture(docs(spark), targets(spark), budget=10**9)
    shares = {r["source"]: r for r in m.shares().collect()}
    assert shares["small"]["repeats_used"] == 3.0 and shares["big"]["repeats_used"] == 1.0


def test_seeds_repeat(spark):
    ids = lambda seed: sorted((r["doc_id"], r["n_repeats"]) for r in Mixture(docs(spark), targets(spark), budget=200, seed=seed).repeats().collect())
    assert ids(1) == ids(1) and ids(1) != ids(2)


def test_empty(spark):
    m = Mixture(docs(spark).where("false"), targets(spark))
    assert m.repeats().count() == 0 and m.shares().count() == 4
    assert Mixture(docs(spark), targets(spark, [])).repeats().count() == 0


def test_tokens_as_another_library_counts_them(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(TOKENIZER.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = ["Hello world's  end", "ñandú\n\n  x", "a" * 3000, "", "12345 <|endoftext|>"]
    got = {r["i"]: r["tokens"] for r in with_tokens(spark.createDataFrame([*enumerate(texts), (9, None)], "i long, text string"), "text").collect()}
    assert got == {**{i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}, 9: 0}
