import random
import re

import numpy as np
import pytest

from strandloom.llm import spans


def brute(rows, patterns, span):
    texts = {}
    for i, t in rows:
        if t is not None:
            texts.setdefault(i, set()).add(re.sub(r"\s", "", t))
    where = {}
    for key, ts in [*texts.items(), *((("p", p), {re.sub(r"\s", "", p)}) for p in patterns if p is not None)]:
        for t in ts:
            for a in range(len(t) - span + 1):
                where.setdefault(t[a : a + span], set()).add(key)
    out = set()
    for i, ts in texts.items():
        shared = {p for t in ts for a in range(len(t) - span + 1) if len(where[t[a : a + span]]) > 1 for p in range(a, a + span)}
        for p in shared:
            if p - 1 not in shared:
                q = p
                while q + 1 in shared:
                    q += 1
                out.add((i, p + 1, q + 1))
    return out


def found(spark, rows, patterns, span=20, seed=8):
    df = spark.createDataFrame([(*r, 1) for r in rows], "record_id long, sequence string, first int").select("record_id", "sequence")
    pats = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    got = [(r["row"], r["span_start"], r["span_end"]) for r in spans.shared_spans(df, pats, span, seed).collect()]
    assert len(got) == len(set(got))
    return set(got)


def make(seed, n=60, letters="ACGT"):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(letters) for _ in range(rng.randrange(15, 60))) for _ in range(8)] + ["A" * 45, "AC" * 20]
    rows = [(i, "".join(rng.choice([rng.choice(pool), "".join(rng.choice(letters) for _ in range(rng.randrange(0, 25)))]) for _ in range(rng.randrange(0, 5)))) for i in range(n)]
    return rows, pool[:2] + ["A" * 10, None, pool[3] + " \n" + pool[4]]


@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_substrings(spark, seed):
    rows, patterns = make(seed)
    assert found(spark, rows, patterns) == brute(rows, patterns, 20)


def test_hot_seeds_are_filed_again(spark, monkeypatch):
    monkeypatch.setattr(spans, "SHARD_LETTERS", 150)
    rows, patterns = make(2, 90)
    assert found(spark, rows, patterns) == brute(rows, patterns, 20)


def test_edges(spark):
    unit = "ACGTTGCAACGGTTAACCGATT"
    rows = [(1, None), (2, ""), (3, "ACG"), (4, unit + unit), (5, unit[:20].lower()), (6, unit[:10] + " \n\t" + unit[10:]), (7, "é" + unit), (8, "日本" * 300), (9, "日本" * 200)]
    assert found(spark, rows, []) == brute(rows, [], 20)
    assert found(spark, [], ["A" * 30]) == set()
    assert found(spark, [(1, "AC" * 30)], []) == set()
    assert found(spark, [(1, "AC" * 30), (1, "AC" * 30)], []) == set()


def test_kernels():
    codes = np.random.default_rng(0).integers(0, 4, 300).astype(np.uint32)
    for k in (1, 3, 8, 24):
        h = spans.seed_hashes(codes, k)
        seen = {}
        assert len(h) == 300 - k + 1 and all(seen.setdefault(tuple(codes[i : i + k]), h[i]) == h[i] for i in range(len(h))) and len(set(seen.values())) == len(seen)
        for w in (1, 2, 7):
            assert (spans.window_minima(h, w) == [h[i : i + w].min() for i in range(len(h) - w + 1)]).all()
