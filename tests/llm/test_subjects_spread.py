import random

from strandloom.llm.subjects import SubjectModel

NAMES = {n: [f"{n}{w}" for w in ("axo", "bru", "cil", "dop", "ent")] for n in ("art", "bees", "cars", "dance", "eggs", "farm")}


def test_thread_of_many_subjects_keeps_them(spark):
    rng = random.Random(1)
    say = lambda n, k: " ".join(f"so the {rng.choice(NAMES[n])} is" for _ in range(k))
    docs, labels = [], []
    for t in range(120):
        name = sorted(NAMES)[t % 6]
        docs.append((t, say(name, 12), "question", t, None, "en", None))
        labels.append((t, name))
    docs.append((900, " ".join(say(n, 12) for n in sorted(NAMES)), "question", 900, None, "en", None))
    docs.append((901, " ".join(say(n, 12) for n in sorted(NAMES)[:5]), "answer", 901, None, "en", None))
    docs.append((902, "qqq zzz", "question", 902, None, "en", None))
    m = SubjectModel(spark.createDataFrame(docs, "doc_id long, text string, post_type string, thread_id long, title string, lang string, tags string"), spark.createDataFrame(labels, "doc_id long, subject string"), sorted(NAMES))
    found = {}
    for r in m.of_documents().collect():
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    assert set(found) == {d[0] for d in docs}
    assert found[901] == set(sorted(NAMES)[:5])
    assert len(found[900]) >= 1 and all(found[t] == {sorted(NAMES)[t % 6]} for t in range(120))
