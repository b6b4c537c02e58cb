import random

from strandloom.llm.subjects import SubjectModel, prose
from pyspark.sql import functions as F

NAMES = {"sport": "ball goal team pitch referee".split(), "law": "court judge appeal lease verdict".split(), "music": "chord violin melody choir octave".split()}


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    say = lambda s: f"i think the {rng.choice(NAMES[s])} and a {rng.choice(NAMES[s])} is good"
    docs, truth = [], {}
    for t in range(n):
        subjects = rng.sample(sorted(NAMES), 2 if t % 5 == 0 else 1)
        for k in range(3):
            text = ". ".join(say(s) for _ in range(4) for s in subjects) + (". " + say(rng.choice(sorted(NAMES))) if k == 2 else "")
            docs.append((t * 10 + k, text, "question" if k == 0 else "answer", t * 10, None, "en", None, "clash"))
            truth[t * 10 + k] = set(subjects)
    labels = [(d, s.upper() + " ", "a") for d, ss in list(truth.items())[:60] for s in ss]
    return docs, labels, truth


SCHEMA = "doc_id long, text string, post_type string, thread_id long, title string, lang string, tags string, thread string"


def model(spark, docs, labels):
    return SubjectModel(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, subject string, annotator string"), sorted(NAMES))


def found(m):
    out = {}
    for r in m.of_documents().collect():
        out.setdefault(r["doc_id"], set()).add(r["subject"])
    return out


def test_invented_corpus_with_held_out_documents(spark):
    docs, labels, truth = corpus()
    labelled = {d for d, *_ in labels}
    docs += [(5000, None, "question", 5000, "t", "en", "ball", "x"), (5001, " \n ", "answer", 5000, None, None, None, "x")]
    got = found(model(spark, docs, labels))
    held_out = [d for d in truth if d not in labelled]
    assert sum(got.get(d) == truth[d] for d in held_out) / len(held_out) >= 0.95
    assert 5000 not in got and 5001 not in got


def test_empty_and_without_labels(spark):
    docs, labels, _ = corpus(n=5)
    assert found(model(spark, [], labels)) == {}
    found(model(spark, docs, []))


def test_prose(spark):
    text = "a <b>c</b> `x` ```\ny``` <pre><code>z</code></pre>\n> quoted\nhttp://u.v/w d <blockquote>q\nq</blockquote>"
    assert spark.range(1).select(prose(F.lit(text)).alias("p")).first()["p"].split() == ["a", "c", "d"]


def test_held_out_labels(spark):
    """A model that does not see the labels of a fifth of the threads finds 0.9 of them (some labels are wrong)."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "subject_labels"))
    names = sorted(r[0] for r in spark.read.parquet(f"{d}/subject_areas.parquet").select("subject").collect())
    votes = labels.join(docs.select("doc_id", F.coalesce("thread_id", "doc_id").alias("thread"), "text"), "doc_id").where(F.col("text").rlike(r"(?U)\S"))
    held = F.pmod(F.xxhash64("thread"), F.lit(5)) == 0
    fitted = SubjectModel(docs, votes.where(~held).select("doc_id", "subject"), names)
    got = {(r["doc_id"], r["subject"]) for r in fitted.of_documents().collect()}
    wanted = {(r["doc_id"], r["subject"].strip().lower()) for r in votes.where(held).collect() if r["subject"] and r["subject"].strip().lower() in names}
    assert len(wanted) > 50 and sum(x in got for x in wanted) / len(wanted) >= 0.9
