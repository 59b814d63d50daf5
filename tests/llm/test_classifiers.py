import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import learn, quality, toxicity
from loomdex.llm.queries import op2_quality, op9_toxicity
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def held_out_accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").where("held_out").select("predicted", label).collect()
    return sum(r["predicted"] == r[label] for r in rows) / len(rows)


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.scored_documents(docs, quality.fit(docs, learn.marks(labels, "quality", 4, 2)), 4, 2, 0.7)
    assert scored.count() == docs.count() and scored.where("score < 0 or score > 1 or score is null").count() == 0
    assert held_out_accuracy(scored, labels, "quality") >= 0.9


def used_marks(labels, label, fold, held_out):
    rows = [(r["doc_id"], r[label]) for r in labels.collect()]
    return {i: v for i, v in rows if zlib.crc32(str(i).encode()) % fold != held_out and v is not None}


def test_the_quality_query_equals_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    want = brute.quality_scores(texts, used_marks(labels, "quality", 4, 2))
    found = op2_quality(spark, SF).collect()
    assert {r["doc_id"] for r in found} == set(want)
    for r in found:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_isotonic_is_the_rising_least_squares_fit():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 40, 200) / 10
    labels = (rng.random(200) < values / 4).astype(float)
    own = learn.Isotonic(values, labels, {0: 100, 1: 100})
    weights = np.where(labels == 1, 100 / labels.sum(), 100 / (200 - labels.sum()))
    groups, _, fit = brute.least_squares_rising(list(values), list(labels), list(weights * 200 / weights.sum()))
    assert len({round(f, 12) for f in fit}) == len(own.at)
    assert (np.diff(own.scores(np.linspace(-1, 5, 100))) >= 0).all()


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.scored_documents(docs, toxicity.fit(docs, learn.marks(labels, "toxic", 5, 0)), 5, 0, 0.5)
    assert scored.count() == docs.count() and scored.where("score < 0 or score > 1 or score is null").count() == 0
    assert held_out_accuracy(scored, labels, "toxic") >= 0.9


def test_held_out_labels_are_not_used(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    used = learn.marks(labels, "quality", 4, 2)
    assert used.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).count() == 0
    assert used.count() == labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).count()


@pytest.mark.parametrize("module", [quality, toxicity])
@pytest.mark.parametrize("marks", [[], [(1, 1), (7, 1)], [(1, 1), (7, 0), (5, 0), (99, 1), (None, 1)]])
def test_odd_documents_and_few_labels(spark, odd_documents, no_documents, module, marks):
    model = module.fit(odd_documents, spark.createDataFrame(marks, "doc_id long, label int"))
    rows = module.score(odd_documents, model, ["doc_id"]).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] in (4, 5)}
    assert len(same) == 1
    assert module.score(no_documents, model, ["doc_id"]).count() == 0


def test_accepted_keeps_the_columns(spark, odd_documents, no_documents):
    model = quality.fit(odd_documents, spark.createDataFrame([(1, 1), (7, 0)], "doc_id long, label int"))
    assert quality.accepted(odd_documents, model, 0.0).collect() == odd_documents.collect()
    assert quality.accepted(odd_documents, model, 1.1).count() == 0
    assert quality.accepted(no_documents, model, 0.0).count() == 0


def test_folding_and_exceptions(spark):
    assert toxicity.folded_words("id1ot і𝐝iot Idiоt pathet1c m0r0n!") == ["idiot"] * 3 + ["pathetic", "moron"]
    assert toxicity.folded_words("12 3x 4 a1") == ["x", "a"]
    toxic = [f"you idiot number {i} of them" for i in range(40)]
    clean = [f"the idiot light is on in car {i}" for i in range(40)] + [f"plain words here {i}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 40)) for i in range(480)], "doc_id long, label int")
    matcher = toxicity.Matcher(toxicity.fit(docs, marks))
    assert matcher.features("you id10t there")[0] > 0
    assert matcher.features("an idiot light")[0] == 0
    assert matcher.features("")[0] == 0


def test_the_toxicity_query_equals_plain_python(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    want = brute.toxicity_scores(texts, used_marks(labels, "toxic", 5, 0), toxicity.folded_words)
    found = op9_toxicity(spark, SF).collect()
    assert {r["doc_id"] for r in found} == set(want)
    for r in found:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_caps_of_the_lexicon_are_parameters(documents_of, scratch):
    """With None nothing is cut; a small lexicon holds the terms that explain most."""
    bad = ["idiot", "moron", "stupid", "pathetic", "loser"]
    rows = [(i, f"you are a {bad[i % 5]} and {bad[(i + i // 5) % 5]} {i}", "en", "s", 0) for i in range(60)]
    rows += [(i, f"the river bank is quiet at dawn number {i}", "en", "s", 0) for i in range(60, 180)]
    docs = documents_of([*rows, (None, "nobody", "en", "s", 0)])
    marks = docs.where("doc_id is not null").selectExpr("doc_id", "cast(doc_id < 60 as int) as label")
    whole, small = (toxicity.fit(docs, marks, scratch, lexicon_size=n, enough=None) for n in (None, 2))
    assert len(small.weights) == 2 and set(small.weights) < set(whole.weights) and whole.enough is None
    text = " ".join(bad) * 50
    assert toxicity.Matcher(whole).features(text)[1] > toxicity.ENOUGH
    assert toxicity.scored_documents(docs, whole, 5, 0, 0.5).where("held_out is null").count() == 0
