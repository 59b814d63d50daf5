"""What a hybrid retrieval of many queries does once, however many queries there are."""

import hashlib
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomdex.functions import models
from loomdex.operators import blocks, dense, fusion, lexical, running
from loomdex.plans import evaluation


def test_equal_vectors_are_not_all_passed_on():
    ids = np.array([1, 2]), np.array([[1.0, 0.0], [0.0, 1.0]])
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(9000)), "v": [[1.0, 1.0]] * 9000})
    for measure in ("cosine", "l2"):
        found = pa.Table.from_batches(dense.best_of_batches(SimpleNamespace(value=ids), 4, measure)(iter([batch]))).to_pylist()
        assert [(r["query_id"], r["doc_id"]) for r in found] == [(q, d) for q in (1, 2) for d in range(4)]


def test_vectors_are_made_once_for_all_blocks_of_queries(spark, tmp_path, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(i):
        made.add(1)
        return [float(i), 1.0]

    docs = spark.createDataFrame([(i, f"text w{i}") for i in range(20)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"w{i}", 0, "") for i in range(12)], "ordinal long, question string, answer_index int, answer string")
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    monkeypatch.setattr(evaluation.models, "embed_column", lambda text, model: F.array(F.length(text).cast("double"), F.lit(1.0)))
    vectors = docs.select("doc_id", vector("doc_id").alias("v"))
    hits = evaluation.hybrid_retrieval(asked, docs, lexical.build_index(docs), vectors, "any", str(tmp_path / "run"), evaluation.EvaluationConfig())
    assert hits.select("query_id").distinct().count() == 12 and made.value == 20


def best_by_brute_force(scores, k):
    """(query, document, score) of all positive scores, ties to the smaller document."""
    out = []
    for q, row in enumerate(np.round(scores, 6)):
        found = sorted((d for d in range(len(row)) if scores[q, d] > 0), key=lambda d: (-row[d], d))[:k]
        out += [(q, d, row[d]) for d in found]
    return out


def postings_of(gains, per_block):
    """Batches (segment, block, term_id, hits) of a matrix (term, document)."""
    rows = []
    for block in range(-(-gains.shape[1] // per_block)):
        own = gains[:, block * per_block : (block + 1) * per_block]
        for t in np.flatnonzero(own.any(1)):
            hits = [{"doc_id": int(d) + block * per_block, "tf": int(own[t, d]), "dl": 1} for d in np.flatnonzero(own[t])]
            rows.append({"segment": 0, "block": block, "term_id": 10 * int(t), "hits": hits})
    hits = pa.list_(pa.struct([(name, pa.int64()) for name in ("doc_id", "tf", "dl")]))
    schema = pa.schema([("segment", pa.int32()), ("block", pa.int64()), ("term_id", pa.int64()), ("hits", hits)])
    return [pa.RecordBatch.from_pylist(rows[i : i + 37], schema) for i in range(0, len(rows), 37)]


SMALL = {"LIKE_DOCS": 40, "LIKE_POSTINGS": 500, "TILE_DOCS": 7, "TILE_POSTINGS": 60, "MATRIX_TERMS": 3, "ROWS": 5, "PAIRS": 11, "TABLE": 30, "ADDED": 13}


@pytest.mark.parametrize("given", [{}, SMALL, SMALL | {"MATRIX_TERMS": 0}, {"LIKE_DOCS": 64, "TILE_DOCS": 8, "SHARED": 0.0}])
def test_tiles_give_the_exact_best(monkeypatch, given):
    """Equal scores are many here, as gains and weights are small whole numbers."""
    for name, value in given.items():
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(running, "SPARE", 0)
    rng = np.random.default_rng(2)
    gains = rng.integers(1, 4, (50, 200)) * (rng.random((50, 200)) < 0.2)
    weights = rng.integers(1, 4, (30, 50)) * (rng.random((30, 50)) < 0.15)
    weights[3] = 0
    query, term = np.nonzero(weights)
    shared = SimpleNamespace(value=(query, 10 * term, weights[query, term].astype(float)))
    gain = lambda tf, dl: tf.astype(float)
    wanted = best_by_brute_force((weights @ gains).astype(float), 4)
    for packed in (False, True):
        batches = iter(postings_of(gains, 16))
        if packed:
            found = blocks.best_of_tiles(shared, 4, [])(blocks.packed_tiles(gain)(batches))
        else:
            found = blocks.best_of_blocks(shared, 4, gain, [])(batches)
        rows = pa.Table.from_batches(found).to_pylist()
        assert sorted((r["query_id"], r["doc_id"], r["score"]) for r in rows) == sorted(wanted)


def test_few_pairs_are_scored_in_double_precision(monkeypatch):
    """Of 400 queries and 6,000 documents; queries of one kind are left out of tiles of the other."""
    rng, counts = np.random.default_rng(4), {"exact": 0, "rough": 0}
    gains = rng.integers(1, 9, (60, 6000)) * (rng.random((60, 6000)) < 0.4)
    weights = rng.random((400, 60)) * (rng.random((400, 60)) < 0.4)
    gains[:30, ::2], gains[30:, 1::2], weights[:200, :30], weights[200:, 30:] = 0, 0, 0, 0
    exact, rough = blocks.Search.exact, blocks.Search.rough

    def counted(name, f, size):
        def run(self, *given):
            counts[name] += size(given)
            return f(self, *given)

        return run

    monkeypatch.setattr(blocks.Search, "exact", counted("exact", exact, lambda g: len(g[1])))
    monkeypatch.setattr(blocks.Search, "rough", counted("rough", rough, lambda g: g[0] * g[1]))
    query, term = np.nonzero(weights)
    shared = SimpleNamespace(value=(query, 10 * term, weights[query, term]))
    found = blocks.best_of_blocks(shared, 5, lambda tf, dl: tf / 3.0, [])(iter(postings_of(gains, 256)))
    rows = pa.Table.from_batches(found).to_pylist()
    assert [(r["query_id"], r["doc_id"]) for r in rows] == [x[:2] for x in best_by_brute_force(weights @ gains / 3.0, 5)]
    assert counts["exact"] <= 400 * 5 * 1.2 and counts["rough"] <= 0.6 * 400 * 6000


@pytest.mark.parametrize("held", [100, 4_000_000])
def test_cosines_in_single_precision_give_the_exact_best(monkeypatch, held):
    monkeypatch.setattr(dense, "HELD", held)
    monkeypatch.setattr(dense, "ROWS", 50)
    rng = np.random.default_rng(6)
    rows = rng.integers(-3, 4, (300, 8)).astype(float)
    rows[100:200], rows[7] = rows[:100], 0
    asked = np.vstack([rng.integers(-3, 4, (20, 8)), np.zeros((1, 8))]).astype(float)
    measured, scored = dense.measured(rows, asked, "cosine"), []
    einsum = np.einsum
    monkeypatch.setattr(dense.np, "einsum", lambda form, a, b: scored.append(len(a)) or einsum(form, a, b))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "v": rows.tolist()})
    found = dense.best_of_batches(SimpleNamespace(value=(np.arange(21), asked)), 6, "cosine")(iter([batch.slice(0, 120), batch.slice(120)]))
    wanted = [(q, int(d)) for q in range(21) for d in np.lexsort((np.arange(300), -np.round(measured[q], 6)))[:6]]
    assert [(r["query_id"], r["doc_id"]) for r in pa.Table.from_batches(found).to_pylist()] == wanted
    assert 0 < sum(scored) < 21 * 300 / 2


def test_best_of_single_scores_of_any_sign(monkeypatch):
    held = running.Rough(running.Best(2, 2))
    held.add(np.array([1, 0, 1, 1, 0]), np.arange(5), np.array([-1.0, 2.0, -3.0, -0.5, -2.0], np.float32))
    assert [x.tolist() for x in held.settled()] == [[1, 0, 1, 0], [0, 1, 3, 4]]


def test_words_are_hashed_once(monkeypatch):
    made, md5 = [], hashlib.md5
    monkeypatch.setattr(models.hashlib, "md5", lambda x: made.append(x) or md5(x))
    texts = ["a b a", "", "b c " * 50, "a"]
    found = models.HashedEmbedding(8).embed(texts)
    assert sorted(made) == [b"a", b"b", b"c"]
    for text, vector in zip(texts, found):
        own = np.zeros(8)
        for word in text.split():
            h = int.from_bytes(md5(word.encode()).digest()[:8], "little")
            own[h % 8] += 1 if h >> 63 else -1
        assert vector == (own / (np.linalg.norm(own) or 1)).tolist()
    monkeypatch.setattr(models.HashedWords, "MOST", 1)
    assert models.HashedEmbedding(8).embed(texts) == found


def test_a_passage_is_read_once_for_its_pairs(monkeypatch):
    read, words = [], re.compile(r"\w+")
    monkeypatch.setattr(models, "WORDS", SimpleNamespace(findall=lambda s: read.append(s) or words.findall(s)))
    assert models.OverlapPairs().score([("a b", "A c"), ("c", "A c"), ("", "A c"), ("a", "b")]) == [0.5, 1.0, 0.0, 0.0]
    assert read.count("a c") == 1
