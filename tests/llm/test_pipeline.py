"""The pipeline against plain Python, stage by stage, on the smallest tables."""

import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomdex.llm import learn
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    out = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(out / name))
        docs = frames[name] = spark.read.parquet(str(out / name))
    return frames


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_columns_stay(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_quality(spark, stages):
    docs, labels = texts(stages["documents"]), spark.read.parquet(f"{SF}/labels.parquet").collect()
    marks = learn.marks(spark.read.parquet(f"{SF}/labels.parquet"), "quality", 4, 2)
    assert {r["doc_id"] for r in marks.collect()} == {r["doc_id"] for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    scores = brute.quality_scores(docs, {r["doc_id"]: r["label"] for r in marks.collect()})
    want = {i for i, s in scores.items() if s >= corpus_pipeline.LEAST_QUALITY}
    kept = set(texts(stages["quality"]))
    assert kept == want
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    assert len(good & kept) >= 0.95 * len(good)


def test_lines(stages):
    want = brute.dedup_lines(list(texts(stages["quality"]).items()))
    want = {i: t for i, (_, gone, t) in want.items() if not gone or t.strip()}
    assert texts(stages["line_dedup"]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages["line_dedup"].collect())


def test_near_duplicates(stages):
    docs = texts(stages["line_dedup"])
    groups = brute.near_groups(list(docs.items()), 5, 80, 100)
    assert texts(stages["near_duplicates"]) == {i: t for i, t in docs.items() if groups[i][1] == i}


def test_mix(stages):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in stages["near_duplicates"].collect()]
    want = {i: copies for i, (_, _, _, copies) in brute.mixed(rows).items() if copies}
    assert Counter(r["doc_id"] for r in stages["mix"].collect()) == want


def test_tokens(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = texts(stages["mix"])
    rows = stages["bpe"].collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in stages["mix"].collect())
    for r in rows:
        assert r["ids"] == library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(r["ids"]) and r["intact"]


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    key = lambda f: sorted((r["doc_id"], r["n_tokens"]) for r in f.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages["bpe"])


def test_odd_and_no_documents(spark, odd_documents, no_documents, tmp_path):
    for k, docs in enumerate((odd_documents, no_documents)):
        columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(str(tmp_path / str(k) / name))
            docs = spark.read.parquet(str(tmp_path / str(k) / name))
            rows = docs.collect()
            assert {r["doc_id"] for r in rows} <= ids
            assert name == "bpe" or docs.columns == columns
            if name in ("line_dedup", "near_duplicates") and k == 0 and 1 in ids:
                assert 2 not in {r["doc_id"] for r in rows}  # its only line is that of document 1
            if name == "mix":
                assert all(r["text"].strip() for r in rows)  # nothing is taken of a text without words
            ids = {r["doc_id"] for r in rows}
        assert all(r["intact"] and r["n_tokens"] > 0 for r in rows)
        assert k == 0 or not rows
