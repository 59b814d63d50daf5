import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex import queries
from loomdex.operators import cells, dense
from loomdex.operators.cells import CellIndex
from loomdex.plans import evaluation

SF = "/root/testdata/sf0.1"


def clustered(n, seed=0, length=8):
    """Vectors around 40 places, among them copies, a zero vector, and ones that take no part."""
    rng = np.random.default_rng(seed)
    places = rng.normal(size=(40, length)) * 4
    rows = [(i, (places[i % 40] + rng.normal(size=length) * 0.3).round(3).tolist()) for i in range(n)]
    odd = [(n, [0.0] * length), (n + 1, None), (n + 2, [1.0]), (n + 3, [float("nan")] * length), (n + 4, rows[0][1]), (n + 5, rows[0][1])]
    return rows + odd


def key(frame):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(clustered(2000), "doc_id long, v array<double>").withColumn("label", F.col("doc_id") % 3).repartition(3).cache()


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(i, v) for i, v in clustered(60, seed=1) if v is not None]
    return spark.createDataFrame([*rows, (900, None)], "query_id long, q array<double>")


@pytest.fixture(scope="module")
def built(spark, vectors, tmp_path_factory):
    return CellIndex.build(vectors, str(tmp_path_factory.mktemp("cells")), 40)


def whole(vectors):
    return vectors.where("doc_id <> 2002 and doc_id <> 2003")  # of another length, and not finite


def test_all_cells_are_an_exact_search(spark, vectors, asked, built, tmp_path, monkeypatch):
    sound = asked.where("query_id not in (62, 63)")
    for parts in ((4096, 1024), (7, 5)):  # groups of one size or another
        monkeypatch.setattr(cells, "PART_ROWS", parts[0])
        monkeypatch.setattr(cells, "PART_QUERIES", parts[1])
        assert key(built.search(asked, 7)) == key(dense.topk(whole(vectors), sound, 7))
    assert key(built.search(asked, 7, where=F.col("label") == 1)) == key(dense.topk(whole(vectors), sound, 7, where=F.col("label") == 1))
    by_length = CellIndex.build(vectors, str(tmp_path), 9, "l2")
    assert key(by_length.search(asked, 5)) == key(dense.topk(whole(vectors), sound, 5, "l2"))


def test_few_cells_are_read_and_most_is_found(spark, vectors, asked, built):
    exact = dense.topk(whole(vectors), asked.where("query_id < 60"), 10)
    assert cells.recall(built.search(asked, 10, nprobe=4), exact) >= 0.95
    one = asked.where("query_id = 7")
    probed = [r["cell"] for r in built.probes(one, 4).collect()]
    assert len(probed) == 4
    read = built.scanned(probed)
    files = lambda rows: rows.select("_metadata.file_path").distinct().count()
    assert 0 < files(read) < files(built.vectors) / 4
    assert "PartitionFilters: [cell" in read._jdf.queryExecution().executedPlan().toString()


def test_recall_on_the_embeddings(spark):
    """These have no structure, so most of the cells are needed."""
    found = queries.cells_probed_topk(spark, SF)
    assert cells.recall(found, queries.dense_cosine_topk(spark, SF)) >= 0.95


def test_versions_and_no_vectors(spark, vectors, asked, tmp_path):
    folder = str(tmp_path)
    none = CellIndex.build(vectors.where("false"), folder)
    assert none.search(asked, 3).count() == 0
    old = CellIndex.build(vectors.where("doc_id < 500"), folder, 5)
    new = CellIndex.build(vectors, folder, 5)
    assert old.search(asked, 3).agg(F.max("doc_id")).first()[0] < 500
    assert CellIndex.open(spark, folder).version == new.version == 3
    assert new.prune(keep=1) and new.search(asked, 3).count() > 0
    with pytest.raises(ValueError):
        CellIndex.build(vectors, folder, 5, "dot")


def test_one_hot_cell(spark, tmp_path):
    """A third of all vectors are one and the same."""
    rng = random.Random(1)
    rows = [(i, [1.0, 2.0] if i % 3 == 0 else [rng.random(), rng.random()]) for i in range(900)]
    vectors = spark.createDataFrame(rows, "doc_id long, v array<double>")
    asked = vectors.where("doc_id < 9").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    built = CellIndex.build(vectors, str(tmp_path), 12)
    assert key(built.search(asked, 5)) == key(dense.topk(vectors, asked, 5))


def test_a_reader_of_vectors_keeps_its_version(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word {i}", "s") for i in range(9)], "doc_id long, text string, source string")
    path = str(tmp_path)
    evaluation.build_vector_index(docs.where("doc_id < 4"), path)
    reader = evaluation.load_vector_index(spark, path)
    assert evaluation.build_vector_index(docs, path).first()["document_count"] == 9
    assert reader.count() == 4 and evaluation.load_vector_index(spark, path).count() == 9
