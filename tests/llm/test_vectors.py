import numpy as np
import pytest

from pyspark.sql import functions as F

from loomdex.llm import ann, embed_dedup
from loomdex.llm.queries import op1_permutation_index
from tests.llm import brute
from tests.llm.conftest import CLASHING

SCHEMA = "vec_id long, embedding array<float>, label int"


def clusters(seed=0, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    rows = [centers[i % 12] + rng.normal(size=dim) * (0.1 if i % 3 else 1.5) for i in range(n)]
    rows += [rows[0]] * 20 + [np.asarray(rows[1]) * 3]
    return [(i, np.asarray(r, np.float32).tolist(), 0) for i, r in enumerate(rows)]


ODD = [
    (9001, None, 0), (9002, [], 0), (9003, [0.0] * 16, 0), (9004, [float("nan")] + [1.0] * 15, 0), (9005, [float("inf")] * 16, 0),
    (9006, [None] + [1.0] * 15, 0), (9007, [1.0, 2.0], 0), (None, [1.0] * 16, 0),
]


def cosines(rows):
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_near_duplicates_equal_brute_force(spark, scratch, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 64)
    rows = clusters()
    near = cosines(rows) >= 0.9
    np.fill_diagonal(near, False)
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows + ODD, SCHEMA), 0.9, scratch).collect()
    want = brute.components(range(len(rows)), zip(*np.nonzero(near)))
    by = {r["vec_id"]: r for r in found}
    assert len(found) == len(rows) + len(ODD)
    assert all(by[i]["n_links"] == near[i].sum() and by[i]["component_id"] == want[i] for i in range(len(rows)))
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in range(9001, 9008))
    assert by[None]["component_id"] is None and by[None]["n_links"] == 0


def test_near_duplicates_of_nothing(spark, scratch):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], SCHEMA), 0.9, scratch).count() == 0


def test_search(spark, scratch):
    rows = clusters(1)
    frame = spark.createDataFrame(rows + ODD, SCHEMA)
    found = ann.search(frame, frame.where("vec_id % 20 = 0 or vec_id > 9000"), 5, scratch).collect()
    scores = cosines(rows)
    hit = total = 0
    for q in range(0, len(rows), 20):
        own = [r for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and q not in {r["vec_id"] for r in own}
        assert all(r["score"] == pytest.approx(scores[q, r["vec_id"]], abs=1e-12) for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        best = sorted((round(-scores[q, i], 12), i) for i in range(len(rows)) if i != q)[:5]
        hit += len({i for _, i in best} & {r["vec_id"] for r in own})
        total += 5
    assert hit / total >= 0.9
    assert not [r for r in found if r["query_id"] > 9000 or r["vec_id"] > 9000]


def test_search_of_few_and_of_nothing(spark, scratch):
    two = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 1.0], 0)], SCHEMA)
    found = ann.search(two, two, 5, scratch).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(1, 1, 2), (2, 1, 1)]
    none = spark.createDataFrame([], SCHEMA)
    assert ann.search(none, none, 5, scratch).count() == 0


def recall(found, rows, k=5):
    """Of the k nearest of each query with an id divisible by 50, the share found."""
    scores, ids = cosines(rows), [r[0] for r in rows]
    own = {}
    for r in found:
        own.setdefault(r["query_id"], set()).add(r["vec_id"])
    best = {q: sorted((-scores[at, j], i) for j, i in enumerate(ids) if i != q)[:k] for at, q in enumerate(ids) if q % 50 == 0}
    return sum(len({i for _, i in near} & own[q]) for q, near in best.items()) / (k * len(best))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_where_the_order_decides(spark, scratch, sf):
    """The registered query finds nine tenths while it reranks less than a tenth."""
    folder = f"/root/testdata/{sf}"
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    assert recall(op1_permutation_index(spark, folder).collect(), rows) >= 0.9
    index = ann.build_index(frame, scratch, 6)
    vectors, files = index.vectors.toPandas(), index.files.toPandas()
    assert index.blocks == {64: 1} and set(files["pivot"]) <= set(range(ann.PIVOTS))
    asked = vectors[vectors["rep"] % 50 == 0].rename(columns={"rep": "id"})
    asked = asked.assign(nearest=list(ann.pivot_order(ann.unit(ann.matrix(asked["v"])), index.pivots[64], ann.READ)))
    hits, reranked = ann.search_block(vectors, files, asked, 5)
    assert reranked < 0.1 * len(asked) * len(vectors)
    assert recall([{"query_id": q, "vec_id": i} for q, i, _ in hits], rows) >= 0.9


def test_blocks_of_vectors_and_of_queries(spark, scratch, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rows = [(i, v, 0) for i, v, _ in clusters(2)]
    frame = spark.createDataFrame(rows + ODD, SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})
    index = ann.build_index(frame, scratch, 6)
    assert index.blocks[16] > 4
    found = ann.search_index(index, frame.where("vec_id % 50 = 0"), 5, scratch).collect()
    assert found and recall(found, rows) >= 0.9
    assert index.files.where(F.size("places") == 0).count() == 0
    with pytest.raises(ValueError):
        ann.search_index(index, frame, 6, scratch)


def test_a_group_of_near_copies_beyond_the_share(spark, scratch):
    """Queries of a group that is half of all rows get the nearest of it, not any."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=16) if i % 2 else np.ones(16) + rng.normal(size=16) * 1e-3).astype(np.float32).tolist(), 0) for i in range(400)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = ann.search(frame, frame.where("vec_id % 50 = 0"), 5, scratch).collect()
    assert recall(found, rows) == 1.0


def test_repeated_rows_leave_room_for_other_ids(spark, scratch):
    rows = [(1, [1.0, 0.0], 0)] * 9 + [(2, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, [0.0, 1.0], 0), (5, [1.0, 0.2], 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = ann.search(frame, frame.where("vec_id in (1, 5)"), 3, scratch).collect()
    nearest = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1, 5)}
    assert nearest == {1: [2, 3, 5], 5: [1, 2, 3]}


def test_a_cosine_at_the_threshold_links(spark, scratch):
    """0.6, 0.8 and multiples of them are as exact as doubles are: their cosine with the axes is the threshold itself."""
    rows = [(1, [1.0, 0.0], 0), (2, [0.8, 0.6], 0), (3, [1.6, 1.2], 0), (4, [0.6, 0.8], 0), (5, [0.0, -1.0], 0), (5, [0.0, -2.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in CLASHING})
    found = {r["vec_id"]: r for r in embed_dedup.near_duplicates(frame, 0.8, scratch).collect()}
    assert [found[i]["n_links"] for i in (1, 2, 3, 4)] == [2, 3, 3, 2]
    assert {found[i]["component_id"] for i in (1, 2, 3, 4)} == {1} and found[5]["component_id"] == 5


def test_links_of_a_block_are_those_of_a_full_product(monkeypatch):
    rng = np.random.default_rng(8)
    centers = embed_dedup.unit(rng.normal(size=(40, 64)))
    rows = embed_dedup.unit(centers[rng.integers(0, 40, 700)] + rng.normal(size=(700, 64)) * rng.choice([0.02, 0.06, 0.3], (700, 1)))
    axes = embed_dedup.principal_axes(rows.T @ rows)
    want = rows[:300] @ rows[300:].T >= 0.9
    for dense in (-1.0, 2.0):
        monkeypatch.setattr(embed_dedup, "DENSE", dense)
        monkeypatch.setattr(embed_dedup, "STRIP", 64)
        assert (embed_dedup.linked(rows[:300], rows[300:], axes, 0.9) == want).all() and want.any()
