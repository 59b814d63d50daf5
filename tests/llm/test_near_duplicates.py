import random

import numpy as np
import pyarrow as pa
import pytest

from loomdex.llm import ngram_join, shingles
from loomdex.llm.components import components
from tests.llm import brute


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(80)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("width,part", [(4, 85), (5, 80)])
def test_components_equal_brute_force(documents_of, scratch, width, part):
    rng = random.Random(width)
    words = [f"v{i}" for i in range(500)]
    texts = [t for edits in (1, 3, 8) for t in family(rng, words, 60, edits)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(100)] + ["", " ", "a b", "A  b", None]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = documents_of([(i, t, "en", "s", 0) for i, t in rows])
    found = ngram_join.near_groups(docs, width, ngram_join.Jaccard(part, 100), scratch).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.near_groups(rows, width, part, 100)


def test_odd_documents(odd_documents, no_documents, scratch):
    measure = ngram_join.Jaccard(80, 100)
    found = ngram_join.near_groups(odd_documents, 5, measure, scratch)
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()]
    assert len(rows) == 10
    by = {i: (n, c) for i, n, c in rows}
    assert by[1] == by[2] and by[1][1] == by[3][1] == 1
    assert by[4] == (0, 4) and by[5] == (0, 5) and by[6] == (0, 6) and by[8] == (1, 8)
    kept = ngram_join.representatives(odd_documents, found)
    assert kept.columns == odd_documents.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4, 5, 6, 7, 8, 8]
    assert ngram_join.near_groups(no_documents, 5, measure, scratch).count() == 0


def test_shingles_do_not_depend_on_the_batch():
    texts = ["One two three four five", "", None, "one  two\tTHREE four\nfive", "six", "x" * 3_000_000 + " one two three four", "é È ß four"]
    whole = list(shingles.shingle_sets(pa.array(texts), 4))
    single = [s for t in texts for s in shingles.shingle_sets(pa.array([t], pa.string()), 4)]
    assert all(np.array_equal(a, b) for a, b in zip(whole, single, strict=True))
    assert np.array_equal(whole[0], whole[3]) and not len(whole[1]) and not len(whole[2]) and len(whole[4]) == 1
    sliced = pa.array(["pad", *texts]).slice(1)
    assert all(np.array_equal(a, b) for a, b in zip(whole, shingles.shingle_sets(sliced, 4), strict=True))


def test_components_of_long_chains_and_stars(spark, scratch):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5000), (7, 3)]
    found = components(spark.createDataFrame(links, "a long, b long"), scratch)
    nodes = {x for link in links if link[0] != link[1] for x in link}
    assert {r["node"]: r["component"] for r in found.collect()} == brute.components(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
