import hashlib
import random

import pytest

from loomdex.llm import curriculum
from tests.llm import brute


def rows_of(seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", "c", "d", None]), " ".join("w" * rng.randrange(1, 5) for _ in range(rng.choice([0, 3, 40, 200])))) for i in range(300)]


def test_equals_brute_force(documents_of, scratch):
    for seed in range(2):
        rows = rows_of(seed)
        docs = documents_of([(i, t, "en", s, 0) for i, s, t in rows])
        found = curriculum.mix(docs, scratch).collect()
        want = brute.mixed(rows)
        for r in found:
            size, target, taken, copies = want[r["doc_id"]]
            assert (r["size"], r["taken"], r["copies"]) == (size, taken, copies) and r["target"] == pytest.approx(target)
            assert r["taken"] <= 3 * r["size"] and len(r["positions"]) == copies and all(0 <= p <= 1 for p in r["positions"])
        for s in {s for _, s, _ in rows}:
            own = [r for r in found if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1


def test_positions_follow_the_curve(spark):
    from pyspark.sql import functions as F

    shares = spark.range(1, 100).select((F.col("id") / 100).alias("u"))
    for knots in ((1.5, 1.0, 0.5), (0.5, 1.5), (1.0, 1.0, 1.0), (0.2, 2.0, 0.0, 1.0)):
        areas = [(a + b) / 2 for a, b in zip(knots, knots[1:])]
        for r in shares.withColumn("t", curriculum.due_time(F.col("u"), knots)).collect():
            x = r["t"] * len(areas)
            i = min(int(x), len(areas) - 1)
            f = x - i
            due = sum(areas[:i]) + knots[i] * f + (knots[i + 1] - knots[i]) * f * f / 2
            assert due / sum(areas) == pytest.approx(r["u"], abs=1e-9)


def test_odd_documents(odd_documents, no_documents, scratch):
    mixed = curriculum.mix(odd_documents, scratch)
    rows = curriculum.documents_by_position(mixed).collect()
    assert len(rows) == 10
    assert all(r["taken"] == 0 and r["position"] is None for r in rows if r["doc_id"] in (4, 5, 6))
    places = [r["position"] for r in rows if r["position"] is not None]
    assert places == sorted(places)
    stream = curriculum.training_stream(odd_documents, mixed)
    assert stream.columns == odd_documents.columns
    assert curriculum.mix(no_documents, scratch).count() == 0
    assert curriculum.training_stream(no_documents, curriculum.mix(no_documents, scratch)).count() == 0


def test_reruns_agree(documents_of, scratch):
    docs = documents_of([(i, t, "en", s, 0) for i, s, t in rows_of(5)])
    key = lambda r: hashlib.md5(str(r).encode()).hexdigest()
    a, b = (sorted(map(key, curriculum.mix(d, scratch).collect())) for d in (docs, docs.repartition(7)))
    assert a == b


def test_stream_holds_every_reading_of_null_and_repeated_ids(documents_of, scratch):
    rows = [(i, f"unique {i} " + "w " * (i % 7), "en", "ab"[i % 2], 0) for i in range(40)]
    rows += [(None, f"null {i} " + "w " * (i % 3), "en", "abc"[i % 3] if i % 4 else None, 0) for i in range(30)]
    rows += [(50, "the same row", "en", "a", 0)] * 4 + [(51, f"one id {i}", "en", "ab"[i % 2], 0) for i in range(6)]
    docs = documents_of(rows, clashing=True)
    mixed = curriculum.mix(docs, scratch)
    want = {}
    for r in mixed.collect():
        key = (r["doc_id"], r["source"], r["size"])
        want[key] = want.get(key, 0) + r["copies"]
    stream = curriculum.training_stream(docs, mixed)
    found, times = {}, {}
    for r in stream.collect():
        key = (r["doc_id"], r["source"], len(r["text"].split()))
        found[key] = found.get(key, 0) + 1
        times[r["text"]] = times.get(r["text"], 0) + 1
    assert stream.columns == docs.columns
    assert found == {k: n for k, n in want.items() if n}
    assert all(n <= 3 * sum(row[1] == t for row in rows) for t, n in times.items())
