import random

import pytest

from loomdex.operators import grading
from loomdex.streaming import ordered


def answers(n, seed):
    rng = random.Random(seed)
    return [(run, i, rng.random() < 0.6) for run in ("a", "b") for i in range(n)]


@pytest.mark.parametrize("restarts", [1, 3])
def test_out_of_order_answers_are_committed_in_order(spark, tmp_path, restarts):
    rows, rng = answers(60, 1), random.Random(2)
    kind = "run string, ordinal long, is_correct boolean"
    shuffled = rng.sample(rows, len(rows))
    inbox, results, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in range(restarts):  # each start reads the files that are new
        some = shuffled[part :: restarts]
        for i in range(0, len(some), 30):
            repeated = some[i : i + 30] + some[max(0, i - 3) : i]  # some come twice
            spark.createDataFrame(repeated, kind).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(inbox)
        query = ordered.commit_stream(stream, results, state)
        assert query.awaitTermination(120)
    found = spark.read.parquet(*[str(p) for p in (tmp_path / "out").iterdir() if any(p.glob("*.parquet"))])
    want = grading.running(spark.createDataFrame(rows, kind), "ordinal", "run").select(*found.columns)
    key = lambda f: sorted(map(tuple, f.collect()))
    assert found.count() == 120 and key(found) == key(want)


def test_a_gap_holds_up_what_follows(spark, tmp_path):
    kind = "run string, ordinal long, is_correct boolean"
    inbox, results, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows, done in (([("a", 0, True), ("a", 2, True), ("a", 3, None)], 1), ([("a", 1, False)], 4)):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(inbox)
        ordered.commit_stream(spark.readStream.schema(kind).parquet(inbox), results, state).awaitTermination(120)
        held = spark.read.parquet(*[str(p) for p in (tmp_path / "out").iterdir() if any(p.glob("*.parquet"))])
        assert held.count() == done
    assert [(r["ordinal"], r["correct_so_far"]) for r in held.orderBy("ordinal").collect()] == [(0, 1), (1, 1), (2, 2), (3, 2)]
