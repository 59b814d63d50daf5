import pytest
from pyspark.sql import functions as F

from loomdex.operators import caching
from loomdex.sources import cache, versions


def rows_of(spark, keys, context):
    return spark.createDataFrame([(k, [1.0], [f"{context} of {k}"]) for k in keys], "question_key string, scores array<double>, contexts array<string>")


def contexts(spark, path, version="1", k=3):
    return {r["question_key"]: r["contexts"][0] for r in cache.read(spark, path, version, k).collect()}


def test_the_newest_row_holds_before_and_after_compaction(spark, tmp_path):
    path = str(tmp_path)
    assert cache.read(spark, path, "1", 3).count() == 0
    keys = [f"k{i}" for i in range(40)]
    cache.append(rows_of(spark, keys, "old"), path, "1", 3)
    cache.append(rows_of(spark, keys[:10] + ["new"], "fresh"), path, "1", 3)
    cache.append(rows_of(spark, keys[:5], "another"), path, "2", 3)
    want = {k: f"old of {k}" for k in keys[10:]} | {k: f"fresh of {k}" for k in [*keys[:10], "new"]}
    before = cache.read(spark, path, "1", 3)
    assert contexts(spark, path) == want and len(cache.parts(spark, path)) == 3
    cache.compact(spark, path)
    assert contexts(spark, path) == want and len(cache.parts(spark, path)) == 1
    assert contexts(spark, path, "2") == {k: f"another of {k}" for k in keys[:5]} and contexts(spark, path, "1", 4) == {}
    assert before.count() == 41  # a reader of the version before keeps its files
    asked = spark.createDataFrame([("k1",), ("none",)], "question_key string")
    assert caching.hits(asked, cache.read(spark, path, "1", 3)).count() == caching.misses(asked, cache.read(spark, path, "1", 3)).count() == 1
    for i in range(2 * cache.MOST_PARTS):  # parts do not grow in number
        cache.append(rows_of(spark, [f"more{i}"], "x"), path, "1", 3)
    assert len(cache.parts(spark, path)) <= cache.MOST_PARTS and len(contexts(spark, path)) == 41 + 2 * cache.MOST_PARTS
    assert len(versions.numbers(spark, path)) <= 6


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_join_moves_the_questions_only(spark, tmp_path, no_broadcast):
    path = str(tmp_path)
    cache.append(rows_of(spark, [f"k{i}" for i in range(200)], "x"), path, "1", 3)
    asked = spark.range(50).select(F.concat(F.lit("k"), F.col("id")).alias("question_key"))
    for joined in (caching.hits(asked, cache.read(spark, path, "1", 3)), caching.for_generation(asked, cache.read(spark, path, "1", 3))):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        # The one exchange is above the questions' range, not above the scan of the cache.
        assert "FileScan" not in plan.split("Exchange hashpartitioning")[1].split("FileScan")[0] and "Range" in plan.split("Exchange hashpartitioning")[1]
        assert joined.count() == 50


def test_a_catalog_that_forgot_the_parts(spark, tmp_path):
    path = str(tmp_path)
    cache.append(rows_of(spark, ["a", "b"], "x"), path, "1", 3)
    part = versions.current(spark, path)[1]["parts"][0]
    spark.sql(f"drop table {cache.table_name(part)}")
    assert contexts(spark, path) == {"a": "x of a", "b": "x of b"}
