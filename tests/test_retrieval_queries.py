"""The retrieval queries do their whole job, in a number of steps that does not grow."""

import pytest
from pyspark.sql import functions as F

from loomdex import queries
from loomdex.functions.text import tokenize
from loomdex.operators import fusion
from loomdex.plans import evaluation

SF = "/root/testdata/sf0.001"


def test_term_stats_has_a_row_for_every_term(spark):
    found = queries.bm25_term_stats(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = docs.select("doc_id", F.explode(tokenize("text")).alias("term")).distinct()
    want = {r["term"]: r["n"] for r in words.groupBy("term").agg(F.count("*").alias("n")).collect()}
    assert found.columns == ["term", "df", "idf"]
    rows = found.collect()
    assert len(rows) == len(want) and {r["term"]: r["df"] for r in rows} == want


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_are_not_moved_for_few_hits(spark, no_broadcast):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).repartition(3)
    hits = spark.createDataFrame([(1, 7, 1), (1, 9, 2)], "query_id long, doc_id long, rank int")
    found = fusion.with_texts(hits, docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r["rank"], r["text"]) for r in found.collect()) == [(1, "7"), (2, "9")]


def test_grid_search_searches_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(rank):
        seen.add(1)
        return rank

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "q", 0, "", ["a", "b"])], "ordinal long, question string, answer_index int, answer string, options array<string>")
    hits = spark.createDataFrame([(1, i, 0.5, i + 1) for i in range(6)], "query_id long, doc_id long, score double, rank int").withColumn("rank", counted("rank"))
    assert evaluation.grid_search(asked, hits, docs, [1, 3, 5]).count() == 3
    assert seen.value == 6
