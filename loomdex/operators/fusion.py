"""Reciprocal rank fusion, hybrid search and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import tables

#: The constant of reciprocal rank fusion and the share of the dense list.
RRF_K, DENSE_WEIGHT = 60, 0.5


def rrf(dense: DataFrame, sparse: DataFrame, weight: float = DENSE_WEIGHT, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, score) from two lists (query_id, doc_id, rank).  A
    union of both lists' shares and one aggregation do what a full join would."""
    part = lambda hits, w: hits.select("query_id", "doc_id", (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("part"))
    both = part(dense, weight).unionByName(part(sparse, 1 - weight))
    return both.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))


def best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, weight: float = DENSE_WEIGHT, rrf_k: int = RRF_K) -> DataFrame:
    """The k best of the fused lists; texts are joined afterwards."""
    return best(rrf(dense, sparse, weight, rrf_k), k)


def dense_only(dense: DataFrame, k: int) -> DataFrame:
    """A dense list of 2k, repeats dropped, cut to k, scored by 1 / rank."""
    once = dense.groupBy("query_id", "doc_id").agg(F.min("rank").alias("raw"))
    order = Window.partitionBy("query_id").orderBy("raw")
    cut = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return cut.select("query_id", "doc_id", "rank", F.round(1.0 / F.col("raw"), 9).alias("score"))


def with_texts(hits: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Hits are few beside the texts, which are not moved where the hits can be broadcast."""
    return tables.small(hits).join(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")


def rerank(hits: DataFrame, k: int, score: str = "rerank_score") -> DataFrame:
    """The k best by a reranker's score, ties in the old order; a query that
    lacks a score of any of its hits keeps its old order as a whole."""
    query = Window.partitionBy("query_id")
    whole = F.count(F.col(score)).over(query) == F.count("*").over(query)
    held = hits.withColumn("_value", F.when(whole, F.col(score)))
    order = query.orderBy(F.desc_nulls_last("_value"), "rank")
    return held.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).drop("_value")
