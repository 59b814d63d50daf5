"""BM25 rankings over a stored index of segments, or over one made on the way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokenize
from .segments import SegmentedIndex, postings_of

K1, B = 1.5, 0.75
#: Share of the mean idf that a negative idf becomes.
EPSILON = 0.25


@dataclass
class LexicalIndex:
    """An index that is not stored: postings (doc_id, term, tf, dl), terms (term, df, idf) and stats (n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def hits(self, queries: DataFrame, query_id: str, text: str, k: int, also: DataFrame | None = None) -> tuple[DataFrame, None]:
        """The scores of all documents that share a term with a query."""
        return scores(self, queries, query_id, text), None


Index = LexicalIndex | SegmentedIndex


def stored_index(docs: DataFrame, folder: str, k1: float = K1, b: float = B) -> SegmentedIndex:
    """The index of `docs` kept in a folder; a new version of all documents if
    it is not there, or is of another number of documents or other parameters."""
    found = SegmentedIndex.open(docs.sparkSession, folder)
    if found is not None and (found.documents, found.k1, found.b) == (docs.count(), k1, b):
        return found
    return SegmentedIndex.build(docs, folder, k1, b)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LexicalIndex:
    """The index of all documents; one without words has no postings but counts
    for the mean length."""
    postings = postings_of(docs, doc_id, text)
    words = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words"))
    stats = docs.agg(F.count("*").alias("n")).crossJoin(F.broadcast(words))  # two one-row counts
    stats = stats.select("n", (F.col("words") / F.greatest("n", F.lit(1))).alias("avgdl"))
    return LexicalIndex(postings, weights(postings, stats), stats)


def weights(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf); a negative idf becomes a share of the mean idf."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = df.crossJoin(F.broadcast(stats.select("n"))).withColumn("raw", raw)  # stats is one row
    mean = terms.agg(F.avg("raw").alias("mean_idf"))
    terms = terms.crossJoin(F.broadcast(mean))
    return terms.select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def scores(index: LexicalIndex, queries: DataFrame, query_id: str, text: str, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) for documents that share a term with a query;
    a term counts as often as the query has it."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode_outer(tokenize(text)).alias("term"))
    asked = asked.where("term is not null").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    met = index.postings.join(asked.join(index.terms, "term"), "term").crossJoin(F.broadcast(index.stats.select("avgdl")))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / norm
    return met.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller doc_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(index: Index, queries: DataFrame, query_id: str, text: str, k: int) -> DataFrame:
    """The k best documents that share a term with the query."""
    return ranked(index.hits(queries, query_id, text, k)[0], k)


def topk_padded(index: Index, docs: DataFrame, queries: DataFrame, query_id: str, text: str, k: int) -> DataFrame:
    """As topk, filled up to k with documents of score 0 in order of doc_id.
    The k smallest ids are all that can be needed, so they are all that is
    added to each query."""
    lowest = docs.select("doc_id").orderBy("doc_id").limit(k)
    hits = index.hits(queries, query_id, text, k, lowest)[0]
    pad = queries.select(F.col(query_id).alias("query_id")).crossJoin(F.broadcast(lowest)).withColumn("score", F.lit(0.0))
    both = hits.unionByName(pad).groupBy("query_id", "doc_id")
    # A hit's own score holds, also where it is negative or equal.
    best = both.agg(F.count("*").alias("n"), F.sum("score").alias("score")).drop("n")
    return ranked(best, k)
