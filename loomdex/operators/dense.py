"""Exact nearest vectors by cosine or squared L2 distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .running import DIGITS, Best, Rough, likely, tasks_of

#: Queries that are broadcast at a time; their number is checked first.
QUERY_BLOCK = 16_384
#: Rows and queries that are multiplied at a time.
ROWS, QUERIES = 1024, 512
#: The pairs of a row and a query that are scored in double precision at a time.
PAIRS = 65_536
#: Numbers of rows that are held until the best by rough scores are known.
HELD = 4_000_000
#: Rows (query, vector) that each task may pass on before there are no more tasks than cores.
PASSED_ROWS = 100_000
#: What rounding moves a score by at most.
ROUNDING = 0.5e-6


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision, added up in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def measured(rows: np.ndarray, queries: np.ndarray, measure: str) -> np.ndarray:
    """Scores of all rows (as columns) with all queries; a zero vector has cosine 0."""
    products = queries @ rows.T
    squares = [(m * m).sum(1) for m in (queries, rows)]
    if measure == "l2":
        return np.maximum(squares[0][:, None] + squares[1][None, :] - 2 * products, 0.0)
    norms = np.sqrt(squares[0])[:, None] * np.sqrt(squares[1])[None, :]
    return np.divide(products, norms, out=np.zeros_like(products), where=norms > 0)


def matrix(lists: pa.ListArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of this length as rows, and their places; others are left out."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), length), False).to_numpy(zero_copy_only=False))
    flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(at), length), at


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in single precision, and the lengths; one of length 0 stays."""
    norms = np.sqrt((vectors * vectors).sum(1))
    return (vectors / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32), norms


class Cosines:
    """Rows are multiplied with a block of queries in single precision; what can
    be among the best by that is scored in double precision."""

    def __init__(self, queries: np.ndarray, best: Best):
        self.queries, self.best, self.held = queries, best, Rough(best)
        self.units, self.norms = unit(queries)
        #: A sum of n products of parts of unit vectors is off by less, twice over.
        self.held.off[:] = (queries.shape[1] + 8) * 2.0**-23
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, rows: np.ndarray, docs: np.ndarray) -> None:
        units, norms = unit(rows)
        units = np.ascontiguousarray(units.T)
        limits, off = self.held.limits(), self.held.off
        for first in range(0, len(self.queries), QUERIES):
            own = slice(first, first + QUERIES)
            rough = self.units[own] @ units
            query, row = likely(rough, limits[own], off[own], self.best.k)
            self.held.add(query + first, row + self.count, rough[query, row])
        self.rows.append((rows, norms, docs))
        self.count += len(rows)
        if self.count * rows.shape[1] > HELD:
            self.settle()

    def settle(self) -> None:
        """Scores what is held in double precision."""
        if not self.rows:
            return
        query, row = self.held.settled()
        rows, norms, docs = (np.concatenate(c) for c in zip(*self.rows))
        for low in range(0, len(query), PAIRS):
            q, d = query[low : low + PAIRS], row[low : low + PAIRS]
            lengths = self.norms[q] * norms[d]
            dots = np.einsum("ij,ij->i", self.queries[q], rows[d])
            self.best.take(q, docs[d], np.divide(dots, lengths, out=np.zeros(len(q)), where=lengths > 0), len(self.queries))
        self.best.found()
        self.rows, self.count = [], 0


def best_of_batches(shared, k: int, measure: str):
    """For a block of queries the k nearest of all rows of a task."""
    sign = -1.0 if measure == "l2" else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        best = Best(len(ids), k)
        cosines = Cosines(queries, best)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                rows, at = matrix(part.column("v"), queries.shape[1])
                if not len(rows):
                    continue
                docs = part.column("doc_id").to_numpy(zero_copy_only=False)[at]
                if measure == "cosine" and np.isfinite(rows).all() and np.isfinite(queries).all():
                    cosines.add(rows, docs)
                    continue
                for first in range(0, len(ids), QUERIES):
                    best.add(sign * measured(rows, queries[first : first + QUERIES], measure), docs, first)
        cosines.settle()
        query, doc, score = best.found()
        for low in range(0, len(query), 100_000):
            at = slice(low, low + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[query[at]], pa.int64()), pa.array(doc[at], pa.int64()), pa.array(sign * score[at], pa.float64())],
                names=["query_id", "doc_id", "score"],
            )

    return run


def topk(vectors: DataFrame, queries: DataFrame, k: int, measure: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k nearest of the rows (doc_id, v) that `where` admits, of each query
    (query_id, q), with their rank; scores are rounded to DIGITS and ties go to the smaller
    doc_id.  Queries are broadcast in blocks of QUERY_BLOCK rows, so vectors
    are not moved; each batch of vectors is multiplied with a block at once,
    and a task passes on its own k best.  A zero vector has cosine 0; null vectors and
    vectors of another length take no part."""
    if measure not in ("cosine", "l2"):
        raise ValueError(f"unknown measure {measure!r}")
    spark = vectors.sparkSession
    rows = (vectors if where is None else vectors.where(where)).select("doc_id", "v")
    asked = queries.select("query_id", "q").where("q is not null")
    count = asked.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    if count * k > PASSED_ROWS:
        rows = rows.coalesce(tasks_of(spark.sparkContext.defaultParallelism, blocks))
    parts = []
    for i in range(blocks if count else 0):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        table = own.toArrow()
        for length in pc.unique(pc.list_value_length(table["q"])).to_pylist():
            found, at = matrix(table["q"], length)
            shared = spark.sparkContext.broadcast((table["query_id"].to_numpy()[at].astype(np.int64), found))
            parts.append(rows.mapInArrow(best_of_batches(shared, k, measure), "query_id long, doc_id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    # Adding 0 makes a negative zero positive, so equal scores are equal bits.
    return ranked(reduce(DataFrame.unionByName, parts).withColumn("score", F.round("score", DIGITS) + 0.0), k, measure)


def ranked(scored: DataFrame, k: int, measure: str) -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller doc_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if measure == "cosine" else F.asc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
