"""Nearest vectors by cells: a stored index whose searches read a share of it.

Centroids are learned on a bounded sample.  Each vector is written to the
partition of its nearest centroid.  A query goes to the cells of its nearest
centroids; other cells are not read.  Queries and vectors of a cell meet in
groups of bounded size: a large cell is dealt to parts by the hash of the
vectors' ids, and the many queries of a cell to parts by the hash of theirs.
With all cells probed, the result is that of an exact search.

An index holds vectors of one length and finite components; null vectors and
others take no part.  A zero vector has cosine 0 with all.  Scores are rounded
and ties go to the smaller id, as in an exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables, versions
from .dense import DIGITS, ROUNDING, measured, ranked

#: Most cells, vectors that centroids are learned from, and rounds of learning.
MOST_CELLS, SAMPLE_ROWS, ROUNDS = 4096, 65_536, 8
#: Vectors and queries of a group at most (about: they are dealt by hash).
PART_ROWS, PART_QUERIES = 4096, 1024
#: Tasks that write a cell.
WRITERS = 4


def rows_of(vectors: list, length: int | None = None) -> np.ndarray:
    return np.array(vectors, dtype=np.float64) if len(vectors) else np.empty((0, length or 0))


def sound(v: str, length: int) -> Column:
    """Whether a vector has this length and finite components only."""
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(v) == length) & finite, F.lit(False))


def directions(rows: np.ndarray, measure: str) -> np.ndarray:
    """What is compared with centroids: unit vectors for cosine."""
    if measure == "l2":
        return rows
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def nearest_cells(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, the nearest first."""
    gap = (centroids * centroids).sum(1)[None, :] - 2 * rows @ centroids.T
    if n < len(centroids):
        some = np.argpartition(gap, n - 1, axis=1)[:, :n]
    else:
        some = np.broadcast_to(np.arange(len(centroids)), gap.shape)
    return np.take_along_axis(some, np.argsort(np.take_along_axis(gap, some, 1), axis=1, kind="stable"), 1)


def learned(sample: np.ndarray, cells: int, measure: str) -> np.ndarray:
    """Centroids of a sample in random order; one without rows stays where it is."""
    rows = directions(sample, measure)
    centroids = np.unique(rows[: 4 * cells], axis=0)
    centroids = centroids[np.random.default_rng(0).permutation(len(centroids))[:cells]]
    for _ in range(ROUNDS):
        own = nearest_cells(rows, centroids, 1)[:, 0]
        sums, counts = np.zeros_like(centroids), np.bincount(own, minlength=len(centroids))
        np.add.at(sums, own, rows)
        held = counts > 0
        centroids[held] = sums[held] / counts[held, None]
        centroids = directions(centroids, measure)
    return centroids


class CellIndex:
    """One version of a stored index."""

    def __init__(self, spark: SparkSession, folder: str, version: int, body: dict):
        self.spark, self.folder, self.version, self.body = spark, folder, version, body
        self.measure, self.length, self.sizes = body["measure"], body["length"], body["sizes"]

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> CellIndex | None:
        found = versions.current(spark, folder)
        return cls(spark, folder, *found) if found else None

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, cells: int | None = None, measure: str = "cosine") -> CellIndex:
        """The next version, of vectors (doc_id, v, …); other columns are kept.
        Without a number of cells there are as many as the root of that of the vectors."""
        if measure not in ("cosine", "l2"):
            raise ValueError(f"unknown measure {measure!r}")
        spark = vectors.sparkSession
        lengths = {r["n"]: r["count"] for r in vectors.where("v is not null").groupBy(F.size("v").alias("n")).count().collect()}
        length = max(lengths, key=lambda n: (lengths[n], n), default=0)
        rows = vectors.where(sound("v", length))
        count = rows.count()
        cells = min(MOST_CELLS, max(1, cells or round(count**0.5)))
        sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(min(SAMPLE_ROWS, max(64, 64 * cells))).select("v").collect()
        centroids = learned(rows_of([r["v"] for r in sample], length), cells, measure) if sample else np.zeros((1, length))
        part = versions.fresh_part(folder, "cells")
        shared, measured_by = spark.sparkContext.broadcast(centroids), measure

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = nearest_cells(directions(rows_of(batch.column("v").to_pylist(), length), measured_by), shared.value, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[*batch.schema.names, "cell"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        found = rows.mapInArrow(placed, f"{kinds}, cell int")
        found = found.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(WRITERS)))
        found.write.partitionBy("cell").parquet(f"{folder}/{part}/vectors")
        places = [(i, c.tolist()) for i, c in enumerate(centroids)]
        spark.createDataFrame(places, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/{part}/centroids")
        own = cls(spark, folder, 0, {"part": part, "measure": measure, "length": length, "sizes": {}, "schema": f"{kinds}, cell int"})
        counts = {str(r["cell"]): r["count"] for r in own.vectors.groupBy("cell").count().collect()}  # MOST_CELLS at most
        return cls(spark, folder, *versions.publish(spark, folder, lambda _: own.body | {"sizes": counts}))

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.body["schema"]).parquet(f"{self.folder}/{self.body['part']}/vectors")

    @property
    def centroids(self) -> np.ndarray:
        held = self.spark.read.parquet(f"{self.folder}/{self.body['part']}/centroids").orderBy("cell").collect()
        return rows_of([r["centroid"] for r in held], self.length)

    def prune(self, keep: int = 2) -> list[str]:
        return versions.prune(self.spark, self.folder, lambda body: {body["part"]}, keep)

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """(query_id, q, cell) of each query and its nearest cells."""
        shared, measure, length = self.spark.sparkContext.broadcast(self.centroids), self.measure, self.length

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = nearest_cells(directions(rows_of(batch.column("q").to_pylist(), length), measure), shared.value, min(nprobe, len(shared.value)))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(list(found.astype(np.int32)), pa.list_(pa.int32()))], names=["query_id", "cells"])

        asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where(sound("q", length))
        kind = asked.schema["query_id"].dataType.simpleString()
        held = asked.select("query_id", "q").mapInArrow(near, f"query_id {kind}, cells array<int>")
        return held.select("query_id", F.explode("cells").alias("cell")).join(asked, "query_id")

    def scanned(self, cells: list[int]) -> DataFrame:
        """The vectors of some cells; other partitions are not read."""
        return self.vectors.where(F.col("cell").isin(sorted(cells)))

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, where: Column | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank): the k nearest vectors that `where` admits,
        in the nprobe nearest cells of each query (query_id, q), query_id being
        unique; in all cells without nprobe."""
        probes = tables.kept(self.probes(queries, nprobe or MOST_CELLS))
        asked = {r["cell"]: r["count"] for r in probes.groupBy("cell").count().collect()}  # MOST_CELLS at most
        groups = [(c, -(-self.sizes[str(c)] // PART_ROWS), -(-n // PART_QUERIES)) for c, n in asked.items() if str(c) in self.sizes]
        if not groups:
            kind = queries.schema["query_id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id {kind}, doc_id {self.vectors.schema['doc_id'].dataType.simpleString()}, score double, rank int")
        dealt = F.broadcast(self.spark.createDataFrame(groups, "cell int, parts int, query_parts int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        rows = self.scanned([c for c, _, _ in groups])
        rows = (rows if where is None else rows.where(where)).select("cell", "doc_id", "v").join(dealt, "cell")
        rows = rows.withColumn("part", own("doc_id", "parts")).select("cell", "part", every("query_parts").alias("query_part"), "doc_id", "v")
        sides = probes.join(dealt, "cell").withColumn("query_part", own("query_id", "query_parts"))
        sides = sides.select("cell", every("parts").alias("part"), "query_part", "query_id", "q")
        measure, length = self.measure, self.length

        def met(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, vectors = left.column("doc_id").combine_chunks(), rows_of(left.column("v").to_pylist(), length)
            names, asked = right.column("query_id").combine_chunks(), rows_of(right.column("q").to_pylist(), length)
            if not len(ids) or not len(names):
                return pa.table({"query_id": names.slice(0, 0), "doc_id": ids.slice(0, 0), "score": pa.array([], pa.float64())})
            scores = measured(vectors, asked, measure)
            key = scores if measure == "l2" else -scores
            at = min(k, key.shape[1]) - 1
            limit = np.partition(key, at, axis=1)[:, at : at + 1] + 2 * ROUNDING
            query, row = np.nonzero(key <= limit)
            return pa.table({"query_id": names.take(pa.array(query)), "doc_id": ids.take(pa.array(row)), "score": pa.array(scores[query, row])})

        kinds = [f"{c} {f.schema[c].dataType.simpleString()}" for f, c in ((probes, "query_id"), (rows, "doc_id"))]
        keys = ["cell", "part", "query_part"]
        found = rows.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(met, f"{', '.join(kinds)}, score double")
        return ranked(found.withColumn("score", F.round("score", DIGITS) + 0.0), k, measure)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact (query_id, doc_id) that was found."""
    both = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    return both.count() / max(1, exact.count())
