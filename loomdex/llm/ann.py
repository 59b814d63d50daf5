"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order.  The index is a table
of inverted files: for each pivot, block by block of vectors, the vectors that
post it and their ranks.  A query reads the files of its own nearest pivots,
fewer than are posted.  With absent pivots placed at rank m, the footrule
distance of two orders is a constant less twice the sum, over shared pivots,
of m - max(rank, rank), so the sum over the pivots that were read ranks a
block's vectors.  The best share of each block, the same at every size, and
everything close to the query's own order is reranked by the exact cosine.

Pivots come from a bounded sample; every vector is indexed.  Blocks of vectors
meet blocks of queries, so that no task holds more than a block of either.
Copies of a vector are one entry that keeps its smallest ids.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, nor do rows with a null id; vectors are compared with
those of their own length only; ties go to the smaller id; rows with one id
are one candidate, and one query, whose vector is the first in order; an empty
table, or no queries, gives no rows; other columns, whatever their names, play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, give_back, key_limit
from .vectors import distinct_vectors, matrix, unit, usable

#: Pivots, the nearest of them that are posted, and those that a query reads.
PIVOTS, POSTED, READ = 512, 96, 48
#: Vectors in the sample that pivots are chosen from, and the cosine from which one is too like a chosen pivot.
PIVOT_SAMPLE, PIVOT_LIKE = 1536, 0.8
#: The share of a block that is reranked, and at least so many rows for each neighbour asked for.
RERANKED_SHARE, RERANKED_EACH = 0.08, 8
#: Rows whose sum reaches this share of the greatest possible one are all reranked.
CLOSE = 0.7
#: Rows of a block of vectors and of a block of queries.
BLOCK, QUERY_BLOCK = 4096, 8192

FILES = "dim int, block int, pivot int, places array<int>, ranks array<int>"
RESULT = "query_id long, vec_id long, score double"


def choose_pivots(sample: np.ndarray) -> np.ndarray:
    """The first of the sample that are unlike each other, so that a group of
    near copies gives one pivot: pivots that are alike tell the same twice and
    drown what sets vectors apart.  If those are too few to post, others follow."""
    chosen, others = [], []
    for i, row in enumerate(sample):
        if len(chosen) == PIVOTS:
            break
        (others if chosen and (sample[chosen] @ row).max() >= PIVOT_LIKE else chosen).append(i)
    return sample[chosen + others[: max(0, POSTED - len(chosen))]]


def pivot_order(rows: np.ndarray, pivots: np.ndarray, kept: int) -> np.ndarray:
    """The places of each row's nearest pivots, nearest first."""
    return np.argsort(-(rows @ pivots.T), axis=1, kind="stable")[:, :kept].astype(np.int32)


@dataclass
class PermutationIndex:
    """vectors (dim, block, rep, ids, v), files (FILES), the unit pivots and
    the number of blocks by vector length, and the ids kept of equal vectors."""

    vectors: DataFrame
    files: DataFrame
    pivots: dict[int, np.ndarray]
    blocks: dict[int, int]
    kept_ids: int


def by_dim(values: dict[int, int]) -> Column:
    """A value for the row's vector length."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col("dim"))


def dealt(key: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), parts).cast("int")


def sampled_pivots(distinct: DataFrame, counts: dict[int, int]) -> dict[int, np.ndarray]:
    """Pivots for each vector length, from vectors with the smallest hashes."""
    limits = {dim: key_limit(min(1.0, (3 * PIVOT_SAMPLE + 100) / n)) for dim, n in counts.items()}
    first = Window.partitionBy("dim").orderBy("key")
    few = distinct.select("dim", "v", F.xxhash64("rep").alias("key")).where(F.col("key") <= by_dim(limits))
    few = few.withColumn("n", F.row_number().over(first)).where(F.col("n") <= PIVOT_SAMPLE)
    rows: dict[int, list] = {}
    for r in few.orderBy("dim", "n").select("dim", "v").collect():
        rows.setdefault(r["dim"], []).append(r["v"])
    return {dim: choose_pivots(unit(np.array(v, dtype=np.float64))) for dim, v in rows.items()}


def post(shared):
    """The inverted files of one block of vectors."""

    def files(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("rep")
        pivots = shared.value[int(block["dim"].iloc[0])]
        order = pivot_order(unit(matrix(block["v"])), pivots, POSTED)
        places, ranks = np.divmod(np.arange(order.size, dtype=np.int32), order.shape[1])
        by = np.argsort(order.ravel(), kind="stable")
        ends = np.searchsorted(order.ravel()[by], np.arange(len(pivots) + 1))
        held = [p for p in range(len(pivots)) if ends[p] < ends[p + 1]]
        cut = lambda values: [values[by[ends[p] : ends[p + 1]]] for p in held]
        return pd.DataFrame(
            {"dim": block["dim"].iloc[0], "block": block["block"].iloc[0], "pivot": held, "places": cut(places), "ranks": cut(ranks)}
        )

    return files


def build_index(
    vectors: DataFrame, scratch: Scratch, kept_ids: int, vec_id: str = "vec_id", vector: str = "embedding"
) -> PermutationIndex:
    """The index of all usable rows; of equal vectors the `kept_ids` smallest ids are kept."""
    own = usable(vectors, vec_id, vector)
    distinct = scratch.write(distinct_vectors(own, kept_ids).withColumn("dim", F.size("v")), "distinct")
    counts = {r["dim"]: r["count"] for r in distinct.groupBy("dim").count().collect()}
    if not counts:
        empty = vectors.sparkSession.createDataFrame([], FILES)
        return PermutationIndex(distinct.withColumn("block", F.lit(0)), empty, {}, {}, kept_ids)
    pivots = sampled_pivots(distinct, counts)
    blocks = {dim: -(-n // BLOCK) for dim, n in counts.items()}
    rows = distinct.select("dim", dealt("rep", by_dim(blocks)).alias("block"), "rep", "ids", "v")
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    files = rows.select("dim", "block", "rep", "v").groupBy("dim", "block").applyInPandas(post(shared), FILES)
    # Files of a pivot lie together, so a reader that asks for some pivots skips the rest.
    files = scratch.write(files.sortWithinPartitions("pivot", "dim", "block"), "files")
    return PermutationIndex(rows, files, pivots, blocks, kept_ids)


def search_block(vectors: pd.DataFrame, files: pd.DataFrame, queries: pd.DataFrame, k: int) -> tuple[list[tuple[int, int, float]], int]:
    """The k nearest found for each query in one block of vectors, and how many rows were reranked."""
    vectors = vectors.sort_values("rep")
    rows, asked, ids = unit(matrix(vectors["v"])), unit(matrix(queries["v"])), vectors["ids"].tolist()
    posted = {int(p): (np.asarray(at), POSTED - np.asarray(ranks)) for p, at, ranks in zip(files["pivot"], files["places"], files["ranks"])}
    budget = min(len(rows), max(RERANKED_EACH * k, int(np.ceil(RERANKED_SHARE * len(rows)))))
    out: list[tuple[int, int, float]] = []
    reranked = 0
    for query, order, x in zip(queries["id"], queries["nearest"], asked):
        shared = np.zeros(len(rows), np.int32)
        for rank, pivot in enumerate(order):
            if (file := posted.get(int(pivot))) is not None:
                shared[file[0]] += np.minimum(file[1], POSTED - rank)
        most = sum(POSTED - rank for rank in range(len(order)))
        near = np.argpartition(-shared, budget - 1)[:budget]
        if shared[near].min() >= CLOSE * most:
            near = np.flatnonzero(shared >= CLOSE * most)
        reranked += len(near)
        scores = rows[near] @ x
        best = np.sort(scores)[::-1][: k + 1][-1]
        found = {
            (-float(s), int(i))
            for row, s in zip(near[scores >= best], scores[scores >= best])
            for i in ids[row]
            if i != query
        }
        out += [(query, i, -s) for s, i in sorted(found)[:k]]
    return out, reranked


def block_searcher(k: int):
    """search_block for cogrouped frames; the second holds queries and files."""

    def found(vectors: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        queries, files = others[others["pivot"].isna()], others[others["pivot"].notna()]
        hits = [] if vectors.empty or queries.empty else search_block(vectors, files, queries, k)[0]
        frame = pd.DataFrame(hits, columns=["query_id", "vec_id", "score"])
        return frame.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return found


def nearest_pivots(queries: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """queries (id, v, dim) with `nearest`, the pivots to read."""
    shared = queries.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                order = pivot_order(unit(matrix(part["v"])), shared.value[int(dim)], READ)
                yield part.assign(nearest=list(order))
        give_back()

    schema = f"id long, v {queries.schema['v'].dataType.simpleString()}, dim int, nearest array<int>"
    return queries.select("id", "v", "dim").mapInPandas(run, schema)


def search_index(
    index: PermutationIndex, queries: DataFrame, k: int, scratch: Scratch, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest indexed rows
    but those with its own id; k must be less than the index's kept_ids."""
    spark = queries.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if k >= index.kept_ids:
        raise ValueError("the index keeps too few ids of equal vectors")
    if not index.blocks:
        return nothing
    asked = usable(queries, vec_id, vector).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    asked = scratch.write(nearest_pivots(asked.where(F.col("dim").isin(list(index.blocks))), index.pivots), "asked")
    counts = {r["dim"]: r["count"] for r in asked.groupBy("dim").count().collect()}
    if not counts:
        return nothing
    parts = {dim: -(-counts.get(dim, 0) // QUERY_BLOCK) for dim in index.blocks}
    every = lambda n: F.explode(F.sequence(F.lit(0), by_dim(n) - 1))
    keys = ["dim", "block", "query_block"]
    held = F.col("dim").isin(list(counts))
    left = index.vectors.where(held).select("dim", "block", every(parts).alias("query_block"), "rep", "ids", "v")
    right = asked.withColumn("query_block", dealt("id", by_dim(parts))).select(
        "dim", every(index.blocks).alias("block"), "query_block", "id", "v", "nearest"
    )
    # At most PIVOTS rows for each vector length.
    read = asked.select("dim", F.explode("nearest").alias("pivot")).distinct()
    files = index.files.where(held).join(F.broadcast(read), ["dim", "pivot"], "left_semi")
    files = files.select("dim", "block", every(parts).alias("query_block"), "pivot", "places", "ranks")
    right = right.unionByName(files, allowMissingColumns=True)
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block_searcher(k), RESULT)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search(
    vectors: DataFrame, queries: DataFrame, k: int, scratch: Scratch, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """search_index on an index of `vectors`.  Both frames have the two columns."""
    index = build_index(vectors, scratch, k + 1, vec_id, vector)
    return search_index(index, queries, k, scratch, vec_id, vector)
