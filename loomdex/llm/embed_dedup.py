"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are rotated to the principal axes, which keeps every dot product
and puts the largest coordinates first.  Rows are dealt into tiles along the
first axis; two unit vectors with cosine c lie within sqrt(2 - 2c) on every
axis, so only tiles with near intervals meet.  In a pair of tiles products are
accumulated along the axes; the rest of a product is at most the product of
the two suffix norms, so pairs whose bound is below the threshold are left
after a few axes.  What stays open is decided by the cosine of the original
vectors in double precision.

A pair of tiles returns link counts of its rows and the edges of a spanning
forest, not its links, so a large group of near copies stays linear in size.
Copies of a vector are one row that carries their number.

Defined results: vectors that are null, zero or hold null or non-finite
components link with nothing and are their own component, as are rows with a
null id (whose component is null); vectors of different lengths never link; a
cosine of exactly the threshold links; rows that repeat an id are copies, or
further vectors, of one node; an empty table gives no rows; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, hot_join
from .components import components
from .vectors import distinct_vectors, matrix, unit, usable, usable_row

#: Rows of a tile, the first axes that a strip is multiplied along, those added to open pairs at a time, and the slack of single precision.
TILE = 4096
LEAD, STEP = 16, 16
SLACK = 1e-5
#: The share of open pairs from which a whole strip is multiplied, and pairs that are decided at a time.
DENSE, PAIRS = 0.02, 65_536
#: Rows of a tile that are compared at a time.
STRIP = 512
NONE = np.iinfo(np.int32).max


def moments(vectors: DataFrame, dim: int) -> np.ndarray:
    """The sum of outer products of all unit vectors, added up in Spark."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for batch in batches:
            rows = unit(matrix(batch["v"]))
            total += rows.T @ rows
        give_back()
        yield pd.DataFrame({"cell": np.arange(dim * dim), "value": total.ravel()})

    cells = vectors.select("v").mapInPandas(partial, "cell int, value double")
    total = np.zeros(dim * dim)
    for r in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        total[r["cell"]] = r["value"]
    return total.reshape(dim, dim)


def principal_axes(total: np.ndarray) -> np.ndarray:
    values, axes = np.linalg.eigh(total)
    return np.ascontiguousarray(axes[:, np.argsort(-values)])


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> np.ndarray:
    """The links of unit rows as a Boolean matrix.

    A strip of a meets all of b along the LEAD first axes; what the other axes
    can add is at most the product of the two suffix norms, which takes part in
    the same product as one more coordinate.  Pairs that can still reach the
    threshold are carried on by themselves, some axes at a time, until their
    bound is too low.  What stays open is decided by the product of the original
    rows in double precision; so is a strip of which a great share stays open,
    as a whole, without rows and columns that have no open pair."""
    sides = []
    for rows in (a, b):
        turned = rows @ axes
        rest = np.sqrt(np.maximum(np.cumsum((turned * turned)[:, ::-1], axis=1)[:, ::-1], 0.0))
        sides.append((turned.astype(np.float32), rest.astype(np.float32)))
    (turned_a, rest_a), (turned_b, rest_b) = sides
    links = np.zeros((len(a), len(b)), bool)
    if axes.shape[1] <= LEAD:
        bounded_a, bounded_b = turned_a, turned_b
    else:
        bounded_a, bounded_b = (np.c_[t[:, :LEAD], r[:, LEAD]] for t, r in sides)
    stops = [s for s in range(LEAD + STEP, axes.shape[1], STEP)]
    for start in range(0, len(a), STRIP):
        reach = bounded_a[start : start + STRIP] @ bounded_b.T
        is_open = reach >= threshold - SLACK
        count = np.count_nonzero(is_open)
        if count > DENSE * is_open.size:
            rows, columns = start + np.flatnonzero(is_open.any(1)), np.flatnonzero(is_open.any(0))
            links[np.ix_(rows, columns)] = a[rows] @ b[columns].T >= threshold
            continue
        i, j = np.nonzero(is_open) if count else ((), ())
        for k in range(0, count, PAIRS):
            x, y = start + i[k : k + PAIRS], j[k : k + PAIRS]
            if stops:
                partial = reach[x - start, y] - rest_a[x, LEAD] * rest_b[y, LEAD]
            done = LEAD
            for stop in stops:
                partial += np.einsum("ij,ij->i", turned_a[x, done:stop], turned_b[y, done:stop])
                may = partial + rest_a[x, stop] * rest_b[y, stop] >= threshold - SLACK
                x, y, partial, done = x[may], y[may], partial[may], stop
            near = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            links[x[near], y[near]] = True
    return links


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and the columns of a Boolean matrix, the first row of their
    component (NONE without a link), by passing the least row to and fro."""

    def least(labels: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        out = np.full(len(matrix), NONE, np.int32)
        for i in range(0, len(matrix), STRIP):
            out[i : i + STRIP] = np.where(matrix[i : i + STRIP], labels, NONE).min(1, initial=NONE)
        return out

    across = np.ascontiguousarray(links.T)
    rows = np.where(links.any(1), np.arange(len(links), dtype=np.int32), NONE)
    while True:
        columns = least(rows, across)
        now = np.minimum(rows, least(columns, links))
        if (now == rows).all():
            return rows, columns
        rows = now


def compare_tiles(
    a: dict[str, np.ndarray], b: dict[str, np.ndarray], same: bool, axes: np.ndarray, threshold: float
) -> list[tuple[int, int | None, int | None]]:
    """(rep, links, edge to): link counts of rows and forest edges of a pair of tiles."""
    ra, rb = (unit(tile["v"].astype(np.float64)) for tile in (a, b))
    links = linked(ra, rb, axes, threshold)
    if same:
        np.fill_diagonal(links, False)
    if not links.any():
        return []
    ia, ib = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    if same:
        ia = ib = np.union1d(ia, ib)
    links = links[np.ix_(ia, ib)]
    out = []
    rep_a, rep_b = a["rep"][ia], b["rep"][ib]
    copies_a, copies_b = a["copies"][ia], b["copies"][ib]
    sides = [(rep_a, links, copies_b)] if same else [(rep_a, links, copies_b), (rep_b, links.T, copies_a)]
    for reps, matrix_, copies in sides:
        counts = [int(copies[row].sum()) if any_ else 0 for row, any_ in zip(matrix_, matrix_.any(1))]
        out += [(int(r), c, None) for r, c in zip(reps, counts) if c]
    rows, columns = forest(links)
    out += [(int(r), None, int(rep_a[f])) for r, f in zip(rep_a, rows) if f != NONE and r != rep_a[f]]
    out += [(int(r), None, int(rep_a[f])) for r, f in zip(rep_b, columns) if f != NONE and r != rep_a[f]]
    return out


def pack_tiles(distinct: DataFrame, axes: np.ndarray, scratch: Scratch) -> DataFrame:
    """(tile, low, high, rep, copies, v) with arrays of at most about TILE rows
    that are neighbours on the first axis."""
    weights = [float(x) for x in axes[:, 0]]
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    first = F.aggregate(
        F.zip_with("v", F.lit(weights), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x
    )
    placed = scratch.write(distinct.select("rep", "copies", "v", (first / norm).alias("place")), "placed")
    count = placed.count()
    n = max(1, -(-count // TILE))
    cuts = placed.approxQuantile("place", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    if cuts:
        splits = [-math.inf, *sorted(set(cuts)), math.inf]
        placed = Bucketizer(splits=splits, inputCol="place", outputCol="interval").transform(placed)
    else:
        placed = placed.withColumn("interval", F.lit(0.0))
    sizes = placed.groupBy("interval").agg(F.count("*").alias("rows"))
    # Equal places can fill an interval beyond a tile; such an interval becomes several tiles.
    parts = F.ceil(F.col("rows") / TILE)
    dealt = hot_join(placed, sizes, "interval", "rows", F.col("rep")).withColumn(
        "part", F.pmod(F.xxhash64("rep", F.lit(3)), parts).cast("int")
    )
    tiles = dealt.groupBy("interval", "part").agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.collect_list(F.struct("rep", "copies", "v")).alias("rows")
    )
    return scratch.write(
        tiles.select(F.concat_ws("/", "interval", "part").alias("tile"), "low", "high", "rows"), "tiles"
    )


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(a, b) for tiles near enough on the first axis, each pair once.  Only
    the tiles' names and intervals, one for about TILE rows, reach the driver."""
    known = sorted((r["low"], r["high"], r["tile"]) for r in tiles.select("tile", "low", "high").collect())
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    lows = np.array([low for low, _, _ in known])
    ends = [(i, int(np.searchsorted(lows, high + reach, "right"))) for i, (_, high, _) in enumerate(known)]
    spark = tiles.sparkSession
    names = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(known)], "place int, tile string")
    spans = spark.createDataFrame([(i, known[i][2], end - 1) for i, end in ends], "first int, a string, last int")
    pairs = spans.select("a", F.explode(F.sequence("first", "last")).alias("place"))
    return pairs.join(names.withColumnRenamed("tile", "b"), "place").select("a", "b")


def unpacked(rows: pa.Scalar) -> dict[str, np.ndarray]:
    flat = rows.values
    v = flat.field("v")
    return {
        "rep": flat.field("rep").to_numpy(zero_copy_only=False),
        "copies": flat.field("copies").to_numpy(zero_copy_only=False),
        "v": v.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1),
    }


def near_duplicates(
    frame: DataFrame, threshold: float, scratch: Scratch, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """`vec_id`, n_links, component_id and kept, one row for each row of `frame`."""
    spark = frame.sparkSession
    own = usable(frame, vec_id, vector)
    distinct = scratch.write(distinct_vectors(own, 1).withColumn("dim", F.size("v")), "distinct")
    found = None
    for (dim,) in distinct.select("dim").distinct().collect():
        rows = distinct.where(F.col("dim") == dim)
        axes = principal_axes(moments(rows, dim))
        tiles = pack_tiles(rows, axes, scratch)
        shared = spark.sparkContext.broadcast(axes)

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    a, b = (unpacked(batch.column(c)[i]) for c in ("rows_a", "rows_b"))
                    same = batch.column("a")[i].as_py() == batch.column("b")[i].as_py()
                    out = compare_tiles(a, b, same, shared.value, threshold)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[k] for r in out], type=pa.int64()) for k in range(3)], names=["rep", "links", "other"]
                    )

        side = lambda name: tiles.select(F.col("tile").alias(name), F.col("rows").alias(f"rows_{name}"))  # noqa: B023, E731
        met = tile_pairs(tiles, threshold).join(side("a"), "a").join(side("b"), "b")
        part = scratch.write(met.mapInArrow(compare, "rep long, links long, other long"), "compared")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "rep long, links long, other long")
    counts = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null"), scratch, "rep", "other")
    reps = distinct.select("v", "rep", "copies").join(counts, "rep", "left")
    reps = reps.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select(
        "v",
        "copies",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    reps = scratch.write(reps, "reps")
    apart = frame.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    # A vector that many rows share is a hot key.
    sound = hot_join(usable(apart, "id", "v"), reps, "v", "copies", F.col("id")).select("id", "n_links", "component_id")
    none = F.col("id").isNull() | ~usable_row("v")
    rest = apart.where(none).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return sound.unionByName(rest).select(
        F.col("id").alias(vec_id), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept")
    )
