"""Mixing sources to target weights along a time-varying curriculum.

All sizes together are shared among the sources by weight.  A source's target
stops at a multiple of its own size and the excess is reshared by weight until
no source is above: with sources in order of cap over weight, the common level
is the greatest of the levels that remain after capping each prefix.

A source's documents, in the order of a hash, form a stream that is read again
and again until its target is spent.  Each source has a weight schedule over
training time, a piecewise linear curve.  Its integral is the share of the
source's demand that is due by a time; inverting it turns a place in the
stream into a training position, and documents are range-sorted by position.

Running sums are taken within (source, hash bucket) and joined to the sums of
the buckets before, so a source with a third of all rows is spread over the
buckets.  Only DataFrame operations are used.

Defined results: a null text has size 0, and a document of size 0 is never
taken; a null source is a source, the last in order; repeated rows are read as
further documents, and an id that very many rows share makes its bucket as
large; rows with a null id are placed by their texts; without any words every
target is 0; an empty table gives no rows; texts are counted whole.  The
stream holds each row of the documents, with a null or repeated id too, as
often as it is read, with all its columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: A word, for sizes.
WORDS = r"[^\x20\x09-\x0D]+"
#: Hex digits of the hash that make a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3
#: The rows before the current one.
PRECEDING = (Window.unboundedPreceding, -1)
#: Weight over training time at evenly spaced knots, for the first, second and third weight of the round.
CURVES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def key_of(value: Column) -> Column:
    """A string that is null for no value; the null's comes last in order."""
    return F.coalesce(F.concat(F.lit("0"), value.cast("string")), F.lit("1"))


def size_of(text: Column) -> Column:
    """The words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(source_key, source_size, place, target), one row a source.  The windows
    run over sources, whose number is that of the groups, not of the rows."""
    totals = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    # Keys sort by code point; the key of the null source comes last.
    place = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    named = totals.withColumn("place", place).withColumn("weight", weight)
    named = named.withColumn("cap", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = order.rowsBetween(*PRECEDING)
    everything = Window.partitionBy()
    level = F.try_divide(
        F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    )
    levelled = named.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return levelled.select("source_key", "source_size", "place", target.alias("target"))


def due_time(share: Column, knots: Sequence[float]) -> Column:
    """The time in [0, 1] by which this share of the curve's integral is due."""
    n = len(knots) - 1
    areas = [(a + b) / 2 for a, b in zip(knots, knots[1:])]
    whole, reached, found = sum(areas), 0.0, F.lit(1.0)
    for i in reversed(range(n)):
        reached = sum(areas[:i])
        a, b = knots[i], knots[i + 1]
        rest = share * whole - reached
        if a == b:
            step = rest / a
        else:
            step = (F.sqrt(F.greatest(F.lit(a * a) + 2 * (b - a) * rest, F.lit(0.0))) - a) / (b - a)
        here = (F.lit(float(i)) + F.least(F.greatest(step, F.lit(0.0)), F.lit(1.0))) / n
        found = here if i == n - 1 else F.when(share * whole < reached + areas[i], here).otherwise(found)
    return found


def mix(
    docs: DataFrame,
    scratch: Scratch,
    weights: Sequence[int] = (5, 2, 1),
    cap: int = 3,
    curves: Sequence[Sequence[float]] = CURVES,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target,
    taken (words), copies (readings begun) and positions (one for each reading,
    in training time)."""
    sized = scratch.write(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            key_of(F.col(source)).alias("source_key"),
            size_of(F.col(text)).alias("size"),
            # Rows without an id are told apart by their texts, so that they do not share one bucket.
            F.md5(F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("\x00"), F.col(text)), F.lit(""))).alias("key"),
        ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)),
        "sized",
    )
    sources = scratch.write(source_targets(sized, weights, cap), "sources")
    sums = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    earlier = F.sum("words").over(Window.partitionBy("source_key").orderBy("bucket").rowsBetween(*PRECEDING))
    sums = sums.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(sources, "source_key").drop("words")
    inside = Window.partitionBy("source_key", "bucket").orderBy("key", "size").rowsBetween(*PRECEDING)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(sums, ["source_key", "bucket"]).withColumn("start", F.col("earlier") + F.col("inside"))
    budget = F.floor("target")
    readings = F.sequence(F.lit(0), F.lit(cap - 1))
    begin = lambda k: k * F.col("source_size") + F.col("start")
    begun = F.filter(readings, lambda k: (begin(k) < budget) & (F.col("size") > 0))
    words = F.aggregate(
        begun, F.lit(0).cast("long"), lambda s, k: s + F.least(budget - begin(k), F.col("size"))
    )
    share = lambda k: F.least((begin(k) + F.col("size") / 2) / F.col("target"), F.lit(1.0))

    def position(k: Column) -> Column:
        found = due_time(share(k), curves[-1])
        for i, curve in enumerate(curves[:-1]):
            found = F.when(F.col("place") % len(curves) == i, due_time(share(k), curve)).otherwise(found)
        return found

    return placed.select(
        "doc_id",
        F.when(F.col("source_key") != "1", F.substring("source_key", 2, 2**30)).alias("source"),
        "size",
        "source_size",
        "target",
        words.alias("taken"),
        F.size(begun).alias("copies"),
        F.transform(begun, position).alias("positions"),
    )


def documents_by_position(mixed: DataFrame) -> DataFrame:
    """The query's rows, range-sorted by each document's first position; what
    is never taken comes last."""
    first = F.try_element_at("positions", F.lit(1)).alias("position")
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", first)
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_stream(
    docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """The documents as they are read in training: one row a reading, in order
    of position.  Documents are not cut, so the last one of a source's stream
    may run over the target.  The mix tells rows apart by id, source and size
    only, so among rows that are alike in these the n-th takes the n-th readings."""
    alike = ["id_key", "source_key", "size"]
    keys = lambda i, s: [key_of(F.col(i)).alias("id_key"), key_of(F.col(s)).alias("source_key")]
    readings = mixed.groupBy(*keys("doc_id", "source"), "size").agg(F.array_sort(F.collect_list("positions")).alias("readings"))
    readings = readings.where(F.exists("readings", lambda x: F.size(x) > 0))
    nth = F.row_number().over(Window.partitionBy(*alike).orderBy("mark"))
    own = docs.select(
        F.struct("*").alias("row"), F.col(doc_id).alias("id"), *keys(doc_id, source), size_of(F.col(text)).alias("size"), F.xxhash64(text).alias("mark")
    )
    own = own.withColumn("nth", nth).join(readings, alike)
    own = own.select("row", "id", F.explode(F.element_at("readings", F.col("nth"))).alias("position"))
    return own.repartitionByRange("position", "id").sortWithinPartitions("position", "id").select("row.*")
