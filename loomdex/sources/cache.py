"""The cache of retrievals: a table bucketed by question, in versions.

Every run that retrieves adds a part; parts are bucketed and sorted by the
question's key, so a join with a cache of one part moves the questions only.
Of rows with one question, index version and k, the newest holds.  When there
are more than MOST_PARTS parts, or on `compact`, the newest rows of all become
one part of the next version; readers of the version before keep their files,
until the version after the next one.

Spark keeps bucketing with tables of its catalog only, so each part is made
known there by its own name, at its own path.  The catalog may forget it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import versions

BUCKETS, MOST_PARTS = 16, 4
KEY = ["question_key", "index_version", "top_k"]
SCHEMA = T.StructType(
    [
        T.StructField("question_key", T.StringType()),
        T.StructField("index_version", T.StringType()),
        T.StructField("top_k", T.IntegerType()),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("contexts", T.ArrayType(T.StringType())),
        T.StructField("written", T.LongType()),
    ]
)


def table_name(part: str) -> str:
    return "loomdex_" + part.replace("-", "_")


def write_part(rows: DataFrame, folder: str, buckets: int) -> str:
    """Rows as a new part, one file for each bucket that has any."""
    part = versions.fresh_part(folder, "cache")
    dealt = rows.select(*SCHEMA.names).repartition(buckets, "question_key")
    dealt.write.bucketBy(buckets, "question_key").sortBy("question_key").option("path", f"{folder}/{part}").format("parquet").saveAsTable(table_name(part))
    return part


def read_part(spark: SparkSession, folder: str, part: str, buckets: int) -> DataFrame:
    if not spark.catalog.tableExists(table_name(part)):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMA)
        location = f"{folder}/{part}".replace("'", "\\'")
        spark.sql(
            f"create table if not exists {table_name(part)} ({columns}) using parquet "
            f"clustered by (question_key) sorted by (question_key) into {buckets} buckets location '{location}'"
        )
    return spark.table(table_name(part))


def newest(rows: DataFrame) -> DataFrame:
    """One row for each key; contexts and scores move once, with the newest.
    Parts are dealt anew: a union of bucketed scans is not bucketed itself."""
    held = F.max_by(F.struct("scores", "contexts", "written"), F.struct("written", F.size("contexts"), F.xxhash64("contexts"))).alias("held")
    return rows.repartition("question_key").groupBy(*KEY).agg(held).select(*KEY, "held.*")


def parts(spark: SparkSession, folder: str) -> list[DataFrame]:
    found = versions.current(spark, folder)
    return [read_part(spark, folder, p, found[1]["buckets"]) for p in found[1]["parts"]] if found else []


def read(spark: SparkSession, folder: str, index_version: str, top_k: int) -> DataFrame:
    """Cached retrievals that fit the index and k; none if the cache is not there."""
    own = (F.col("index_version") == index_version) & (F.col("top_k") == top_k)
    held = [p.where(own) for p in parts(spark, folder)]
    if not held:
        return spark.createDataFrame([], SCHEMA).drop("written")
    if len(held) == 1:  # a part has each key once
        return held[0].drop("written")
    both = held[0]
    for p in held[1:]:
        both = both.unionByName(p)
    return newest(both).drop("written")


def append(rows: DataFrame, folder: str, index_version: str, top_k: int, buckets: int = BUCKETS) -> None:
    """Adds retrievals (question_key, scores, contexts), one for each question."""
    spark, found = rows.sparkSession, versions.current(rows.sparkSession, folder)
    buckets = found[1]["buckets"] if found else buckets
    named = rows.withColumns({"index_version": F.lit(index_version), "top_k": F.lit(top_k), "written": F.lit((found[0] if found else 0) + 1).cast("long")})
    part = write_part(newest(named.select(*SCHEMA.names)), folder, buckets)
    _, body = versions.publish(spark, folder, lambda before: {"buckets": buckets, "parts": [*(before["parts"] if before else []), part]})
    if len(body["parts"]) > MOST_PARTS:
        compact(spark, folder)


def compact(spark: SparkSession, folder: str) -> None:
    """Makes the newest rows of all parts one part; what another writer adds meanwhile stays beside it."""
    found = versions.current(spark, folder)
    if found is None or len(found[1]["parts"]) < 2:
        return
    held = found[1]["parts"]
    rows = parts(spark, folder)
    both = rows[0]
    for p in rows[1:]:
        both = both.unionByName(p)
    one = write_part(newest(both), folder, found[1]["buckets"])
    versions.publish(spark, folder, lambda before: before | {"parts": [one, *(p for p in before["parts"] if p not in held)]})
    for part in versions.prune(spark, folder, lambda body: set(body["parts"])):
        spark.sql(f"drop table if exists {table_name(part)}")
