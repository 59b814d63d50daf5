"""Cached retrievals, resumption and checkpoints as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import question_key

MISSING = "Missing retrieval cache"


def keyed(questions: DataFrame, question: str = "question") -> DataFrame:
    return questions.withColumn("question_key", question_key(question))


def hits(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Keyed questions that the cache holds."""
    return questions.join(cache.select("question_key"), "question_key", "left_semi")


def misses(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Keyed questions that are still to be retrieved."""
    return questions.join(cache.select("question_key"), "question_key", "left_anti")


def totals(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: all keyed questions, those that the cache holds and those that it lacks."""
    held = cache.select("question_key", F.lit(1).alias("_c"))
    rows = questions.join(held, "question_key", "left")
    return rows.agg(F.count("*").alias("total_questions"), F.count("_c").alias("cached_count"), F.count_if(F.col("_c").isNull()).alias("missing_count"))


def for_generation(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Keyed questions with their cached retrieval; one without gets an error.
    A cache has each question once."""
    held = cache.withColumn("_held", F.lit(True))
    joined = questions.join(held, "question_key", "left")
    return joined.withColumn("error", F.when(F.col("_held").isNull(), F.lit(MISSING))).drop("_held")


def remaining(questions: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Questions without a result yet."""
    return questions.join(done.select(key), key, "left_anti")


def latest_incomplete(checkpoints: DataFrame) -> DataFrame:
    """Of checkpoints (script_name, timestamp, processed_questions,
    total_questions) each script's newest that is not complete; the first name
    wins ties."""
    open_ones = checkpoints.where("processed_questions < total_questions")
    newest = F.max(F.struct("timestamp", (-F.col("checkpoint_id")).alias("_o"), "processed_questions", "total_questions")).alias("c")
    best = open_ones.groupBy("script_name").agg(newest)
    return best.select("script_name", (-F.col("c._o")).alias("checkpoint_id"), "c.timestamp", "c.processed_questions", "c.total_questions")


def interrupted(checkpoints: DataFrame) -> DataFrame:
    """Of checkpoints with `file`, each script's newest that is not complete; a
    run whose size is not known yet is not complete."""
    total = F.coalesce("total_questions", F.lit(0))
    open_ones = checkpoints.where((total == 0) | (F.coalesce("processed_questions", F.lit(0)) < total))
    newest = Window.partitionBy("script_name").orderBy(F.desc("timestamp"), "file")
    return open_ones.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def resumable(checkpoint_total: Column, processed: Column, total: Column) -> Column:
    """Whether a checkpoint fits a run of `total` questions and is incomplete."""
    return (processed < checkpoint_total) & (checkpoint_total == total)


def index_fingerprint(path: Column, count: Column, k1: Column, b: Column) -> Column:
    """The cache name of an index: 16 hex digits of its parameters' digest."""
    fields = F.to_json(F.struct(b.alias("b"), count.alias("document_count"), k1.alias("k1"), path.alias("path")))
    return F.substring(F.sha2(fields, 256), 1, 16)
