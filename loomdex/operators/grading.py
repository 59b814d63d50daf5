"""Grading of answers and the figures of an evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import extract_answer, is_correct, is_error


def grade(answers: DataFrame, response: str = "response", key: str = "correct_answer", strict: bool = False) -> DataFrame:
    """Adds error, predicted_answer and is_correct.  A failed generation's text
    is parsed like any other; with `strict` it is never right."""
    rows = answers.withColumn("error", F.when(is_error(response), F.col(response)))
    rows = rows.withColumn("predicted_answer", extract_answer(response))
    right = is_correct("predicted_answer", key)
    return rows.withColumn("is_correct", right & F.col("error").isNull() if strict else right)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def stage_result(graded: DataFrame, by: Sequence[str] = (), elapsed: float | None = None) -> DataFrame:
    """total, correct and accuracy, over all rows or for each value of `by`."""
    rows = graded.groupBy(*by) if by else graded
    out = rows.agg(F.count("*").alias("total_questions"), F.count_if("is_correct").alias("correct"))
    out = out.withColumn("accuracy", F.round(ratio(F.col("correct"), F.col("total_questions")), 9))
    if elapsed is None:
        return out
    return out.withColumn("questions_per_second", ratio(F.col("total_questions"), F.lit(elapsed)))


def running(graded: DataFrame, ordinal: str, by: str, block: int = 100_000) -> DataFrame:
    """done, correct_so_far and accuracy_so_far after each row in order.  Sums
    run within blocks of ordinals and are moved by the sums of the blocks
    before, so a single long run is spread over tasks."""
    hit = F.col("is_correct").cast("long")
    rows = graded.withColumn("_b", F.floor(F.col(ordinal) / block))
    inside = Window.partitionBy(by, "_b").orderBy(ordinal)
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(by, "_b").agg(F.count("*").alias("_n"), F.sum(hit).alias("_c"))
    starts = starts.select(
        by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c")
    )
    rows = rows.withColumn("_i", F.row_number().over(inside)).withColumn("_h", F.sum(hit).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(starts, [by, "_b"])
    rows = rows.withColumn("done", F.col("_n") + F.col("_i")).withColumn("correct_so_far", F.col("_c") + F.col("_h"))
    rows = rows.withColumn("accuracy_so_far", F.round(ratio(F.col("correct_so_far"), F.col("done")), 9))
    return rows.drop("_b", "_n", "_c", "_i", "_h")


def every_nth(progress: DataFrame, n: int, by: str, error: Column | None = None) -> DataFrame:
    """Rows of a running result that are reported: each n-th, the last, and those with an error."""
    last = progress.groupBy(by).agg(F.max("done").alias("_last"))
    shown = (F.col("done") % n == 0) | F.col("_last").isNotNull()
    rows = progress.join(last.withColumnRenamed("_last", "done").withColumn("_last", F.lit(True)), [by, "done"], "left")
    return rows.where(shown if error is None else shown | error).select(*progress.columns)


def recall_at_k(hits: DataFrame, questions: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(k, hit_questions, questions, recall): of all questions (query_id,
    answer), those with a hit (query_id, rank, text) up to rank k whose text
    holds the answer in either case.  One retrieval serves every k."""
    asked = questions.where(F.coalesce("answer", F.lit("")) != "").select("query_id", F.lower("answer").alias("answer"))
    found = hits.join(asked, "query_id").where(F.contains(F.lower("text"), F.col("answer")))
    first = found.groupBy("query_id").agg(F.min("rank").alias("first"))
    total = questions.agg(F.count("*").alias("questions"))
    # Two one-row results meet the list of ks.
    counts = first.agg(*(F.count_if(F.col("first") <= k).alias(f"k{k}") for k in ks))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hit_questions")) for k in ks))).alias("r"))
    rows = rows.select("r.*").crossJoin(F.broadcast(total))
    return rows.withColumn("recall", F.round(ratio(F.col("hit_questions"), F.col("questions")), 9))


def best_k(scores: DataFrame, metric: str, place: str) -> DataFrame:
    """The row with the greatest metric; the first in listed order wins ties."""
    return scores.orderBy(F.desc(metric), place).limit(1)


def compare(base: DataFrame, other: DataFrame, accuracy: str = "accuracy") -> DataFrame:
    """One row with both accuracies, the improvement and its share in percent
    (0 where the base is 0) and a verdict."""
    rows = base.select(F.col(accuracy).alias("base_accuracy")).crossJoin(F.broadcast(other.select(F.col(accuracy).alias("other_accuracy"))))
    gain = F.col("other_accuracy") - F.col("base_accuracy")
    verdict = F.when(gain > 0, "improvement").when(gain == 0, "no change").otherwise("worse")
    return rows.select(
        "base_accuracy", "other_accuracy", F.round(gain, 9).alias("improvement"),
        F.round(ratio(gain, F.col("base_accuracy")) * 100, 6).alias("improvement_percent"), verdict.alias("verdict"),
    )


def stage_report(stages: DataFrame, title: str = "stage") -> DataFrame:
    """The text section of each stage result."""
    lines = F.concat_ws(
        "\n",
        F.concat(F.col(title), F.lit(":")),
        F.format_string("  total_questions: %d", F.col("total_questions")),
        F.format_string("  correct: %d", F.col("correct")),
        F.format_string("  accuracy: %.4f", F.col("accuracy")),
    )
    return stages.select(title, lines.alias("section"))
