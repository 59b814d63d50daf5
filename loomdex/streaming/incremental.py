"""Evaluation as a stream: questions that arrive as files are graded in
micro-batches, each exactly once across restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def evaluate_stream(
    spark: SparkSession, inbox: str, schema: StructType, run: Callable[[DataFrame], DataFrame], results: str, state: str,
    files_per_batch: int = 16,
) -> StreamingQuery:
    """Runs `run` on every file of questions not seen yet and stops.  A batch
    is written to a folder of its own number, so one that is repeated after a
    failure overwrites itself."""

    def sink(batch: DataFrame, number: int) -> None:
        run(batch).write.mode("overwrite").parquet(f"{results}/batch={number}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)
    return source.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()


def windowed_accuracy(graded: DataFrame, ts: str, width: str, lateness: str, by: str) -> DataFrame:
    """(window start, by, total, correct) of a stream of graded answers, final
    once the watermark has passed."""
    rows = graded.withWatermark(ts, lateness).groupBy(F.window(ts, width), by)
    out = rows.agg(F.count("*").alias("total"), F.sum(F.col("is_correct").cast("long")).alias("correct"))
    return out.select(F.col("window.start").alias("start"), by, "total", "correct")
