"""Answers of a stream committed in the order of their questions.

Answers arrive as they are given, not as they were asked.  Each run keeps what
came early until what is before it has come, and gives out rows in order, each
with the count and the accuracy so far.  State holds one row for each answer
that waits, so it is bounded by how far answers are out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

#: The store that state of this kind needs; a setting of the session.
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

COMMITTED = StructType(
    [
        StructField("run", StringType()),
        StructField("ordinal", LongType()),
        StructField("is_correct", BooleanType()),
        StructField("done", LongType()),
        StructField("correct_so_far", LongType()),
        StructField("accuracy_so_far", DoubleType()),
    ]
)
TOTALS = StructType([StructField("done", LongType()), StructField("correct", LongType())])
PLACE, ANSWER = StructType([StructField("ordinal", LongType())]), StructType([StructField("is_correct", BooleanType())])


class OrderedCommit(StatefulProcessor):
    """Of each run, the totals of what is committed, and the answers that wait.
    An answer that was committed or waits already is not taken again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", TOTALS)
        self.waiting = handle.getMapState("waiting", PLACE, ANSWER)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, correct = self.totals.get() if self.totals.exists() else (0, 0)
        for batch in rows:
            for ordinal, right in zip(batch["ordinal"], batch["is_correct"]):
                place = (int(ordinal),)
                if place[0] >= done and not self.waiting.containsKey(place):
                    self.waiting.updateValue(place, (bool(right),))
        out = []
        while self.waiting.containsKey((done,)):
            (right,) = self.waiting.getValue((done,))
            self.waiting.removeKey((done,))
            correct += int(right)
            out.append((key[0], done, bool(right), done + 1, correct, round(correct / (done + 1), 9)))
            done += 1
        self.totals.update((done, correct))
        yield pd.DataFrame(out, columns=COMMITTED.fieldNames())

    def close(self) -> None:
        pass


def ordered(answers: DataFrame) -> DataFrame:
    """A stream (run, ordinal, is_correct), ordinals of each run counting from
    0, with done, correct_so_far and accuracy_so_far, in the order of ordinals."""
    rows = answers.select(F.col("run").cast("string"), F.col("ordinal").cast("long"), F.coalesce("is_correct", F.lit(False)).alias("is_correct"))
    return rows.groupBy("run").transformWithStateInPandas(OrderedCommit(), outputStructType=COMMITTED, outputMode="Append", timeMode="None")


def commit_stream(answers: DataFrame, results: str, state: str) -> StreamingQuery:
    """Writes what is committed and stops when everything that is there has been
    read.  A batch has a folder of its own number, so one that is repeated after
    a failure overwrites itself, and a stream that is started again goes on."""
    answers.sparkSession.conf.set(STORE_KEY, STORE)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{results}/batch={number}")

    return ordered(answers).writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start()
