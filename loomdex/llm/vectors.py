"""What the vector operators share: which vectors take part, one row for each
distinct vector, and matrices from Arrow columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable_row(vector: str) -> Column:
    """Whether a vector takes part: not null, no null, NaN or infinite
    component, and not zero (an empty vector is zero)."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(frame: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) of the rows whose id is not null and whose vector takes part."""
    there = frame.where(F.col(vec_id).isNotNull() & usable_row(vector))
    return there.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))


def distinct_vectors(vectors: DataFrame, smallest: int) -> DataFrame:
    """One row (v, rep, copies, ids) for each distinct vector; ids are its
    smallest ids, at most `smallest`, each once.  The rank limit is applied before the
    exchange too, so a vector that many rows share sends a few rows a task."""
    counts = vectors.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    if smallest == 1:
        return counts.withColumn("ids", F.array("rep"))
    first = Window.partitionBy("v").orderBy("id")
    few = vectors.dropDuplicates(["id", "v"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= smallest)
    ids = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return counts.join(ids, "v")


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows over their norms, scaled first so that no square leaves the range of a double."""
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))
