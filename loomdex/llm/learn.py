"""Labelled samples and calibration for the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_limit


def marks(labels: DataFrame, label: str, fold: int, held_out: int) -> DataFrame:
    """(doc_id, label) of the labelled ids outside the held-out fold, which is
    the remainder of crc32(doc_id as text).  Null labels are left out; of
    several labels of an id the greatest holds."""
    kept = labels.where(F.crc32(F.col("doc_id").cast("string")) % fold != held_out).where(F.col(label).isNotNull())
    return kept.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))


def sample_rows(docs: DataFrame, marks: DataFrame, per_class: int, longest: int) -> tuple[DataFrame, dict[int, int]]:
    """(key, doc_id, label, text) of at most `per_class` documents of each class
    0 and 1, those with the smallest hashed ids, without texts of over `longest`
    characters; and the class counts of all marks.  Of several rows with one id
    the one with the smallest text counts.  Ids are chosen from the marks alone,
    and only their texts are exchanged."""
    spark = docs.sparkSession
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    counts = {value: counts.get(value, 0) for value in (0, 1)}
    keyed = marks.withColumn("key", F.xxhash64("doc_id"))
    chosen = []
    for value in (0, 1):
        share = min(1.0, (3 * per_class + 100) / max(counts[value], 1))  # enough for all the smallest keys
        below = keyed.where((F.col("label") == value) & (F.col("key") <= key_limit(share)))
        chosen += below.orderBy("key", "doc_id").limit(per_class).collect()
    ids = spark.createDataFrame(chosen, keyed.schema)
    fits = docs.where(F.length("text") <= longest).select("doc_id", "text")
    rows = fits.join(F.broadcast(ids), "doc_id").groupBy("key", "doc_id", "label").agg(F.min("text").alias("text"))
    return rows, counts


def sample(docs: DataFrame, marks: DataFrame, per_class: int, longest: int) -> tuple[dict[int, list[str]], dict[int, int]]:
    """The texts of sample_rows by class, in order of hashed ids, on the driver;
    the two bounds bound what reaches it."""
    found, counts = sample_rows(docs, marks, per_class, longest)
    rows = sorted(found.collect(), key=lambda r: (r["key"], r["doc_id"]))
    return {value: [r["text"] for r in rows if r["label"] == value] for value in (0, 1)}, counts


class Isotonic:
    """The chance of label 1 as a rising function of one number, fitted by
    pooling adjacent violators.  Classes weigh as in all labelled rows; each
    pool is drawn towards the share of label 1 by one row, and between the
    means of two pools the chance is interpolated."""

    def __init__(self, values: np.ndarray, labels: np.ndarray, counts: dict[int, int]):
        self.share = (counts[1] + 1.0) / (counts[0] + counts[1] + 2.0)
        n1 = int(labels.sum())
        n0 = len(labels) - n1
        self.at = self.chance = None
        if not n0 or not n1:
            return
        weights = np.where(labels == 1, counts[1] / n1, counts[0] / n0)
        weights = weights * (len(labels) / weights.sum())
        pools: list[list[float]] = []  # weight, weighted value and weighted label
        order = np.lexsort((-labels, values))
        for x, y, w in zip(values[order], labels[order], weights[order]):
            pools.append([w, w * x, w * y])
            while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        w, x, y = np.array(pools).T
        self.at, self.chance = x / w, (y + self.share) / (w + 1)
        self.chance = np.maximum.accumulate(self.chance)

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Without both classes, the smoothed share of label 1."""
        if self.at is None:
            return np.full(len(values), self.share)
        return np.interp(values, self.at, self.chance)


class Logistic:
    """Ridge logistic regression, fitted on a class-balanced sample and moved
    to the class shares of all labelled rows."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, counts: dict[int, int], ridge: float = 1e-3):
        self.shift = np.log((counts[1] + 1.0) / (counts[0] + 1.0))
        n1 = int(labels.sum())
        n0 = len(labels) - n1
        self.mean, self.scale, self.beta = 0.0, 1.0, None
        if not n0 or not n1:
            return
        self.mean = features.mean(0)
        self.scale = np.maximum(features.std(0), 1e-9)
        x = self._design(features)
        weight = np.where(labels == 1, 0.5 / n1, 0.5 / n0) * len(labels)
        beta = np.zeros(x.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(labels) * np.eye(x.shape[1])
            beta += np.linalg.solve(hess, x.T @ (weight * (labels - p)) - ridge * len(labels) * beta)
        self.beta = beta

    def _design(self, features: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(features)), (features - self.mean) / self.scale]

    def scores(self, features: np.ndarray) -> np.ndarray:
        """The chance of label 1; without both classes, their smoothed share."""
        logit = np.full(len(features), self.shift)
        if self.beta is not None:
            logit = logit + self._design(features) @ self.beta
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
