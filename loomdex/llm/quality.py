"""Compression classifier: one Zstandard dictionary is built from good labelled
text and one from bad.  A text is compressed in short blocks with either; the
difference of the two sizes over their sum, and nothing else, becomes a
calibrated chance of being good.

A dictionary is trained by the library; where there is too little text to
train on, the text itself, cut to its last DICTIONARY_BYTES, serves as one.
Work is linear in a text's length, and a text is read whole.

Defined results: a null or empty text gets the score that the calibration
gives to a difference of zero; with labels of one class only, every score is
the smoothed class share; repeated rows score alike; repeated ids give one
sampled text each; an empty table gives no rows; other columns, whatever their
names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, map_rows
from .learn import Isotonic, sample

#: Bounds of the labelled sample that the dictionaries and the calibration are fitted on.
SAMPLE_PER_CLASS = 3000
SAMPLE_LONGEST = 65_536
#: Bytes of a dictionary, and of a block that is compressed by itself.  In a long block a text
#: repeats itself more than the dictionary, which then says less.
DICTIONARY_BYTES = 112_640
BLOCK = 512
LEVEL = 3
#: Added to the sum of the sizes, so that a few bytes say little.
DAMPING = 20


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def build_dictionary(texts: list[str]) -> bytes:
    parts = [b for t in texts for b in blocks(t.encode())]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(parts)[-DICTIONARY_BYTES:] or b" " * 8


def own_lines(texts: dict[int, list[str]]) -> dict[int, list[str]]:
    """The texts of either class without lines that both classes have: such
    lines say nothing, but would favour the class that repeats them more."""
    lines = {value: {line for t in own for line in t.split("\n")} for value, own in texts.items()}
    both = lines[0] & lines[1]
    return {value: ["\n".join(x for x in t.split("\n") if x not in both) for t in own] for value, own in texts.items()}


def dictionaries(texts: dict[int, list[str]]) -> tuple[bytes, bytes]:
    """The dictionaries of good and of bad text."""
    own = own_lines(texts)
    return build_dictionary(own[1]), build_dictionary(own[0])


class Sizer:
    """Sizes of a text under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.tools = []
        for content in (good, bad):
            trained = content[:4] == b"\x37\xa4\x30\xec"
            kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=kind)
            dictionary.precompute_compress(level=LEVEL)
            self.tools.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            )

    def difference(self, text: str) -> float:
        """The difference of the sizes over their sum: above 0 if the good dictionary serves better."""
        parts = blocks(text.encode())
        good, bad = (sum(len(tool.compress(p)) for p in parts) for tool in self.tools)
        return (bad - good) / (bad + good + DAMPING)


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    calibration: Isotonic


def fit(docs: DataFrame, marks: DataFrame, per_class: int = SAMPLE_PER_CLASS, longest: int = SAMPLE_LONGEST) -> QualityModel:
    """From documents and their marks (doc_id, label).  The dictionaries come
    from the whole sample.  They are calibrated by differences that are free of
    a text's own label: those of either half of the sample under the
    dictionaries of the other half."""
    texts, counts = sample(docs, marks, per_class, longest)
    values, labels = [], []
    for half in (0, 1):
        sizer = Sizer(*dictionaries({value: texts[value][half::2] for value in (0, 1)}))
        for value in (0, 1):
            own = texts[value][1 - half :: 2]
            values += map(sizer.difference, own)
            labels += [value] * len(own)
    good, bad = dictionaries(texts)
    return QualityModel(good, bad, Isotonic(np.array(values), np.array(labels, dtype=float), counts))


def score(docs: DataFrame, model: QualityModel, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and the column score; only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        sizer = Sizer(own.good, own.bad)

        def run(texts: list[str]):
            found = own.calibration.scores(np.array([sizer.difference(t) for t in texts]))
            return ((float(s),) for s in found)

        return run

    return map_rows(docs, make, pa.schema([("score", pa.float64())]), "score double", keep, text)


def accepted(docs: DataFrame, model: QualityModel, threshold: float, text: str = "text") -> DataFrame:
    """The documents that score the threshold or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        sizer = Sizer(own.good, own.bad)
        return lambda texts: own.calibration.scores(np.array([sizer.difference(t) for t in texts])) >= threshold

    return filter_rows(docs, make, text)


def scored_documents(docs: DataFrame, model: QualityModel, fold: int, held_out: int, threshold: float) -> DataFrame:
    found = score(docs, model, ["doc_id"])
    return found.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
