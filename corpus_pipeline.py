"""The corpus pipeline: quality, line dedup, near-duplicate documents, mixing
and tokens.  Each stage takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next stage's docs.

Defined results: a document with a null or empty text passes the first three
stages by the rules of their operators (its quality score is that of a
difference of zero) and is never read in training, as it has no words; rows
with a null id keep their lines and are no near duplicates of any; repeated
rows stay together through the first three stages and are read each; no
documents give no rows; other columns, whatever their names, pass unchanged up
to the last stage.  Texts of any length are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomdex.llm import bpe, curriculum, learn, line_dedup, ngram_join, quality
from loomdex.llm.common import Scratch, scratch_scope, table

#: Documents with a lower chance of being good are rejected.
LEAST_QUALITY = 0.5
#: Words of a shingle and the least Jaccard similarity of near duplicates.
SHINGLE_WORDS, SIMILARITY = 5, ngram_join.Jaccard(80, 100)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    marks = learn.marks(table(spark, sf_dir, "labels"), "quality", fold=4, held_out=2)
    return quality.accepted(docs, quality.fit(docs, marks), LEAST_QUALITY)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has, or nearly has."""
    return line_dedup.deduplicated(docs, Scratch(spark, "pipeline-lines"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    groups = ngram_join.near_groups(docs, SHINGLE_WORDS, SIMILARITY, Scratch(spark, "pipeline-ngram"))
    return ngram_join.representatives(docs, groups)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as they are read in training, a row for each reading."""
    return curriculum.training_stream(docs, curriculum.mix(docs, Scratch(spark, "pipeline-mix")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each reading."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "source"])


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's scratch tables go when it has been written, and its input
    when the next one is."""
    results = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_scope():
            docs = results.write(stage(spark, docs, sf_dir), name)
        results.drop_all_but(docs)
    return docs
