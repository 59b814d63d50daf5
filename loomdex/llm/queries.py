"""The queries of this subpackage and their SQL, for `__spark_entry__`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, curriculum, embed_dedup, fill_middle, learn, license_scan, line_dedup, ngram_join, quality, secrets, spelling, sql, substring_dedup, toxicity
from .common import Scratch, table


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 50 = 0"), 5, Scratch(spark, "ann"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, learn.marks(labels, "quality", fold=4, held_out=2))
    return quality.scored_documents(docs, model, fold=4, held_out=2, threshold=0.7)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = license_scan.document_paths(table(spark, sf_dir, "documents"))
    return license_scan.scan(files, Scratch(spark, "license")).withColumnRenamed("id", "doc_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9, Scratch(spark, "embed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"), Scratch(spark, "lines"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngram_join.near_groups(docs, 4, ngram_join.Jaccard(85, 100), Scratch(spark, "ngram"))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.documents_by_position(curriculum.mix(table(spark, sf_dir, "documents"), Scratch(spark, "mix")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, learn.marks(labels, "toxic", fold=5, held_out=0), Scratch(spark, "toxicity"))
    return toxicity.scored_documents(docs, model, fold=5, held_out=0, threshold=0.5)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), Scratch(spark, "spelling"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"), 35, Scratch(spark, "substring"))


QUERIES = {
    "op1_permutation_index": op1_permutation_index,
    "op2_quality": op2_quality,
    "op3_license_scan": op3_license_scan,
    "op4_secret_scan": op4_secret_scan,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_curriculum_mix": op8_curriculum_mix,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_fill_middle": op11_fill_middle,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": sql.license_scan(
        license_scan.template_list(), license_scan.THRESHOLD, license_scan.MARKER, license_scan.TOKEN, license_scan.BLANK,
        license_scan.COMMENTS, license_scan.SPDX, license_scan.SPDX_NAME, license_scan.SPDX_TERM,
    ),
    "op5_embedding_near_dedup": sql.EMBEDDING_NEAR_DEDUP,
    "op6_line_dedup": sql.LINE_DEDUP,
    "op7_ngram_jaccard": sql.NGRAM_JACCARD,
    "op8_curriculum_mix": sql.CURRICULUM_MIX,
    "op11_fill_middle": sql.FILL_IN_MIDDLE,
    "op12_spelling_variants": sql.SPELLING_VARIANTS,
    "op13_substring_dedup": sql.SUBSTRING_DEDUP,
}
