"""Named jobs over files, for the command line: `python -m loomdex JOB …`."""

from __future__ import annotations

import argparse
import json
import os
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..operators import caching, cells, corpus, grading, lexical
from ..sources import archives, tables
from ..streaming.progress import line
from . import evaluation
from .config import EMBEDDING_MODEL, embedding_runtime, sane_environment
from .evaluation import EvaluationConfig

JOBS: dict[str, Callable[[SparkSession, argparse.Namespace], str]] = {}
KS = (1, 3, 5, 10)
#: Questions of a sample run and of a comparison.
SAMPLE, SMALL_SAMPLE = 973, 50


def job(f: Callable[[SparkSession, argparse.Namespace], str]) -> Callable[[SparkSession, argparse.Namespace], str]:
    JOBS[f.__name__.replace("_", "-")] = f
    return f


def configured(args: argparse.Namespace, enhanced: bool = False, **given) -> EvaluationConfig:
    """From the environment and the arguments; those go first."""
    own = {"answer_model": args.answer_model, "call_partitions": args.call_partitions}
    if enhanced:
        own |= {"nprobe": args.nprobe, "rewrite_model": args.rewrite_model, "rerank_model": args.rerank_model}
    return EvaluationConfig.read(os.environ, enhanced, **own | given)


def run_files(spark: SparkSession, args: argparse.Namespace, config: EvaluationConfig) -> tables.RunFiles:
    return tables.RunFiles(spark, f"{args.out}/summary", args.job, config.shown())


def finish(spark: SparkSession, args: argparse.Namespace, sections: dict[str, DataFrame], config: EvaluationConfig) -> str:
    return run_files(spark, args, config).final({name: frame.first().asDict(recursive=True) for name, frame in sections.items()})


def tracked(spark: SparkSession, args: argparse.Namespace, config: EvaluationConfig, rows: DataFrame, run) -> DataFrame:
    """Runs the questions without a result in batches; after each the live
    results and the checkpoint tell how far the run is.  Returns the one-row
    result of all."""
    total, began, files = rows.count(), time.time(), run_files(spark, args, config)

    def progress(done: int, correct: int) -> None:
        elapsed = time.time() - began
        print(line(done, total, correct, elapsed))
        files.live({"total_questions": total, "processed_questions": done, "correct": correct, "accuracy": correct / max(done, 1), "elapsed_time": elapsed})
        state = {"dataset_name": "test", "total_questions": total, "processed_questions": done, "correct_count": correct, "total_count": done}
        tables.write_checkpoint(spark, args.out, args.job, **state, elapsed_time=elapsed, config=arguments(args))

    results = evaluation.resume(rows, f"{args.out}/results", run, batch=args.batch, progress=progress)
    elapsed = time.time() - began
    out = grading.stage_result(results, elapsed=elapsed)
    return out.withColumns({"dataset_name": F.lit("test"), "expected_questions": F.lit(total), "elapsed_time": F.lit(elapsed)})


@job
def chunk_corpus(spark: SparkSession, args: argparse.Namespace) -> str:
    """Passages of downloaded articles (JSON with `content`, or archives of text
    files), as a corpus that combine-corpora reads."""
    archived = args.articles.endswith((".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz"))
    articles = archives.read_articles(spark, *args.articles.split(",")) if archived else tables.read_chunks(spark, args.articles)
    passages = corpus.chunks(articles.where("content is not null"), "content", args.words, args.overlap)
    numbered = passages.withColumn("id", F.concat_ws("-", F.nullif("id", F.lit("")), F.col("chunk").cast("string"))).drop("chunk")
    numbered.write.mode("overwrite").parquet(f"{args.out}/chunks")
    return f"{articles.count()} articles, {spark.read.parquet(f'{args.out}/chunks').count()} passages"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A combined corpus as documents (doc_id, text, source)."""
    rows = corpus.documents(spark.read.parquet(path))
    keyed = rows.withColumn("key", corpus.identity(F.col("content"), [(c, F.col(c)) for c in corpus.METADATA]))
    numbered = corpus.with_ordinal(keyed.dropDuplicates(["key"]), "key", "doc_id")
    return numbered.select("doc_id", F.col("content").alias("text"), "source")


def asked(spark: SparkSession, args: argparse.Namespace, part: str) -> DataFrame:
    rows = corpus.split(tables.read_questions(spark, args.questions), args.dev, args.test)
    return rows.where(F.col("part") == part).drop("part")


def graded_stage(rows: DataFrame, path: str, name: str, total: int) -> DataFrame:
    """Writes the rows, and returns their one-row result with its times."""
    began = time.time()
    rows.write.mode("overwrite").parquet(path)
    elapsed = time.time() - began
    kept = rows.sparkSession.read.parquet(path)
    out = grading.stage_result(kept, elapsed=elapsed)
    return out.withColumns({"dataset_name": F.lit(name), "expected_questions": F.lit(total), "elapsed_time": F.lit(elapsed)})


@job
def combine_corpora(spark: SparkSession, args: argparse.Namespace) -> str:
    """Joins the registered corpora, name=path each, that are there."""
    paths = dict(x.split("=", 1) for x in args.corpora)
    there = {n: corpus.documents(tables.read_chunks(spark, p)) for n, p in paths.items() if tables.exists(spark, p)}
    combined = corpus.union(there, args.selected or None)
    tables.write_corpus(combined, f"{args.out}/corpus")
    registry = spark.createDataFrame([(n,) for n in paths], "corpus string")
    rows = corpus.corpus_summary(registry, spark.read.parquet(f"{args.out}/corpus")).orderBy("corpus").collect()
    return "\n".join(f"{r['corpus']}: {r['records'] if r['loaded'] else 'missing'}" for r in rows)


@job
def build_index(spark: SparkSession, args: argparse.Namespace) -> str:
    """Lexical and vector index of a combined corpus."""
    docs = read_corpus(spark, args.corpus)
    docs.write.mode("overwrite").parquet(f"{args.out}/documents")
    docs = spark.read.parquet(f"{args.out}/documents")
    lexical.SegmentedIndex.build(docs, f"{args.out}/lexical", lexical.K1, lexical.B)
    model = args.embedding_model or os.environ.get(EMBEDDING_MODEL, "").strip() or "hashed-embedding"
    meta = evaluation.build_vector_index(docs, f"{args.out}/vectors", model).first()
    if args.cells is not None:
        cells.CellIndex.build(evaluation.load_vector_index(spark, f"{args.out}/vectors"), f"{args.out}/cells", args.cells or None)
    said = [f"{meta['document_count']} documents, model {meta['embedding_model']}, sources {meta['sources']}"]
    if not args.skip_smoke:
        vectors = evaluation.load_vector_index(spark, f"{args.out}/vectors")
        hits = evaluation.smoke_retrieval(docs, vectors, model).collect()
        said += [f"{h['query']}: {h['rank']}. [{h['source']}] {h['preview']} ({h['score']:.4f})" for h in hits]
    return "\n".join(said)


@job
def add_documents(spark: SparkSession, args: argparse.Namespace) -> str:
    """Adds the documents of a combined corpus to an index; those it holds stay as they are."""
    folder = args.index
    known = spark.read.parquet(f"{folder}/documents")
    key = F.sha2(F.concat_ws("\x1f", F.col("source"), F.col("text")), 256)
    fresh = read_corpus(spark, args.corpus).join(known.select(key.alias("_k")), key == F.col("_k"), "left_anti")
    first = known.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0))).first()[0]
    fresh = corpus.with_ordinal(fresh, "doc_id", "_n").withColumn("doc_id", F.col("_n") + first).drop("_n")
    fresh.select("doc_id", "text", "source").write.mode("append").parquet(f"{folder}/documents")
    docs = spark.read.parquet(f"{folder}/documents")
    index = lexical.SegmentedIndex.open(spark, f"{folder}/lexical")
    if index is not None and index.documents == first:
        added = docs.where(F.col("doc_id") >= first)
        if not added.isEmpty():
            index.add(added).prune()
    else:  # one that was cut off before, or is of another kind
        lexical.stored_index(docs, f"{folder}/lexical")
    meta = evaluation.append_to_vector_index(docs, f"{folder}/vectors").first()
    if (known_cells := cells.CellIndex.open(spark, f"{folder}/cells")) is not None:
        known_cells.build(evaluation.load_vector_index(spark, f"{folder}/vectors"), f"{folder}/cells").prune()
    return f"{meta['document_count']} documents"


def opened_index(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame | cells.CellIndex, str]:
    """The documents, their vectors (in cells, if so many are to be probed) and
    the name of the model that made them."""
    docs = spark.read.parquet(f"{args.index}/documents")
    vectors = evaluation.load_vector_index(spark, f"{args.index}/vectors", args.embedding_model)
    recorded = evaluation.vector_metadata(spark, f"{args.index}/vectors").asDict()
    model = args.embedding_model or embedding_runtime(recorded, "hashed-embedding")["model"]
    found = cells.CellIndex.open(spark, f"{args.index}/cells") if args.nprobe else None
    return docs, found or vectors, model


def opened(spark: SparkSession, args: argparse.Namespace, questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents, their vectors and the questions' vectors, by the model of the index."""
    docs, vectors, model = opened_index(spark, args)
    own = evaluation.prepared(questions)
    return docs, vectors, own.select("query_id", models.embed_column("question", model).alias("q"))


def lexical_index(spark: SparkSession, args: argparse.Namespace) -> lexical.SegmentedIndex:
    """The index as built; built anew if it does not fit the documents."""
    return lexical.stored_index(spark.read.parquet(f"{args.index}/documents"), f"{args.index}/lexical")


@job
def evaluate_no_rag(spark: SparkSession, args: argparse.Namespace) -> str:
    config, rows = configured(args), asked(spark, args, "test")
    with config.sharing(spark) as shared:
        stage = tracked(spark, args, config, rows, lambda rest: evaluation.without_retrieval(rest, shared))
    return finish(spark, args, {"test_set_evaluation": stage}, config)


@job
def evaluate_naive_rag(spark: SparkSession, args: argparse.Namespace) -> str:
    """With the given k, or the best of several on the development questions;
    recall at several k comes from the same hits."""
    config, sections = configured(args), {}
    if args.top_k:
        config = replace(config, top_k=args.top_k)
    else:
        dev = asked(spark, args, "dev")
        docs, vectors, own = opened(spark, args, dev)
        hits = evaluation.dense_hits(evaluation.prepared(dev), vectors, own, max(KS), args.nprobe)
        with config.sharing(spark) as shared:
            best = grading.best_k(evaluation.grid_search(dev, hits, docs, list(KS), shared), "accuracy", "place")
            best.write.mode("overwrite").parquet(f"{args.out}/grid")
        sections["development_set_evaluation"] = best = spark.read.parquet(f"{args.out}/grid")
        config = replace(config, top_k=best.first()["k"])
    rows = asked(spark, args, "test")
    docs, vectors, own = opened(spark, args, rows)
    evaluation.dense_hits(evaluation.prepared(rows), vectors, own, max(KS), args.nprobe).write.mode("overwrite").parquet(f"{args.out}/hits")
    hits = spark.read.parquet(f"{args.out}/hits")
    near = hits.where(F.col("rank") <= config.top_k)
    with config.sharing(spark) as shared:
        sections["test_set_evaluation"] = tracked(spark, args, config, rows, lambda rest: evaluation.with_retrieval(rest, near, docs, shared))
    texts = hits.join(docs.select("doc_id", "text"), "doc_id")
    found = grading.recall_at_k(texts, evaluation.prepared(rows).select("query_id", "answer"), KS)
    found.write.mode("overwrite").parquet(f"{args.out}/recall")
    wide = spark.read.parquet(f"{args.out}/recall").agg(*(F.max(F.when(F.col("k") == k, F.col("recall"))).alias(f"recall_at_{k}") for k in KS))
    sections["retrieval_recall_at_k"] = wide
    return finish(spark, args, sections, config)


@job
def evaluate_hybrid_rag(spark: SparkSession, args: argparse.Namespace) -> str:
    """Hybrid retrieval with rewriting and reranking; a run that was cut off goes on."""
    config = configured(args, True, top_k=args.top_k or 5)
    rows, index = asked(spark, args, "test"), lexical_index(spark, args)
    docs, vectors, model = opened_index(spark, args)
    with config.sharing(spark) as shared:
        hits = evaluation.hybrid_retrieval(rows, docs, index, vectors, model, f"{args.out}/retrieval", shared)
        stage = tracked(spark, args, config, rows, lambda rest: evaluation.with_retrieval(rest, hits, docs, shared))
    return finish(spark, args, {"test_set_evaluation": stage}, config)


@job
def evaluate_sample(spark: SparkSession, args: argparse.Namespace) -> str:
    """Dense retrieval on a sample after the development questions."""
    config = configured(args, top_k=args.top_k or 3)
    rows = sampled(spark, args, SAMPLE)

    docs, vectors, own = opened(spark, args, rows)
    evaluation.dense_hits(evaluation.prepared(rows), vectors, own, config.top_k, args.nprobe).write.mode("overwrite").parquet(f"{args.out}/hits")
    hits = spark.read.parquet(f"{args.out}/hits")
    with config.sharing(spark) as shared:
        stage = tracked(spark, args, config, rows, lambda rest: evaluation.with_retrieval(rest, hits, docs, shared))
    return finish(spark, args, {"sample_evaluation": stage}, config)


def sampled(spark: SparkSession, args: argparse.Namespace, n: int) -> DataFrame:
    return corpus.sample(tables.read_questions(spark, args.questions), args.dev, args.test or n)


@job
def retrieve(spark: SparkSession, args: argparse.Namespace) -> str:
    """First of two stages: retrievals of a sample, kept in a cache."""
    began, config = time.time(), configured(args, top_k=args.top_k or 3)
    rows = sampled(spark, args, SAMPLE)
    docs, vectors, own = opened(spark, args, rows)
    hits = evaluation.dense_hits(evaluation.prepared(rows), vectors, own, config.top_k, args.nprobe)
    totals = evaluation.retrieve_to_cache(rows, hits, docs, cache_path(args), config).first().asDict()
    totals["elapsed_time"] = time.time() - began
    tables.put_text(spark, f"{args.out}/retrieval_results.json", json.dumps(totals))
    return run_files(spark, args, config).final({"retrieval": totals})


@job
def generate(spark: SparkSession, args: argparse.Namespace) -> str:
    """Second of two stages: answers of the sample from the cache."""
    config = configured(args, top_k=args.top_k or 3)
    rows = sampled(spark, args, SAMPLE)
    with config.sharing(spark) as shared:
        stage = tracked(spark, args, config, rows, lambda rest: evaluation.generate_from_cache(rest, cache_path(args), shared))
    return finish(spark, args, {"sample_evaluation": stage}, config)


def cache_path(args: argparse.Namespace) -> str:
    return args.cache or f"{args.out}/cache"


@job
def compare_sample(spark: SparkSession, args: argparse.Namespace) -> str:
    """A sample of questions without and with dense retrieval."""
    config = configured(args, top_k=args.top_k or 3)
    rows = sampled(spark, args, SMALL_SAMPLE)
    docs, vectors, own = opened(spark, args, rows)
    hits = evaluation.dense_hits(evaluation.prepared(rows), vectors, own, config.top_k, args.nprobe)
    with config.sharing(spark) as shared:
        plain = graded_stage(evaluation.without_retrieval(rows, shared), f"{args.out}/no_rag", "sample", rows.count())
        naive = graded_stage(evaluation.with_retrieval(rows, hits, docs, shared), f"{args.out}/naive_rag", "sample", rows.count())
    sections = {"no_rag_evaluation": plain, "naive_rag_evaluation": naive, "comparison": grading.compare(plain, naive)}
    return finish(spark, args, sections, config)


def interrupted_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The newest checkpoint of each job in a folder that did not end."""
    return caching.interrupted(tables.read_checkpoints(spark, folder, sorted(JOBS)))


@job
def resume(spark: SparkSession, args: argparse.Namespace) -> str:
    """Finds the jobs of a folder that were cut off and runs them again with
    the arguments they had; what they had done stays done."""
    said = []
    for row in interrupted_runs(spark, args.out).orderBy("script_name").collect():
        said.append(f"{row['script_name']}: {row['processed_questions']}/{row['total_questions']} of {row['timestamp']}")
        again = argparse.Namespace(**vars(args) | {k: json.loads(v) for k, v in row["config"].items()})
        said.append(run_job(spark, again))
    return "\n".join(said) or "no interrupted run"


def arguments(args: argparse.Namespace) -> dict[str, str]:
    """The arguments of a job as they are kept in its checkpoint."""
    return {k: json.dumps(v) for k, v in vars(args).items()}


def run_job(spark: SparkSession, args: argparse.Namespace) -> str:
    """Runs a job.  While a run of questions goes on, its checkpoint tells so; a
    failure is noted in it, and the end clears it.  A run that finds its
    checkpoint goes on with the results that are there; any other starts anew."""
    followed = args.questions is not None
    if followed and not tables.exists(spark, tables.checkpoint_path(args.out, args.job)):
        for part in ("results", "retrieval"):
            tables.remove(spark, f"{args.out}/{part}")
        tables.write_checkpoint(spark, args.out, args.job, total_questions=0, processed_questions=0, config=arguments(args))
    try:
        said = JOBS[args.job](spark, args)
    except BaseException as e:
        if followed:
            last = tables.read_checkpoints(spark, args.out, [args.job]).orderBy(F.desc("timestamp")).first()
            state = {k: v for k, v in last.asDict().items() if k not in ("file", "timestamp", "config")} if last else {}
            tables.write_checkpoint(spark, args.out, args.job, **state | {"error_message": repr(e), "config": arguments(args)})
        raise
    if followed:
        tables.clear_checkpoint(spark, args.out, args.job)
    return said


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="loomdex", description="Retrieval and evaluation jobs.")
    out.add_argument("job", choices=sorted(JOBS))
    out.add_argument("--out", required=True, help="folder of the results")
    out.add_argument("--corpora", nargs="*", default=[], metavar="NAME=PATH")
    out.add_argument("--selected", nargs="*", default=[])
    out.add_argument("--corpus", help="folder of a combined corpus")
    out.add_argument("--index", help="folder of an index")
    out.add_argument("--questions")
    out.add_argument("--dev", type=int, default=0)
    out.add_argument("--test", type=int, default=None)
    out.add_argument("--top-k", type=int, default=None)
    out.add_argument("--batch", type=int, default=200, help="questions between two checkpoints")
    out.add_argument("--call-partitions", type=int, default=1, help="tasks that share the rate of calls")
    out.add_argument("--cache", help="folder of cached retrievals")
    out.add_argument("--articles", help="JSON articles, or tar or zip archives of articles, to cut into passages")
    out.add_argument("--words", type=int, default=200)
    out.add_argument("--overlap", type=int, default=40)
    out.add_argument("--skip-smoke", action="store_true")
    out.add_argument("--cells", type=int, default=None, help="build an index of so many cells too; 0: as many as fit")
    out.add_argument("--nprobe", type=int, default=None, help="cells that a dense search reads")
    out.add_argument("--embedding-model", default=None)
    out.add_argument("--answer-model", default=None)
    out.add_argument("--rewrite-model", default=None)
    out.add_argument("--rerank-model", default=None)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    sane_environment()
    session = spark or SparkSession.builder.appName(f"loomdex {args.job}").getOrCreate()
    return run_job(session, args)
