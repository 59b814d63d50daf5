"""Evaluation jobs: without retrieval, with dense retrieval, and with hybrid
retrieval and reranking; in one go or as retrieval, cache and generation."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models, rates, text
from ..operators import caching, cells, dense, fusion, grading, lexical
from ..sources import cache, tables, versions
from .config import RERANKER_DEVICE, RERANKER_MODEL, REWRITE, CallSettings, ChatSettings, GateSettings


@dataclass(frozen=True)
class EvaluationConfig:
    """Parameters of a run.  A model is a name or what makes it; nothing that
    `shown` gives is a credential.  Unless set, a hybrid search fuses down to
    twice top_k and takes three times that of each list."""

    top_k: int = 3
    search_k: int | None = None
    fetch_k: int | None = None
    nprobe: int | None = None
    dense_weight: float = fusion.DENSE_WEIGHT
    rrf_k: int = fusion.RRF_K
    answer_model: str | models.Maker = "hashed-answers"
    rewrite_model: str | models.Maker | None = None
    rerank_model: str | models.Maker | None = None
    strict_errors: bool = True
    index_version: str = "1"
    chat: ChatSettings = ChatSettings()
    rewrite_chat: ChatSettings = ChatSettings()
    gate: GateSettings = GateSettings()
    calls: CallSettings = CallSettings(requests_per_minute=None)
    call_partitions: int = 1
    places: rates.Places | None = None

    @classmethod
    def read(cls, env: Mapping[str, str] = os.environ, enhanced: bool = False, **given) -> EvaluationConfig:
        """From environment settings, where arguments that are not None go first.
        With an endpoint set, answers (and rewrites, if asked for) come from it."""
        chat = ChatSettings.read(env=env)
        rewrite = ChatSettings.read(REWRITE, env, replace(chat, max_tokens=200))
        own: dict[str, object] = {"chat": chat, "rewrite_chat": rewrite, "gate": GateSettings.read(env)}
        own["calls"] = CallSettings.read(env, enhanced)
        if (make := chat.maker()) is not None:
            own["answer_model"] = make
        else:
            own["calls"] = replace(own["calls"], requests_per_minute=None)  # the stand-ins are no service
        if enhanced and (make := rewrite.maker()) is not None and own["gate"].enabled:
            own["rewrite_model"] = make
        if enhanced and (name := env.get(RERANKER_MODEL, "").strip()):
            own["rerank_model"] = models.maker("cross-encoder", model=name, device=env.get(RERANKER_DEVICE, "auto"))
        return cls(**own | {k: v for k, v in given.items() if v is not None})

    @property
    def searched(self) -> int:
        return self.search_k if self.search_k is not None else 2 * self.top_k

    @property
    def fetched(self) -> int:
        return self.fetch_k if self.fetch_k is not None else 3 * self.searched

    def call_options(self) -> dict[str, object]:
        return {
            "requests_per_minute": self.calls.requests_per_minute,
            "partitions": self.call_partitions,
            "in_flight": self.calls.in_flight,
            "attempts": self.calls.attempts,
            "places": self.places,
        }

    @contextmanager
    def sharing(self, spark: SparkSession) -> Iterator[EvaluationConfig]:
        """The parameters with one schedule of calls for all tasks of a run,
        rewriting and answering alike, if there is a limit.  The driver's host
        is the one that executors reach it by."""
        if not self.calls.requests_per_minute:
            yield self
            return
        host = spark.sparkContext.getConf().get("spark.driver.bindAddress", None) or spark.sparkContext.getConf().get("spark.driver.host", "127.0.0.1")
        with rates.SharedRate(models.rate_for(self.calls.requests_per_minute, 1), self.calls.in_flight, host) as shared:
            yield replace(self, places=shared.places())

    def shown(self) -> dict[str, object]:
        """What a run's results tell of its parameters."""
        name = lambda m: m if m is None or isinstance(m, str) else getattr(getattr(m, "func", m), "__name__", "model")
        return {
            "top_k": self.top_k, "search_k": self.searched, "fetch_k": self.fetched, "nprobe": self.nprobe, "dense_weight": self.dense_weight, "rrf_k": self.rrf_k,
            "answer_model": name(self.answer_model), "llm_provider": self.chat.provider, "llm_model": self.chat.model,
            "temperature": self.chat.temperature, "enable_thinking": self.chat.enable_thinking,
            "rewrite_model": name(self.rewrite_model), "rewrite_mode": self.gate.mode,
            **{f"reranker_{k}": v for k, v in models.pair_stats(self.rerank_model, self.top_k).items()},
            "requests_per_minute": self.calls.requests_per_minute, "max_concurrent": self.calls.in_flight, "strict_errors": self.strict_errors,
        }


def prepared(questions: DataFrame) -> DataFrame:
    """Questions with query_id and the letter of their key."""
    return questions.withColumn("query_id", F.col("ordinal")).withColumn(
        "correct_answer", text.correct_letter("answer_index", "answer")
    )


def rated(rows: DataFrame, config: EvaluationConfig) -> DataFrame:
    """Rows whose calls have a limited rate, dealt to call_partitions tasks: each
    has a share of the rate, unless the run has a schedule."""
    return rows.repartition(config.call_partitions) if config.calls.requests_per_minute else rows


def answered(prompts: DataFrame, config: EvaluationConfig) -> DataFrame:
    """Graded answers."""
    said = rated(prompts, config).withColumn("response", models.complete_column(F.col("prompt"), config.answer_model, **config.call_options()))
    return grading.grade(said, strict=config.strict_errors)


def without_retrieval(questions: DataFrame, config: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    rows = prepared(questions)
    return answered(rows.withColumn("prompt", text.build_prompt("question", "options")), config)


def contexts(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, contexts, scores): texts in rank order.  Texts are joined to
    the few hits after ranking."""
    rows = fusion.with_texts(hits, docs).groupBy("query_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text", "score")))
    return rows.agg(ordered.alias("hits")).select(
        "query_id", F.col("hits.text").alias("contexts"), F.col("hits.score").alias("scores")
    )


def dense_hits(questions: DataFrame, vectors: DataFrame | cells.CellIndex, query_vectors: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
    """The k nearest of each question; query_vectors is (query_id, q).  Of an
    index of cells, only the nprobe nearest are searched."""
    asked = query_vectors.join(questions.select("query_id"), "query_id", "left_semi")
    return vectors.search(asked, k, nprobe) if isinstance(vectors, cells.CellIndex) else dense.topk(vectors, asked, k)


def rewritten_queries(questions: DataFrame, config: EvaluationConfig) -> DataFrame:
    """(query_id, query): each question rewritten by the dictionaries and then,
    where the question as it was asked passes the gate, by the model.  It calls
    the model whenever it is evaluated, so it is to be written once a run."""
    asked = questions.select("query_id", "question", text.dictionary_rewrite("question").alias("query"))
    if not config.rewrite_model:
        return asked.select("query_id", "query")
    g = config.gate
    gate = text.needs_model_rewrite("question", g.enabled, g.mode, g.max_chars, g.max_words)
    said = models.rewrite_queries(rated(asked, config), "query", gate, config.rewrite_model, **config.call_options())
    return said.select("query_id", F.col("rewritten").alias("query"))


def hybrid_hits(
    queries: DataFrame, docs: DataFrame, index: lexical.Index, vectors: DataFrame | cells.CellIndex, query_vectors: DataFrame, config: EvaluationConfig
) -> DataFrame:
    """Both retrievals of rewritten queries (query_id, query) and of their
    vectors (query_id, q), fusion and reranking, down to top_k.  The prompt
    later takes the question as it was asked."""
    sparse = lexical.topk_padded(index, docs, queries, "query_id", "query", config.fetched)
    near = dense_hits(queries, vectors, query_vectors, config.fetched, config.nprobe)
    fused = fusion.hybrid(near, sparse, config.searched, config.dense_weight, config.rrf_k)
    if not config.rerank_model:
        return fused.where(F.col("rank") <= config.top_k)
    # Queries are joined to the hits, before these hold texts.
    pairs = fusion.with_texts(fused.join(queries.select("query_id", "query"), "query_id"), docs)
    scored = pairs.withColumn("rerank_score", models.score_pairs("query", "text", config.rerank_model))
    ranked = fusion.rerank(scored, config.top_k)
    return ranked.select("query_id", "doc_id", "score", F.col("new_rank").alias("rank"))


def hybrid_retrieval(
    questions: DataFrame, docs: DataFrame, index: lexical.Index, vectors: DataFrame | cells.CellIndex, model: str | models.Maker, path: str, config: EvaluationConfig
) -> DataFrame:
    """The hits of a whole run, kept at a path: queries are rewritten once and
    written, so both searches, their vectors and the reranking see the same
    text; hits are retrieved once, however many batches of answers follow.  What
    is there already is taken as it is, so a run that was cut off goes on."""
    spark = questions.sparkSession
    if not tables.exists(spark, f"{path}/queries/_SUCCESS"):
        rewritten_queries(prepared(questions), config).write.mode("overwrite").parquet(f"{path}/queries")
    queries = spark.read.parquet(f"{path}/queries")
    if not tables.exists(spark, f"{path}/hits/_SUCCESS"):
        # Vectors are made once, however many blocks of queries meet them.
        own = tables.kept(queries.select("query_id", models.embed_column("query", model).alias("q")))
        vectors = vectors if isinstance(vectors, cells.CellIndex) else tables.kept(vectors)
        hybrid_hits(queries, docs, index, vectors, own, config).write.mode("overwrite").parquet(f"{path}/hits")
    return spark.read.parquet(f"{path}/hits")


def with_retrieval(questions: DataFrame, hits: DataFrame, docs: DataFrame, config: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    rows = prepared(questions).join(contexts(hits, docs), "query_id", "left")
    prompt = text.build_prompt("question", "options", text.render_contexts("contexts"))
    return answered(rows.withColumn("prompt", prompt), config)


def retrieve_to_cache(questions: DataFrame, hits: DataFrame, docs: DataFrame, path: str, config: EvaluationConfig) -> DataFrame:
    """Adds the retrievals that the cache lacks, and returns one row of totals:
    all questions, those that now have a retrieval, and those that had one."""
    spark = questions.sparkSession
    rows = caching.keyed(prepared(questions))
    held = cache.read(spark, path, config.index_version, config.top_k)
    before = caching.totals(rows, held).first()
    missing = caching.misses(rows, held).dropDuplicates(["question_key"])
    found = missing.join(contexts(hits, docs), "query_id")
    if before["missing_count"]:
        cache.append(found, path, config.index_version, config.top_k)
    now = caching.hits(rows, cache.read(spark, path, config.index_version, config.top_k)).count()
    row = (before["total_questions"], now, before["cached_count"])
    return spark.createDataFrame([row], "total_questions long, processed_questions long, cached_count long")


def generate_from_cache(questions: DataFrame, path: str, config: EvaluationConfig) -> DataFrame:
    """Graded answers from cached retrievals; a question without one is an error."""
    held = cache.read(questions.sparkSession, path, config.index_version, config.top_k)
    rows = caching.for_generation(caching.keyed(prepared(questions)), held)
    prompt = text.build_prompt("question", "options", text.render_contexts("contexts"))
    found = answered(rows.where("error is null").drop("error").withColumn("prompt", prompt), config)
    lost = rows.where("error is not null").withColumn("is_correct", F.lit(False))
    return found.unionByName(lost, allowMissingColumns=True)


def resume(questions: DataFrame, results_path: str, run, key: str = "ordinal", batch: int | None = None, progress=None) -> DataFrame:
    """Runs `run` on the questions without a result, appends, and returns all
    results.  With `batch`, so many questions (by ordinal) are run and appended
    at a time, and `progress(done, correct)` is called after each."""
    spark = questions.sparkSession

    def rest() -> DataFrame:
        there = tables.exists(spark, results_path)
        return caching.remaining(questions, spark.read.parquet(results_path), key) if there else questions

    if batch is None:
        tables.append_results(run(rest()), results_path)
        return spark.read.parquet(results_path)
    bounds = rest().agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    if bounds["low"] is None and not tables.exists(spark, results_path):
        tables.append_results(run(questions), results_path)  # no questions: an empty table
    for low in range(bounds["low"], bounds["high"] + 1, batch) if bounds["low"] is not None else ():
        some = rest().where(F.col(key).between(low, low + batch - 1))
        if not some.isEmpty():
            tables.append_results(run(some), results_path)
        if progress is not None:
            so_far = grading.stage_result(spark.read.parquet(results_path)).first()
            progress(so_far["total_questions"], so_far["correct"])
    return spark.read.parquet(results_path)


def grid_search(questions: DataFrame, hits: DataFrame, docs: DataFrame, ks: list[int], config: EvaluationConfig = EvaluationConfig()) -> DataFrame:
    """(place, k, total_questions, correct, accuracy) for each k; the hits of
    the largest k serve all, and are searched once."""
    out, hits = None, tables.small(hits)
    for place, k in enumerate(ks):
        graded = with_retrieval(questions, hits.where(F.col("rank") <= k), docs, config)
        row = grading.stage_result(graded).withColumn("place", F.lit(place)).withColumn("k", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return out


def vector_rows(docs: DataFrame, model: str | models.Maker) -> DataFrame:
    return docs.select("doc_id", models.embed_column("text", model).alias("v"), "source")


def _vectors(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    return spark.read.parquet(*(f"{path}/{part}" for part in parts))


def _publish_vectors(spark: SparkSession, path: str, part: str, model: str, append: bool) -> DataFrame:
    """Makes vectors with a new part, or these alone, the next version, and
    returns its row of metadata.  Readers of the version before keep their files."""

    def body(before: dict | None) -> dict:
        parts = [*(before["parts"] if before and append else []), part]
        counts = _vectors(spark, path, parts).groupBy("source").agg(F.count("*").alias("n"))
        meta = counts.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("document_count"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("sources")
        ).withColumn("embedding_model", F.lit(model))
        name = versions.fresh_part(path, "metadata")
        meta.write.parquet(f"{path}/{name}")
        return {"parts": parts, "metadata": name}

    _, made = versions.publish(spark, path, body)
    versions.prune(spark, path, lambda b: {*b["parts"], b["metadata"]})
    return spark.read.parquet(f"{path}/{made['metadata']}")


def build_vector_index(docs: DataFrame, path: str, model: str = "hashed-embedding") -> DataFrame:
    """Writes (doc_id, v, source) and one row of metadata as the next version, and returns that row."""
    part = versions.fresh_part(path, "vectors")
    vector_rows(docs, model).write.parquet(f"{path}/{part}")
    return _publish_vectors(docs.sparkSession, path, part, model, append=False)


def append_to_vector_index(docs: DataFrame, path: str, model: str | None = None) -> DataFrame:
    """Adds documents to an index, or makes one if it is not there; those whose
    doc_id it holds already are left out.  Returns the new metadata."""
    spark = docs.sparkSession
    recorded = vector_metadata(spark, path)
    if recorded is None:
        return build_vector_index(docs, path, model or "hashed-embedding")
    known, part = load_vector_index(spark, path, model), versions.fresh_part(path, "vectors")
    fresh = docs.join(known.select("doc_id"), "doc_id", "left_anti")
    vector_rows(fresh, recorded["embedding_model"]).write.parquet(f"{path}/{part}")
    return _publish_vectors(spark, path, part, recorded["embedding_model"], append=True)


def vector_metadata(spark: SparkSession, path: str):
    """The row of metadata of an index; None if it is not there."""
    found = versions.current(spark, path)
    return spark.read.parquet(f"{path}/{found[1]['metadata']}").first() if found else None


def load_vector_index(spark: SparkSession, path: str, model: str | None = None, missing_ok: bool = False) -> DataFrame:
    """The vectors of the newest version; a model other than the recorded one is an error, and so is
    a missing index, unless `missing_ok` asks for no vectors then."""
    found = versions.current(spark, path)
    if found is None:
        if missing_ok:
            return spark.createDataFrame([], "doc_id long, v array<double>, source string")
        raise FileNotFoundError(f"no vector index at {path}")
    recorded = spark.read.parquet(f"{path}/{found[1]['metadata']}").first()
    if model is not None and model != recorded["embedding_model"]:
        raise ValueError(f"the index was built with {recorded['embedding_model']!r}, not {model!r}")
    return _vectors(spark, path, found[1]["parts"])


# Queries that show whether an index answers.
SMOKE_QUERIES = ("hypertension treatment", "diabetes diagnosis", "pneumonia antibiotics")


def smoke_retrieval(docs: DataFrame, vectors: DataFrame, model: str, k: int = 5) -> DataFrame:
    """(query, rank, source, preview, score) of the smoke queries."""
    spark = docs.sparkSession
    asked = spark.createDataFrame(list(enumerate(SMOKE_QUERIES)), "query_id long, query string")
    hits = dense.topk(vectors, asked.select("query_id", models.embed_column("query", model).alias("q")), k)
    rows = hits.join(docs.select("doc_id", "text", "source"), "doc_id").join(asked, "query_id")
    return rows.select("query", "rank", "source", text.question_preview("text", 60).alias("preview"), "score").orderBy("query_id", "rank")
