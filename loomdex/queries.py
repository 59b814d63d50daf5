"""The queries of the retrieval and evaluation operators over the driver's
tables, each with DuckDB SQL where SQL can express it.

Conventions: benchmark passages are the questions, documents the corpus, the
embedding with a question's id its query vector, conversation turns of the
assistant the model answers, and events the log of runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import dictionary, models, text
from .operators import caching, cells, corpus, dense, fusion, grading, lexical, rewriting
from .plans import evaluation
from .sources import cache, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RETRIEVED, FETCHED = 10, 30
#: The share of cells that is probed where not all are; on vectors without structure, fewer find too few.
PROBED = 0.7
KS = (1, 3, 5, 10)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Inputs by convention.


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as questions; each fifth one has no answer index."""
    own = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    index = F.when(F.col("query_id") % 5 == 4, -1).otherwise(F.col("query_id") % 5).cast("int")
    words = F.slice(F.split("question", " "), 1, 4)
    own = own.withColumn("answer_index", index).withColumn("answer", F.substring("question", 1, 60))
    return own.withColumn("options", F.when(F.col("query_id") % 7 != 6, words).otherwise(F.array().cast("array<string>")))


QUESTIONS = """questions as (
  select item_id as query_id, text as question, cast(case when item_id % 5 = 4 then -1 else item_id % 5 end as int) as answer_index,
    substring(text, 1, 60) as answer,
    case when item_id % 7 <> 6 then string_split(text, ' ')[1:4] else [] end as options
  from benchmark)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    own = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return own.join(ids, "query_id")


def index(spark: SparkSession, d: str) -> lexical.LexicalIndex:
    """The index of the documents, kept in the shared folder under a name made
    of their files, so that queries build it once."""
    docs, folder = read(spark, d, "documents"), tables.shared_folder(spark)
    if folder is None:
        return lexical.build_index(docs)
    return lexical.stored_index(docs, f"{folder}/loomdex-lexical-{tables.files_key(docs)}")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as model answers, with a stated letter in some."""
    own = read(spark, d, "conversations").where("role = 'assistant'")
    n = F.col("conv_id") * 7 + F.col("turn") * 3
    letter = F.chr(F.lit(65) + n % 5)
    stated = F.when(n % 4 == 0, F.concat(F.col("text"), F.lit(" Answer: "), letter))
    stated = stated.when(n % 4 == 1, F.concat(F.lit("**"), letter, F.lit("** "), F.col("text")))
    stated = stated.when(n % 9 == 2, F.lit("Error generating answer: Connection error."))
    key = F.chr(F.lit(65) + (F.col("conv_id") + F.col("turn")) % 5)
    return own.select("conv_id", "turn", stated.otherwise(F.col("text")).alias("response"), key.alias("correct_answer"))


ANSWERS = """answers as (
  select conv_id, turn, chr(cast(65 + (conv_id + turn) % 5 as int)) as correct_answer,
    case when (conv_id * 7 + turn * 3) % 4 = 0 then concat(text, ' Answer: ', chr(cast(65 + (conv_id * 7 + turn * 3) % 5 as int)))
      when (conv_id * 7 + turn * 3) % 4 = 1 then concat('**', chr(cast(65 + (conv_id * 7 + turn * 3) % 5 as int)), '** ', text)
      when (conv_id * 7 + turn * 3) % 9 = 2 then 'Error generating answer: Connection error.' else text end as response
  from conversations where role = 'assistant')"""

SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def letter_sql(column: str) -> str:
    last = lambda p: f"regexp_extract_all({column}, '{p}', 1)[-1]"
    return rf"""coalesce(
    upper(nullif(regexp_extract({column}, '(?i)answer{SPACE}*[:：]{SPACE}*([A-E])', 1), '')),
    upper(nullif(regexp_extract({column}, '(?i)correct{SPACE}*option{SPACE}*is{SPACE}*([A-E])', 1), '')),
    {last(r"\*\*([A-E])\*\*")}, {last(r"\(([A-E])\)")}, {last(r"\[([A-E])\]")},
    list_filter(regexp_extract_all({column}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-E]'))[-1])"""


GRADED = f"""{ANSWERS}, graded as (
  select *, {letter_sql("response")} as predicted_answer, coalesce({letter_sql("response")} = correct_answer, false) as is_correct,
    case when starts_with(response, 'Error generating answer:') then response end as error
  from answers)"""


def graded(spark: SparkSession, d: str) -> DataFrame:
    return grading.grade(answers(spark, d))


# Tokens and BM25.

TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
QUESTION_TEXTS = "select item_id as query_id, text as query from benchmark"


def bm25_sql(queries: str = QUESTION_TEXTS) -> str:
    """Scores of all documents that share a term with one of the queries (query_id, query)."""
    return f"""words as materialized (select doc_id, {TOKENS.format("coalesce(text, '')")} as w from documents),
lens as (select doc_id, len(w) as dl from words),
stats as (select count(*) as n, avg(dl) as avgdl from lens),
postings as materialized (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from words) group by all),
df as (select term, count(*) as df from postings group by term),
raw as materialized (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, stats),
mean as materialized (select avg(raw) as mean_idf from raw),
terms as (select term, df, case when raw < 0 then 0.25 * mean_idf else raw end as idf from raw, mean),
queried as materialized ({queries}),
asked as (select query_id, term, count(*) as qtf from (select query_id, unnest({TOKENS.format("query")}) as term from queried) group by all),
bm25 as (select query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score
  from asked join terms using (term) join postings using (term) join lens using (doc_id), stats group by all)"""


def padded_sql(k: int, queries: str = QUESTION_TEXTS) -> str:
    """The k best of each query, filled up with documents of score 0."""
    return f"""{bm25_sql(queries)}, padded as (
  select query_id, doc_id, sum(score) as score from (
    select * from bm25 union all
    select query_id, doc_id, 0.0 from queried, (select doc_id from documents order by doc_id limit {k})) group by all),
sparse as (select * from (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from padded) where rank <= {k})"""


BM25, PADDED = bm25_sql(), padded_sql(FETCHED)


@query(r"select doc_id, cast(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as int) as tokens, "
       r"cast(len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) as int) as distinct_tokens from documents")  # fmt: skip
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    words = text.tokenize("text")
    return read(spark, d, "documents").select(
        "doc_id", F.size(words).alias("tokens"), F.size(F.array_distinct(words)).alias("distinct_tokens")
    )


@query(f"with {BM25} select term, df, round(idf, 9) as idf from terms")
def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its document frequency and weight."""
    return index(spark, d).terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"with {BM25} select query_id, doc_id, score, rank from (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from bm25) where rank <= {RETRIEVED}")
def bm25_segments_topk(spark: SparkSession, d: str) -> DataFrame:
    """An index that grew: half of the documents, then the others in four parts,
    of which like ones are merged.  Every time it is built anew."""
    docs, folder = read(spark, d, "documents"), workspace(spark, "segments")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    grown = lexical.SegmentedIndex.build(docs.where(part < 4), folder, lexical.K1, lexical.B)
    for i in range(4, 8):
        grown = grown.add(docs.where(part == i))
    grown.prune()
    return lexical.topk(grown, questions(spark, d), "query_id", "question", RETRIEVED)


@query(f"with {BM25} select query_id, doc_id, score, rank from (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from bm25) where rank <= {RETRIEVED}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = questions(spark, d)
    return lexical.topk(index(spark, d), asked, "query_id", "question", RETRIEVED)


@query(f"with {PADDED} select query_id, doc_id, score, rank from sparse")
def bm25_topk_padded(spark: SparkSession, d: str) -> DataFrame:
    asked = questions(spark, d)
    return lexical.topk_padded(index(spark, d), read(spark, d, "documents"), asked, "query_id", "question", FETCHED)


# Dense retrieval and fusion.


def dense_sql(name: str, k: int, where: str = "true", best: str = "score desc", l2: bool = False) -> str:
    product = "list_sum(list_transform(range(1, len(v) + 1), lambda i: cast(v[i] as double) * cast(q[i] as double)))"
    cosine = f"case when nv > 0 and nq > 0 then {product} / (nv * nq) else 0.0 end"
    score = f"greatest(nv * nv + nq * nq - 2 * {product}, 0.0)" if l2 else cosine
    norm = lambda c: f"sqrt(list_sum(list_transform({c}, lambda x: cast(x as double) * cast(x as double))))"
    return f"""{name} as (select * from (
  select *, cast(row_number() over (partition by query_id order by {best}, doc_id) as int) as rank from (
    select query_id, doc_id, round({score}, 6) + 0.0 as score
    from (select vec_id as doc_id, embedding as v, {norm("embedding")} as nv from embeddings where {where}),
      (select item_id as query_id, embedding as q, {norm("embedding")} as nq from benchmark join embeddings on vec_id = item_id))) where rank <= {k})"""


@query(f"with {dense_sql('dense', RETRIEVED)} select query_id, doc_id, score, rank from dense")
def dense_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.topk(vectors(spark, d), query_vectors(spark, d), RETRIEVED)


@query(f"with {dense_sql('dense', RETRIEVED, 'label < 5')} select query_id, doc_id, score, rank from dense")
def dense_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.topk(vectors(spark, d), query_vectors(spark, d), RETRIEVED, where=F.col("label") < 5)


@query(f"with {dense_sql('dense', RETRIEVED, 'label < 5')} select query_id, doc_id, score, rank from dense")
def cells_every_topk(spark: SparkSession, d: str) -> DataFrame:
    """An index of cells, all of which are probed."""
    built = cells.CellIndex.build(vectors(spark, d), workspace(spark, "cells"))
    return built.search(query_vectors(spark, d), RETRIEVED, where=F.col("label") < 5)


@query()
def cells_probed_topk(spark: SparkSession, d: str) -> DataFrame:
    """The share PROBED of the cells of such an index."""
    built = cells.CellIndex.build(vectors(spark, d), workspace(spark, "cells"))
    return built.search(query_vectors(spark, d), RETRIEVED, nprobe=round(PROBED * len(built.sizes)))


@query(f"with {dense_sql('dense', RETRIEVED, best='score', l2=True)} select query_id, doc_id, score, rank from dense")
def l2_distance_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.topk(vectors(spark, d), query_vectors(spark, d), RETRIEVED, "l2")


def both_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked, docs = questions(spark, d), read(spark, d, "documents")
    near = dense.topk(vectors(spark, d), query_vectors(spark, d), FETCHED)
    return near, lexical.topk_padded(index(spark, d), docs, asked, "query_id", "question", FETCHED)


RRF = f"""{PADDED}, {dense_sql("dense", FETCHED)},
fused as (select query_id, doc_id, round(sum(part), 9) as score from (
  select query_id, doc_id, 0.5 / (60 + rank) as part from dense union all select query_id, doc_id, 0.5 / (60 + rank) from sparse) group by all),
hybrid as (select * from (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from fused) where rank <= {RETRIEVED})"""


@query(f"with {RRF} select query_id, doc_id, score from fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(*both_lists(spark, d))


def hybrid_rows(spark: SparkSession, d: str) -> DataFrame:
    return fusion.hybrid(*both_lists(spark, d), RETRIEVED)


@query(f"with {RRF} select query_id, doc_id, score, rank, md5(text) as text_md5 from hybrid join documents using (doc_id)")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.with_texts(hybrid_rows(spark, d), read(spark, d, "documents"))
    return rows.select("query_id", "doc_id", "score", "rank", F.md5("text").alias("text_md5"))


@query(f"with {dense_sql('dense', 2 * RETRIEVED)} select query_id, doc_id, rank, round(1.0 / rank, 9) as score from dense where rank <= {RETRIEVED}")
def dense_only_search(spark: SparkSession, d: str) -> DataFrame:
    return fusion.dense_only(dense.topk(vectors(spark, d), query_vectors(spark, d), 2 * RETRIEVED), RETRIEVED)


@query(f"with {RRF} select query_id, doc_id, cast(rank as int) as new_rank from hybrid where rank <= 5")
def rerank_fallback(spark: SparkSession, d: str) -> DataFrame:
    hits = hybrid_rows(spark, d).withColumn("rerank_score", F.lit(None).cast("double"))
    return fusion.rerank(hits, 5).select("query_id", "doc_id", "new_rank")


@query(f"""with {RRF}, scored as (
  select *, case when query_id % 3 = 0 then null when query_id % 3 = 1 and rank % 4 = 2 then null else (rank * 7) % 10 end as score_2 from hybrid),
whole as (select *, count(score_2) over (partition by query_id) = count(*) over (partition by query_id) as whole from scored)
select query_id, doc_id, new_rank from (
  select *, cast(row_number() over (partition by query_id order by case when whole then score_2 end desc nulls last, rank) as int) as new_rank from whole) where new_rank <= 5""")
def rerank_partial_failure(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all candidates of a query, of some and of none: only the first kind is reranked."""
    hits, q, rank = hybrid_rows(spark, d), F.col("query_id") % 3, F.col("rank")
    score = F.when((q == 2) | ((q == 1) & (rank % 4 != 2)), ((rank * 7) % 10).cast("double"))
    return fusion.rerank(hits.withColumn("rerank_score", score), 5).select("query_id", "doc_id", "new_rank")


@query(f"""with {RRF}, scored as (
  select h.query_id, h.doc_id, h.rank,
    len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{N}}_]+')), list_distinct(regexp_extract_all(lower(t.text), '[\\p{{L}}\\p{{N}}_]+')))) as shared
  from hybrid h join documents t using (doc_id) join benchmark b on b.item_id = h.query_id)
select query_id, doc_id, new_rank from (
  select *, cast(row_number() over (partition by query_id order by shared desc, rank) as int) as new_rank from scored) where new_rank <= 5""")
def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.with_texts(hybrid_rows(spark, d).join(questions(spark, d), "query_id"), read(spark, d, "documents"))
    words = lambda c: F.array_distinct(text.tokenize(c))
    shared = F.size(F.array_intersect(words("question"), words("text"))).cast("double")
    return fusion.rerank(rows.withColumn("rerank_score", shared), 5).select("query_id", "doc_id", "new_rank")


# Corpora.


@query("select doc_id, sha256(concat_ws(chr(31), coalesce(text, 'null'), 'lang', coalesce(lang, 'null'), 'n_chars', coalesce(cast(n_chars as varchar), 'null'), 'source', coalesce(source, 'null'))) as doc_key from documents")
def doc_identity(spark: SparkSession, d: str) -> DataFrame:
    key = corpus.identity(F.col("text"), [(c, F.col(c)) for c in ("source", "lang", "n_chars")])
    return read(spark, d, "documents").select("doc_id", key.alias("doc_key"))


@query("select sha256(concat_ws(chr(31), coalesce(text, 'null'), 'lang', coalesce(lang, 'null'))) as doc_key, max(doc_id) as doc_id, count(*) as copies from documents group by 1")
def doc_dedup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return corpus.last_wins(docs, corpus.identity(F.col("text"), [("lang", F.col("lang"))]), "doc_id")


@query(f"""with {dense_sql('dense', FETCHED)}, keyed as (select query_id, md5(text) as doc_key, rank from dense join documents using (doc_id))
select query_id, doc_key, cast(min(rank) as int) as rank from keyed group by all""")
def hits_keep_first(spark: SparkSession, d: str) -> DataFrame:
    hits = dense.topk(vectors(spark, d), query_vectors(spark, d), FETCHED)
    keyed = fusion.with_texts(hits, read(spark, d, "documents")).select("query_id", F.md5("text").alias("doc_key"), "rank")
    return corpus.first_hits(keyed, "query_id", "doc_key", "rank")


@query("select coalesce(nullif(source, ''), 'unknown') as source, count(*) as documents from documents group by 1")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.source_counts(read(spark, d, "documents"))


def corpora(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "documents": read(spark, d, "documents").select(F.col("text").alias("content"), F.col("doc_id").cast("string").alias("id"), "source"),
        "pages": read(spark, d, "pages").select(F.col("html").alias("content"), F.col("page_id").cast("string").alias("id"), F.col("url").alias("source")),
        "benchmark": read(spark, d, "benchmark").select(F.col("text").alias("content"), F.col("item_id").cast("string").alias("id")),
    }


CORPORA = """select text as content, cast(doc_id as varchar) as id, source, 'documents' as corpus from documents
  union all select html, cast(page_id as varchar), url, 'pages' from pages
  union all select text, cast(item_id as varchar), null, 'benchmark' from benchmark"""


@query(f"select corpus, id, coalesce(source, '') as source, md5(content) as content_md5, '' as title from ({CORPORA})")
def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    named = corpus.union({n: corpus.documents(f) for n, f in corpora(spark, d).items()})
    return named.select("corpus", "id", "source", F.md5("content").alias("content_md5"), "title")


@query(f"""with counts as (select corpus, count(*) as n from ({CORPORA}) where corpus <> 'benchmark' group by corpus)
select r.corpus, coalesce(n, 0) as records, n is not null as loaded
from (values ('documents'), ('pages'), ('benchmark'), ('absent')) r(corpus) left join counts using (corpus)""")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    registry = spark.createDataFrame([("documents",), ("pages",), ("benchmark",), ("absent",)], "corpus string")
    return corpus.corpus_summary(registry, corpus.union(corpora(spark, d), ["documents", "pages"]))


ORDINALS = "ordered as (select item_id, row_number() over (order by item_id) - 1 as ordinal from benchmark)"


@query(f"with {ORDINALS} select item_id, ordinal, case when ordinal < 12 then 'dev' else 'test' end as part from ordered where ordinal < 36")
def split_dev_test(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.with_ordinal(read(spark, d, "benchmark").select("item_id"), "item_id")
    return corpus.split(rows, 12, 24)


@query(f"with {ORDINALS} select item_id, ordinal, case when ordinal < 12 then 'dev' else 'test' end as part from ordered")
def split_dev_rest(spark: SparkSession, d: str) -> DataFrame:
    return corpus.split(corpus.with_ordinal(read(spark, d, "benchmark").select("item_id"), "item_id"), 12)


@query(f"with {ORDINALS} select item_id, ordinal from ordered where ordinal >= 12 and ordinal < 22")
def sample_slice(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sample(corpus.with_ordinal(read(spark, d, "benchmark").select("item_id"), "item_id"), 12, 10)


# Questions, prompts and answers.


@query(f"with {ANSWERS} select conv_id, turn, {letter_sql('response')} as predicted_answer from answers")
def extract_answer(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("conv_id", "turn", text.extract_answer("response").alias("predicted_answer"))


LETTER = "case when answer_index >= 0 then chr(65 + answer_index) else replace(upper(answer), 'ẞ', 'SS') end"


@query(f"with {QUESTIONS} select query_id, {LETTER} as letter from questions")
def correct_answer_letter(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("query_id", text.correct_letter("answer_index", "answer").alias("letter"))


OPTIONS = r"""case when len(options) > 0 then array_to_string(list_transform(range(1, len(options) + 1), lambda i: concat(chr(cast(64 + i as int)), '. ', options[i])), chr(10))
  else concat_ws(chr(10), 'A. Not provided', 'B. Not provided', 'C. Not provided', 'D. Not provided') end"""


@query(f"with {QUESTIONS} select query_id, {OPTIONS} as shown from questions")
def format_options(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("query_id", text.format_options("options").alias("shown"))


def contexts_sql(name: str, k: int) -> str:
    return f"""{name} as (
  select query_id, string_agg(concat('[', cast(rank as varchar), '] ', text), chr(10) || chr(10) order by rank) as context
  from hybrid join documents using (doc_id) where rank <= {k} group by query_id)"""


CONTEXTS = f"{RRF}, {contexts_sql('contexts', 3)}"


def contexts(spark: SparkSession, d: str) -> DataFrame:
    hits = hybrid_rows(spark, d).where("rank <= 3")
    return evaluation.contexts(hits, read(spark, d, "documents"))


@query(f"with {CONTEXTS} select query_id, md5(context) as context_md5, cast(length(context) as int) as chars from contexts")
def context_render(spark: SparkSession, d: str) -> DataFrame:
    shown = text.render_contexts("contexts")
    return contexts(spark, d).select("query_id", F.md5(shown).alias("context_md5"), F.length(shown).alias("chars"))


def prompt_sql(context: str | None) -> str:
    tail = f"""concat(chr(10), chr(10), 'Question: ', question, chr(10), chr(10), 'Options:', chr(10), {OPTIONS}, chr(10), chr(10),
    'Provide only the final answer in the following format:', chr(10), 'Answer: [A/B/C/D/E]', chr(10), chr(10), 'Your response:')"""
    plain = f"concat('{text.ROLE}', chr(10), '{text.WITHOUT_CONTEXT}', {tail})"
    if context is None:
        return plain
    held = f"concat('{text.ROLE}', chr(10), '{text.WITH_CONTEXT}', chr(10), chr(10), 'Context:', chr(10), {context}, {tail})"
    return f"case when coalesce({context}, '') <> '' then {held} else {plain} end"


@query(f"with {CONTEXTS}, {QUESTIONS} select query_id, md5({prompt_sql('context')}) as prompt_md5 from questions left join contexts using (query_id)")
def build_prompt_rag(spark: SparkSession, d: str) -> DataFrame:
    rows = questions(spark, d).join(contexts(spark, d), "query_id", "left")
    prompt = text.build_prompt("question", "options", text.render_contexts("contexts"))
    return rows.select("query_id", F.md5(prompt).alias("prompt_md5"))


@query(f"with {QUESTIONS} select query_id, {prompt_sql(None)} as prompt from questions")
def build_prompt_norag(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("query_id", text.build_prompt("question", "options").alias("prompt"))


# Query rewriting.

#: Queries that hold entries of every dictionary, beside the turns of the conversations.
CASES = [
    "HTN and PE", "Patient admitted with MI", "given copd", "Heart attack with chest pain and nausea", "患者心梗 and 高血压",
    "慢阻肺 糖尿病 肺炎", "", "   ", "shortness of breath after stroke", "a b c d e f g h i j k l m n o p q r s t u v w x y z",
    "word " * 40, "what causes low blood pressure?", "CKD (stage 3), DM-2", "x_mi_y amid",
]


def asked_queries(spark: SparkSession, d: str) -> DataFrame:
    cases = spark.createDataFrame([(-1 - i, 0, c) for i, c in enumerate(CASES)], "conv_id long, turn long, query string")
    turns = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    return turns.unionByName(cases)


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ASKED = (
    "asked as (select conv_id, turn, text as query from conversations where role = 'user' union all select * from (values "
    + ", ".join(f"({-1 - i}, 0, {sql_text(c)})" for i, c in enumerate(CASES))
    + "))"
)


def chained_sql(column: str, pairs: list[tuple[str, str]], lowered: bool, original: str | None = None) -> str:
    """Nested replacements; with `original`, an entry counts only if that holds it."""
    out = f"lower({column})" if lowered else column
    for k, v in pairs:
        to = sql_text(v)
        find = sql_text(k) if original is None else f"case when contains({original}, {sql_text(k)}) then {sql_text(k)} else chr(1) end"
        out = f"replace({out}, {find}, {to})"
    return out


FULL = [(k, f"{v} ({k})") for k, v in dictionary.ABBREVIATIONS]
FULL_CHINESE = [(k, f"{v} ({k})") for k, v in dictionary.CHINESE_TERMS]
ABBREVIATED = chained_sql("query", FULL, True, "lower(query)")
SYNONYMOUS = chained_sql("query", dictionary.SYNONYMS, True)


@query(f"with {ASKED} select conv_id, turn, {ABBREVIATED} as rewritten from asked")
def expand_abbreviations(spark: SparkSession, d: str) -> DataFrame:
    return asked_queries(spark, d).select("conv_id", "turn", text.expand_abbreviations("query").alias("rewritten"))


@query(f"with {ASKED} select conv_id, turn, {SYNONYMOUS} as rewritten from asked")
def replace_synonyms(spark: SparkSession, d: str) -> DataFrame:
    return asked_queries(spark, d).select("conv_id", "turn", text.replace_synonyms("query").alias("rewritten"))


@query(f"with {ASKED} select conv_id, turn, {chained_sql('query', FULL_CHINESE, False)} as rewritten from asked")
def expand_chinese_terms(spark: SparkSession, d: str) -> DataFrame:
    return asked_queries(spark, d).select("conv_id", "turn", text.expand_chinese_terms("query").alias("rewritten"))


@query(f"""with {ASKED}, one as (select conv_id, turn, {ABBREVIATED} as query from asked), two as (select conv_id, turn, {SYNONYMOUS} as query from one)
select conv_id, turn, {chained_sql('query', FULL_CHINESE, False)} as rewritten from two""")
def dictionary_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return asked_queries(spark, d).select("conv_id", "turn", text.dictionary_rewrite("query").alias("rewritten"))


@query(rf"""with {ASKED}, known as (select distinct term, 'known ' || term as replacement from (select unnest({TOKENS.format("text")}) as term from benchmark)),
pieces as (select conv_id, turn, regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') as p from asked),
placed as (select conv_id, turn, unnest(range(1, len(p) + 1)) as i, unnest(p) as piece from pieces)
select a.conv_id, a.turn, coalesce(string_agg(coalesce(k.replacement, piece), '' order by i) filter (piece is not null), '') as rewritten
from asked a left join placed using (conv_id, turn) left join known k on k.term = piece group by all""")
def rewrite_by_table(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary of all words of the passages, joined to the runs of words of each turn."""
    terms = read(spark, d, "benchmark").select(F.explode(text.tokenize("text")).alias("entry")).distinct()
    turns = asked_queries(spark, d).withColumn("query_id", F.concat_ws(":", "conv_id", "turn"))
    found = rewriting.rewrite(turns, terms.withColumn("replacement", F.concat(F.lit("known "), F.col("entry"))))
    return found.select("conv_id", "turn", "rewritten")


@query(rf"""with {ASKED}, flat as (select conv_id, turn, regexp_replace(query, '^{SPACE}+|{SPACE}+$', '', 'g') as q from asked)
select conv_id, turn, case when q = '' then false when regexp_matches(q, '[\x{{4e00}}-\x{{9fff}}]') then true
  when regexp_matches(lower(q), '(^|[^\p{{L}}\p{{N}}_])({"|".join(k for k, _ in dictionary.ABBREVIATIONS)})([^\p{{L}}\p{{N}}_]|$)') then true
  when length(q) > 160 then false when len(regexp_split_to_array(q, '{SPACE}+')) > 24 then false else true end as needed from flat""")
def rewrite_gate(spark: SparkSession, d: str) -> DataFrame:
    return asked_queries(spark, d).select("conv_id", "turn", text.needs_model_rewrite("query").alias("needed"))


@query(rf"""with flat as (select item_id, trim(regexp_replace(coalesce(text, ''), '{SPACE}+', ' ', 'g')) as t from benchmark)
select item_id, case when length(t) <= 80 then t else concat(rtrim(substring(t, 1, 77)), '...') end as preview from flat""")
def question_preview(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", text.question_preview("text").alias("preview"))


# Caches and resumption.


@query("select item_id, md5(text) as question_key from benchmark")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", text.question_key("text").alias("question_key"))


def cached(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Keyed questions, and a cache of the even ones."""
    rows = caching.keyed(questions(spark, d))
    held = rows.where("query_id % 2 = 0").select("question_key", F.array(F.col("answer")).alias("contexts"))
    return rows, held.dropDuplicates(["question_key"])


@query("select item_id as query_id from benchmark where md5(text) in (select md5(text) from benchmark where item_id % 2 = 0)")
def cache_hit_semi(spark: SparkSession, d: str) -> DataFrame:
    return caching.hits(*cached(spark, d)).select("query_id")


@query("select item_id as query_id from benchmark where md5(text) not in (select md5(text) from benchmark where item_id % 2 = 0)")
def cache_miss_anti(spark: SparkSession, d: str) -> DataFrame:
    return caching.misses(*cached(spark, d)).select("query_id")


@query(f"""select b.item_id as query_id, case when c.k is not null then substring(b.text, 1, 60) end as context,
  case when c.k is null then '{caching.MISSING}' end as error
from benchmark b left join (select distinct md5(text) as k from benchmark where item_id % 2 = 0) c on md5(b.text) = c.k""")
def generation_cache_left(spark: SparkSession, d: str) -> DataFrame:
    rows = caching.for_generation(*cached(spark, d))
    return rows.select("query_id", F.try_element_at("contexts", F.lit(1)).alias("context"), "error")


@query("select event_id, user_id from events where user_id not in (select user_id from events where event_type = 'purchase' and event_id % 7 = 0 and user_id is not null)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """Events of users for whom a seventh of the purchases, the runs that are done, has none."""
    log = read(spark, d, "events").select("event_id", "user_id", "event_type")
    done = log.where("event_type = 'purchase' and event_id % 7 = 0")
    return caching.remaining(log, done, "user_id").select("event_id", "user_id")


CHECKPOINTS = """checkpoints as (select event_type as script_name, strftime(ts, '%Y-%m-%dT%H:%M:%S') as timestamp, event_id as checkpoint_id,
  event_id % 100 as processed_questions, event_id % 7 * 20 as total_questions from events)"""


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        F.col("event_type").alias("script_name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.col("event_id").alias("checkpoint_id"), (F.col("event_id") % 100).alias("processed_questions"),
        (F.col("event_id") % 7 * 20).alias("total_questions"),
    )


@query(f"""with {CHECKPOINTS} select script_name, checkpoint_id, timestamp, processed_questions, total_questions from (
  select *, row_number() over (partition by script_name order by timestamp desc, checkpoint_id) as n from checkpoints
  where processed_questions < total_questions) where n = 1""")
def latest_incomplete(spark: SparkSession, d: str) -> DataFrame:
    return caching.latest_incomplete(checkpoints(spark, d))


@query(f"with {CHECKPOINTS} select checkpoint_id, processed_questions < total_questions and total_questions = 60 as fits from checkpoints")
def checkpoint_fits(spark: SparkSession, d: str) -> DataFrame:
    rows = checkpoints(spark, d)
    fits = caching.resumable(F.col("total_questions"), F.col("processed_questions"), F.lit(60))
    return rows.select("checkpoint_id", fits.alias("fits"))


@query("""select source, substring(sha256(concat('{"b":0.75,"document_count":', cast(count(*) as varchar), ',"k1":1.5,"path":"', source, '"}')), 1, 16) as fingerprint
from documents where source is not null group by source""")
def index_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    counts = read(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    print_ = caching.index_fingerprint(F.col("source"), F.col("n"), F.lit(lexical.K1), F.lit(lexical.B))
    return counts.select("source", print_.alias("fingerprint"))


# Figures of an evaluation.


RECALL = f"""{QUESTIONS}, {RRF}, firsts as (
  select h.query_id, min(rank) as first from hybrid h join documents d using (doc_id) join questions q using (query_id)
  where answer <> '' and contains(lower(d.text), lower(answer)) group by h.query_id),
recalls as (select k, cast((select count(*) from firsts where first <= k) as bigint) as hit_questions, (select count(*) from questions) as questions
  from (values {", ".join(f"({k})" for k in KS)}) ks(k))"""


@query(f"with {RECALL} select cast(k as int) as k, hit_questions, questions, round(hit_questions / questions, 9) as recall from recalls")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    hits = fusion.with_texts(hybrid_rows(spark, d), read(spark, d, "documents"))
    return grading.recall_at_k(hits, questions(spark, d), KS)


@query(f"with {RECALL} select cast(k as int) as k, round(hit_questions / questions, 9) as recall from recalls order by hit_questions desc, k limit 1")
def best_top_k(spark: SparkSession, d: str) -> DataFrame:
    return grading.best_k(recall_at_k(spark, d), "recall", "k").select("k", "recall")


@query(f"with {GRADED} select conv_id, turn, correct_answer, predicted_answer, is_correct, error from graded")
def graded_results(spark: SparkSession, d: str) -> DataFrame:
    return graded(spark, d).select("conv_id", "turn", "correct_answer", "predicted_answer", "is_correct", "error")


@query(f"with {GRADED} select conv_id, turn, is_correct and error is null as is_correct from graded")
def graded_strict(spark: SparkSession, d: str) -> DataFrame:
    return grading.grade(answers(spark, d), strict=True).select("conv_id", "turn", "is_correct")


STAGES = "stages as (select conv_id % 2 as stage, count(*) as total_questions, count_if(is_correct) as correct, round(count_if(is_correct) / count(*), 9) as accuracy from graded group by 1)"


def stages(spark: SparkSession, d: str) -> DataFrame:
    return grading.stage_result(graded(spark, d).withColumn("stage", F.col("conv_id") % 2), ["stage"])


@query(f"with {GRADED}, {STAGES} select stage, total_questions, cast(correct as bigint) as correct, accuracy from stages")
def accuracy_stage(spark: SparkSession, d: str) -> DataFrame:
    return stages(spark, d)


RUNNING = """running as (select conv_id, turn, row_number() over w as done, cast(sum(cast(is_correct as int)) over w as bigint) as correct_so_far, error
  from graded window w as (partition by turn order by conv_id rows unbounded preceding))"""


def running(spark: SparkSession, d: str) -> DataFrame:
    return grading.running(graded(spark, d), "conv_id", "turn", block=64)


@query(f"with {GRADED}, {RUNNING} select conv_id, turn, done, correct_so_far, round(correct_so_far / done, 9) as accuracy_so_far from running")
def running_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return running(spark, d).select("conv_id", "turn", "done", "correct_so_far", "accuracy_so_far")


@query(f"""with {GRADED}, {RUNNING} select conv_id, turn, done from (select *, max(done) over (partition by turn) as last from running)
where done % 5 = 0 or done = last or error is not null""")
def progress_every_n(spark: SparkSession, d: str) -> DataFrame:
    shown = grading.every_nth(running(spark, d), 5, "turn", F.col("error").isNotNull())
    return shown.select("conv_id", "turn", "done")


@query(f"""with {GRADED}, {STAGES} select a.accuracy as base_accuracy, b.accuracy as other_accuracy, round(b.accuracy - a.accuracy, 9) as improvement,
  round(case when a.accuracy > 0 then (b.accuracy - a.accuracy) / a.accuracy * 100 else 0 end, 6) as improvement_percent,
  case when b.accuracy > a.accuracy then 'improvement' when b.accuracy = a.accuracy then 'no change' else 'worse' end as verdict
from stages a, stages b where a.stage = 0 and b.stage = 1""")
def ab_comparison(spark: SparkSession, d: str) -> DataFrame:
    rows = stages(spark, d)
    return grading.compare(rows.where("stage = 0"), rows.where("stage = 1"))


@query(f"""with {GRADED}, {STAGES} select cast(stage as varchar) as stage, concat(cast(stage as varchar), ':', chr(10), '  total_questions: ', cast(total_questions as varchar), chr(10),
  '  correct: ', cast(correct as varchar), chr(10), '  accuracy: ', printf('%.4f', accuracy)) as section from stages""")
def stage_report(spark: SparkSession, d: str) -> DataFrame:
    return grading.stage_report(stages(spark, d).withColumn("stage", F.col("stage").cast("string")), "stage")


@query(f"with {ANSWERS} select conv_id, turn, starts_with(response, 'Error generating answer:') as is_error from answers")
def error_predicate(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("conv_id", "turn", text.is_error("response").alias("is_error"))


# Runs: what a folder of checkpoints and a retrieval run report.


@query(f"""with {CHECKPOINTS} select script_name, checkpoint_id, processed_questions, total_questions from (
  select *, row_number() over (partition by script_name order by timestamp desc, checkpoint_id) as n from checkpoints
  where total_questions = 0 or processed_questions < total_questions) where n = 1""")
def interrupted_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = caching.interrupted(checkpoints(spark, d).withColumn("file", F.lpad(F.col("checkpoint_id").cast("string"), 20, "0")))
    return rows.select("script_name", "checkpoint_id", "processed_questions", "total_questions")


@query("""select count(*) as total_questions, count(c.k) as cached_count, count(*) - count(c.k) as missing_count
from benchmark b left join (select distinct md5(text) as k from benchmark where item_id % 2 = 0) c on md5(b.text) = c.k""")
def retrieval_totals(spark: SparkSession, d: str) -> DataFrame:
    rows, held = cached(spark, d)
    return caching.totals(rows, held)


@query("""select doc_id, array_to_string(list_transform(list_sort([concat('lang=', lang), concat('source=', source), 'kind=text']), lambda x: x), '|') as items,
  coalesce(source, 'unknown') as source, 'none' as publisher from documents""")
def metadata_map(spark: SparkSession, d: str) -> DataFrame:
    """Metadata as a map: merged, with a default, and as sorted items; what is null is shown as nothing."""
    rows = read(spark, d, "documents")
    own = F.create_map(F.lit("kind"), F.lit("document"), F.lit("lang"), F.col("lang"))
    merged = corpus.updated(own, F.create_map(F.lit("kind"), F.lit("text"), F.lit("source"), F.col("source")))
    rows = rows.withColumn("m", merged)
    items = F.array_join(F.transform(corpus.sorted_items(F.col("m")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "|")
    return rows.select(
        "doc_id", items.alias("items"), corpus.with_default(F.col("m"), "source", F.lit("unknown")).alias("source"),
        corpus.with_default(F.col("m"), "publisher", F.lit("none")).alias("publisher"),
    )


PASSAGE, STEP = 60, 45


@query(rf"""with cut as (select doc_id, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> '') as w from documents where text is not null),
starts as (select doc_id, w, unnest(range(0, greatest(len(w) - {PASSAGE - STEP} - 1, 0) + 1, {STEP})) as s from cut where len(w) > 0)
select doc_id, cast(s / {STEP} as int) as chunk, md5(array_to_string(w[s + 1 : s + {PASSAGE}], ' ')) as text_md5 from starts""")
def article_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.chunks(read(spark, d, "documents").select("doc_id", "text"), "text", PASSAGE, PASSAGE - STEP)
    return rows.select("doc_id", "chunk", F.md5("text").alias("text_md5"))


NO_TEXT = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<nav\b.*?</nav>"


def plain_sql(html: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({html}, '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))"


@query(rf"""with bare as (select page_id, regexp_replace(html, '{NO_TEXT}', ' ', 'g') as b from pages where html is not null),
cut as (select page_id, list_concat([''], regexp_extract_all(b, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)) as h, regexp_split_to_array(b, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') as c from bare),
parts as (select page_id, unnest(range(len(h))) as section, h, c from cut),
plain as (select page_id, section, {plain_sql("h[section + 1]")} as heading, {plain_sql("c[section + 1]")} as content from parts)
select page_id, cast(section as int) as section, heading, md5(content) as content_md5 from plain where section > 0 or content <> ''""")
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus.sections(read(spark, d, "pages").select("page_id", "html"), "html")
    return rows.select("page_id", "section", "heading", F.md5("content").alias("content_md5"))


@query(f"""select page_id, section, cast(sum(length(regexp_replace(content, ' ', '', 'g'))) as bigint) as chars from (
  select page_id, cast(section as int) as section, content from ({{SECTIONS}})) group by all having sum(length(regexp_replace(content, ' ', '', 'g'))) > 0""")
def page_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 400 characters at most; together they hold what their section does."""
    rows = corpus.section_passages(read(spark, d, "pages").select("page_id", "html"), "html", 400)
    chars = F.length(F.regexp_replace("passage", " ", ""))
    too_long = F.max(F.length("passage")) > 400
    return rows.groupBy("page_id", "section").agg(F.when(too_long, -1).otherwise(F.sum(chars)).cast("long").alias("chars"))


SQL["page_passages"] = SQL["page_passages"].replace("{SECTIONS}", SQL["page_sections"].replace("md5(content) as content_md5", "content"))


# Sources and sinks: what is written is read back.


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes."""
    folder = tables.shared_folder(spark)
    if folder is None:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{folder}/loomdex-{name}-{uuid.uuid4().hex}"


@query(f"""with {ORDINALS}, {QUESTIONS}
select ordinal, question, array_to_string(options, '|') as options, answer_index, answer from questions join ordered on item_id = query_id""")
def question_file(spark: SparkSession, d: str) -> DataFrame:
    """Questions saved as one JSON array and loaded again, in order; a question file is small."""
    rows = questions(spark, d).orderBy("query_id").select(F.to_json(F.struct("question", "options", "answer_index", "answer")))
    path = f"{workspace(spark, 'questions')}/questions.json"
    tables.put_text(spark, path, "[" + ",\n".join(r[0] for r in rows.collect()) + "]")
    loaded = tables.read_questions(spark, path)
    return loaded.select("ordinal", "question", F.array_join("options", "|").alias("options"), "answer_index", "answer")


@query("select count(*) as questions, cast(0 as bigint) as missing from benchmark")
def question_file_missing(spark: SparkSession, d: str) -> DataFrame:
    none = tables.read_questions(spark, workspace(spark, "none") + "/absent.json", missing_ok=True)
    there = read(spark, d, "benchmark").agg(F.count("*").alias("questions"))
    return there.crossJoin(F.broadcast(none.agg(F.count("*").alias("missing"))))  # two one-row counts


@query(f"select corpus, count(*) as records, cast(sum(length(content)) as bigint) as chars from ({CORPORA}) group by corpus")
def corpus_store(spark: SparkSession, d: str) -> DataFrame:
    path = workspace(spark, "corpus")
    tables.write_corpus(corpus.union({n: corpus.documents(f) for n, f in corpora(spark, d).items()}), path)
    kept = tables.read_chunks(spark, path)
    return kept.groupBy("corpus").agg(F.count("*").alias("records"), F.sum(F.length("content").cast("long")).alias("chars"))


@query("""select doc_id, case when lang is null and n_chars is null then '{}' when lang is null then to_json({'n_chars': n_chars})
    when n_chars is null then to_json({'lang': lang}) else to_json({'lang': lang, 'n_chars': n_chars}) end as nested,
  concat('[', coalesce('"' || lang || '"', 'null'), ',', coalesce('"' || source || '"', 'null'), ']') as listed,
  concat('[{"key":"lang"', coalesce(',"value":"' || lang || '"', ''), '},{"key":"source"', coalesce(',"value":"' || source || '"', ''), '}]') as mapped from documents""")
def metadata_values(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(
        "doc_id", F.struct("lang", "n_chars").alias("nested"), F.array("lang", "source").alias("listed"),
        F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("mapped"),
    )
    kinds = dict(rows.dtypes)
    return rows.select("doc_id", *(corpus.normalized(F.col(c), kinds[c]).alias(c) for c in ("nested", "listed", "mapped")))


@query("""with runs as (select event_type, count(*) as total, count_if(event_type = 'click' or event_id % 3 > 0) as processed, count_if(event_id % 2 = 0) as correct from events group by 1)
select event_type as script_name, total as total_questions, processed as processed_questions, correct as correct_count from runs where processed < total""")
def checkpoint_files(spark: SparkSession, d: str) -> DataFrame:
    """A checkpoint and its backup for each event type, of which the unfinished are found."""
    folder = workspace(spark, "checkpoints")
    rows = read(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("total"), F.count_if((F.col("event_type") == "click") | (F.col("event_id") % 3 > 0)).alias("processed"),
        F.count_if(F.col("event_id") % 2 == 0).alias("correct"),
    ).collect()  # one row for each kind of event
    for r in rows:
        for done, correct in ((r["processed"] // 2, 0), (r["processed"], r["correct"])):
            state = {"total_questions": r["total"], "processed_questions": done, "correct_count": correct}
            tables.write_checkpoint(spark, folder, r["event_type"], **state)
    # A script that is complete has a backup that is not: only what is newest counts for it.
    tables.clear_checkpoint(spark, folder, "click")
    found = caching.interrupted(tables.read_checkpoints(spark, folder, [r["event_type"] for r in rows]))
    return found.select("script_name", "total_questions", "processed_questions", "correct_count")


@query(f"""with {GRADED}, {STAGES} select cast(stage as varchar) as stage, total_questions, cast(correct as bigint) as correct, accuracy, 'completed' as status, false as live_left from stages""")
def run_results(spark: SparkSession, d: str) -> DataFrame:
    """Live and then final results of a run, read from its JSON file."""
    files = tables.RunFiles(spark, workspace(spark, "run"), "graded answers", {"k": 3})
    found = {f"stage_{r['stage']}": r.asDict() for r in stages(spark, d).collect()}  # one row for each stage
    files.live(next(iter(found.values())))
    files.final(found)
    body = spark.read.json(files.paths("completed")[0], multiLine=True)
    rows = F.explode(F.array(*(F.col(name) for name in found))).alias("s")
    left = any(tables.exists(spark, p) for p in files.paths("running"))
    out = body.select("status", rows).select(F.col("s.stage").cast("string").alias("stage"), "s.total_questions", "s.correct", "s.accuracy", "status")
    return out.withColumn("live_left", F.lit(left))


@query(f"""with {dense_sql('dense', 3)}, held as (select distinct md5(b.text) as k from dense h join documents using (doc_id) join benchmark b on b.item_id = h.query_id)
select count(*) as total_questions, count(k) as processed_questions, count(k) as cached_count from benchmark b left join held on md5(b.text) = k""")
def retrieval_store(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a second run over a cache that the first one filled."""
    path, config = workspace(spark, "cache"), evaluation.EvaluationConfig(top_k=3)
    rows = questions(spark, d).withColumn("ordinal", F.col("query_id")).drop("query_id")
    hits = dense.topk(vectors(spark, d), query_vectors(spark, d), 3)
    for _ in range(2):
        totals = evaluation.retrieve_to_cache(rows, hits, read(spark, d, "documents"), path, config)
    return totals


@query("""select item_id as query_id, case when item_id % 3 = 0 then 'second' when item_id % 3 = 1 then 'first' end as context, md5(text) as question_key
from benchmark where item_id = (select min(b.item_id) from benchmark b where b.text = benchmark.text) and item_id % 3 < 2""")
def cache_compacted(spark: SparkSession, d: str) -> DataFrame:
    """A cache of two thirds of the questions, a third of which was retrieved again, as one part."""
    path = workspace(spark, "bucketed")
    rows = caching.keyed(questions(spark, d))
    first = Window.partitionBy("question_key").orderBy("query_id")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("query_id", "question_key")
    for context, some in (("first", "query_id % 3 < 2"), ("second", "query_id % 3 = 0")):
        cache.append(rows.where(some).select("question_key", F.array(F.lit(1.0)).alias("scores"), F.array(F.lit(context)).alias("contexts")), path, "1", 3)
    cache.compact(spark, path)
    return rows.join(cache.read(spark, path, "1", 3), "question_key").select("query_id", F.element_at("contexts", 1).alias("context"), "question_key")


# Model adapters with deterministic stand-ins.

HEX = "0123456789abcdef"
BYTE = f"((instr('{HEX}', substr(h, {{0}}, 1)) - 1) * 16 + instr('{HEX}', substr(h, {{0}} + 1, 1)) - 1)"

#: The stand-in's vectors by cell: words add 1 or take 1 away at the place that their MD5 gives.
EMBEDDED = rf"""hashed as (select doc_id, md5(w) as h from (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) as w from documents)),
cells as (select doc_id, {BYTE.format(1)} % 64 as i, sum(case when instr('89abcdef', substr(h, 15, 1)) > 0 then 1 else -1 end) as x from hashed group by all),
sums as (select doc_id, count_if(x <> 0) as filled, sum((i + 1) * x) as weighed, sqrt(sum(x * x)) as norm from cells group by doc_id),
embedded as (select doc_id, cast(coalesce(filled, 0) as int) as filled, round(case when norm > 0 then weighed / norm else 0.0 end, 6) + 0.0 as checksum from documents left join sums using (doc_id))"""


def vector_digest(v: str) -> list:
    """How many cells of a vector are not zero, and their sum weighed by place."""
    weighed = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return [F.size(F.filter(v, lambda x: x != 0)).alias("filled"), (F.round(weighed, 6) + 0.0).alias("checksum")]


@query(f"with {EMBEDDED} select doc_id, filled, checksum from embedded")
def embed_stub(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", models.embed_column("text").alias("v"))
    return rows.select("doc_id", *vector_digest("v"))


@query(f"with {EMBEDDED} select doc_id, source, filled, checksum from embedded join documents using (doc_id)")
def vector_store(spark: SparkSession, d: str) -> DataFrame:
    """A vector index of half of the documents to which all are added, loaded again."""
    path, docs = workspace(spark, "vectors"), read(spark, d, "documents")
    evaluation.build_vector_index(docs.where("doc_id % 2 = 0"), path)
    evaluation.append_to_vector_index(docs, path)
    return evaluation.load_vector_index(spark, path, "hashed-embedding").select("doc_id", "source", *vector_digest("v"))


@query(f"with {EMBEDDED} select (select count(*) from documents) as document_count, source, count(*) as documents, 'hashed-embedding' as embedding_model from documents group by source")
def vector_store_metadata(spark: SparkSession, d: str) -> DataFrame:
    meta = evaluation.build_vector_index(read(spark, d, "documents"), workspace(spark, "metadata"))
    return meta.select("document_count", F.explode("sources").alias("source", "documents"), "embedding_model")


WORD_SETS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"


@query(f"""with {RRF}, pairs as (
  select h.query_id, h.doc_id, h.rank, {WORD_SETS.format('b.text')} as q, {WORD_SETS.format('t.text')} as t
  from hybrid h join documents t using (doc_id) join benchmark b on b.item_id = h.query_id),
scored as (select query_id, doc_id, rank, case when len(q) > 0 then len(list_intersect(q, t)) / len(q) else 0.0 end as rerank_score from pairs)
select query_id, doc_id, rerank_score, new_rank from (
  select *, cast(row_number() over (partition by query_id order by rerank_score desc, rank) as int) as new_rank from scored) where new_rank <= 5""")
def rerank_stub(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.with_texts(hybrid_rows(spark, d).join(questions(spark, d), "query_id"), read(spark, d, "documents"))
    scored = rows.withColumn("rerank_score", models.score_pairs("question", "text"))
    return fusion.rerank(scored, 5).select("query_id", "doc_id", "rerank_score", "new_rank")


@query(rf"""with {ASKED}, flat as (select conv_id, turn, query, regexp_replace(query, '^{SPACE}+|{SPACE}+$', '', 'g') as q from asked),
gated as (select *, case when q = '' then false when regexp_matches(q, '[\x{{4e00}}-\x{{9fff}}]') then true
  when regexp_matches(lower(q), '(^|[^\p{{L}}\p{{N}}_])({"|".join(k for k, _ in dictionary.ABBREVIATIONS)})([^\p{{L}}\p{{N}}_]|$)') then true
  when length(q) > 160 then false when len(regexp_split_to_array(q, '{SPACE}+')) > 24 then false else true end as needed from flat)
select conv_id, turn, case when needed then regexp_replace(q, '{SPACE}+', ' ', 'g') else query end as rewritten from gated""")
def llm_rewrite_stub(spark: SparkSession, d: str) -> DataFrame:
    asked = asked_queries(spark, d)
    return models.rewrite_queries(asked, "query", text.needs_model_rewrite("query")).select("conv_id", "turn", "rewritten")


def answered_sql(name: str, context: str | None, contexts_name: str = "contexts") -> str:
    """The stand-in's answers: an option letter by the first byte of the prompt's MD5."""
    source = "questions" if context is None else f"questions left join {contexts_name} using (query_id)"
    return f"""{name}_hashed as (select query_id, {LETTER} as correct_answer, md5({prompt_sql(context)}) as h from {source}),
{name} as (select query_id, substr('ABCDE', cast({BYTE.format(1)} % 5 + 1 as int), 1) as predicted_answer, correct_answer from {name}_hashed)"""


SAID = "select query_id, predicted_answer, coalesce(predicted_answer = correct_answer, false) as is_correct, concat('Answer: ', predicted_answer) as response from said"


@query(f"with {CONTEXTS}, {QUESTIONS}, {answered_sql('said', 'context')} {SAID}")
def llm_answer_stub(spark: SparkSession, d: str) -> DataFrame:
    rows = questions(spark, d).withColumn("ordinal", F.col("query_id")).drop("query_id")
    out = evaluation.with_retrieval(rows, hybrid_rows(spark, d).where("rank <= 3"), read(spark, d, "documents"))
    return out.select("query_id", "predicted_answer", "is_correct", "response")


@query(f"with {QUESTIONS}, {answered_sql('said', None)} {SAID}")
def llm_norag_stub(spark: SparkSession, d: str) -> DataFrame:
    rows = questions(spark, d).withColumn("ordinal", F.col("query_id")).drop("query_id")
    return evaluation.without_retrieval(rows).select("query_id", "predicted_answer", "is_correct", "response")


@query(f"with {QUESTIONS}, {answered_sql('said', None)} {SAID}")
def resumed_run(spark: SparkSession, d: str) -> DataFrame:
    """A run in batches that goes on where an earlier one of a third of the questions ended."""
    rows = questions(spark, d).withColumn("ordinal", F.col("query_id")).drop("query_id")
    path, seen = workspace(spark, "resumed"), []
    evaluation.resume(rows.where("ordinal % 3 = 0"), path, evaluation.without_retrieval)
    out = evaluation.resume(rows, path, evaluation.without_retrieval, batch=64, progress=lambda done, correct: seen.append(done))
    return out.select("query_id", "predicted_answer", "is_correct", "response")


def grid_sql(ks: tuple[int, ...]) -> str:
    parts = [f"{contexts_sql(f'contexts_{k}', k)}, {answered_sql(f'said_{k}', 'context', f'contexts_{k}')}" for k in ks]
    rows = " union all ".join(
        f"select {i} as place, {k} as k, count(*) as total_questions, cast(count_if(predicted_answer = correct_answer) as bigint) as correct from said_{k}"
        for i, k in enumerate(ks)
    )
    return f"""with {RRF}, {QUESTIONS}, {", ".join(parts)}, grid as ({rows})
select cast(k as int) as k, total_questions, correct, round(correct / total_questions, 9) as accuracy from grid order by accuracy desc, place limit 1"""


@query(grid_sql(KS[:3]))
def grid_search_stub(spark: SparkSession, d: str) -> DataFrame:
    rows = questions(spark, d).withColumn("ordinal", F.col("query_id")).drop("query_id")
    found = evaluation.grid_search(rows, hybrid_rows(spark, d), read(spark, d, "documents"), list(KS[:3]))
    return grading.best_k(found, "accuracy", "place").select("k", "total_questions", "correct", "accuracy")


#: User turns as questions: rewritten by the dictionaries, and where the turn passes the gate by the stand-in, which collapses white space.
REWRITTEN = rf"""{ASKED.replace("asked as (", "turns as (", 1)}, texts as (select conv_id * 1000 + turn as query_id, query as question, query from turns),
one as (select query_id, question, {ABBREVIATED} as query from texts), two as (select query_id, question, {SYNONYMOUS} as query from one),
three as (select query_id, regexp_replace(question, '^{SPACE}+|{SPACE}+$', '', 'g') as q, {chained_sql('query', FULL_CHINESE, False)} as query from two),
gated as (select query_id, query, case when q = '' then false when regexp_matches(q, '[\x{{4e00}}-\x{{9fff}}]') then true
  when regexp_matches(lower(q), '(^|[^\p{{L}}\p{{N}}_])({"|".join(k for k, _ in dictionary.ABBREVIATIONS)})([^\p{{L}}\p{{N}}_]|$)') then true
  when length(q) > 160 then false when len(regexp_split_to_array(q, '{SPACE}+')) > 24 then false else true end as needed from three),
rewritten as (select query_id, case when needed then regexp_replace(regexp_replace(query, '^{SPACE}+|{SPACE}+$', '', 'g'), '{SPACE}+', ' ', 'g') else query end as query from gated)"""

#: Cosines of the stand-in's vectors of documents and of rewritten queries.
NEAR_REWRITTEN = rf"""hashed as (select kind, id, md5(w) as h from (
    select 0 as kind, doc_id as id, unnest({TOKENS.format("coalesce(text, '')")}) as w from documents
    union all select 1, query_id, unnest({TOKENS.format("query")}) from rewritten)),
cells as materialized (select * from (select kind, id, {BYTE.format(1)} % 64 as i, sum(case when instr('89abcdef', substr(h, 15, 1)) > 0 then 1 else -1 end) as x from hashed group by all) where x <> 0),
norms as (select kind, id, sqrt(sum(x * x)) as norm from cells group by all),
dots as (select q.id as query_id, c.id as doc_id, sum(q.x * c.x) as dot from cells q join cells c on q.kind = 1 and c.kind = 0 and q.i = c.i group by all),
cosines as (select r.query_id, c.doc_id, round(coalesce(dot / (a.norm * b.norm), 0.0), 6) + 0.0 as score
  from rewritten r cross join documents c left join dots d on d.query_id = r.query_id and d.doc_id = c.doc_id
  left join norms a on a.kind = 1 and a.id = r.query_id left join norms b on b.kind = 0 and b.id = c.doc_id),
dense as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from cosines) where rank <= {FETCHED})"""


@query(f"""with {REWRITTEN}, {padded_sql(FETCHED, "select query_id, query from rewritten")}, {NEAR_REWRITTEN},
fused as (select query_id, doc_id, round(sum(part), 9) as score from (
  select query_id, doc_id, 0.5 / (60 + rank) as part from dense union all select query_id, doc_id, 0.5 / (60 + rank) from sparse) group by all),
hybrid as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from fused) where rank <= {RETRIEVED}),
pairs as (select h.query_id, h.doc_id, h.rank, h.score, {WORD_SETS.format('r.query')} as q, {WORD_SETS.format('t.text')} as t
  from hybrid h join documents t using (doc_id) join rewritten r using (query_id)),
scored as (select *, case when len(q) > 0 then len(list_intersect(q, t)) / len(q) else 0.0 end as shared from pairs)
select query_id, doc_id, score, rank from (
  select query_id, doc_id, score, cast(row_number() over (partition by query_id order by shared desc, rank) as int) as rank from scored) where rank <= 5""")
def hybrid_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """A whole hybrid retrieval: rewritten queries for both searches and the reranker, the gate on the turn as it was said."""
    docs, config = read(spark, d, "documents"), evaluation.EvaluationConfig(top_k=5, rewrite_model="echo-rewrite", rerank_model="overlap-pairs")
    turns = asked_queries(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), F.col("query").alias("question"))
    turns = turns.withColumns({"answer_index": F.lit(0), "answer": F.lit("")})
    vectors_of_docs = evaluation.vector_rows(docs, "hashed-embedding").select("doc_id", "v")
    return evaluation.hybrid_retrieval(turns, docs, index(spark, d), vectors_of_docs, "hashed-embedding", workspace(spark, "hybrid"), config)
