import random
import uuid

import pytest
from pyspark.sql import functions as F

from loomdex.operators import caching, corpus, dense, fusion, grading, lexical
from loomdex.plans import evaluation
from loomdex.sources import cache, tables

DOCS = [(0, "alpha beta gamma"), (1, "beta beta delta"), (2, ""), (3, None), (4, "alpha alpha")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def hits(frame):
    return {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in frame.collect()}


def test_padding_fills_up_with_the_first_documents(spark, docs):
    asked = spark.createDataFrame([(1, "unknown words"), (2, "delta")], "query_id long, question string")
    index = lexical.build_index(docs)
    found = hits(lexical.topk_padded(index, docs, asked, "query_id", "question", 3))
    assert [found[1, r][0] for r in (1, 2, 3)] == [0, 1, 2] and found[1, 1][1] == 0
    assert found[2, 1][0] == 1 and [found[2, r][0] for r in (2, 3)] == [0, 2]
    plain = hits(lexical.topk(index, asked, "query_id", "question", 3))
    assert set(plain) == {(2, 1)}


def test_fusion_equals_a_full_join(spark):
    rng = random.Random(0)
    lists = []
    for _ in range(2):
        rows = [(q, d, r + 1) for q in range(5) for r, d in enumerate(rng.sample(range(30), 10))]
        lists.append(spark.createDataFrame(rows, "query_id long, doc_id long, rank int"))
    a, b = (f.withColumnRenamed("rank", n) for f, n in zip(lists, ("ra", "rb")))
    part = lambda c: F.coalesce(F.lit(0.5) / (F.lit(60) + F.col(c)), F.lit(0.0))
    joined = a.join(b, ["query_id", "doc_id"], "full").select("query_id", "doc_id", F.round(part("ra") + part("rb"), 9).alias("score"))
    assert sorted(fusion.rrf(*lists).collect()) == sorted(joined.collect())
    ten, five = fusion.hybrid(*lists, 10), fusion.hybrid(*lists, 5)
    assert sorted(ten.where("rank <= 5").collect()) == sorted(five.collect())
    single = fusion.rrf(spark.createDataFrame([(1, 7, 1), (1, 9, 2)], lists[0].schema), spark.createDataFrame([(1, 9, 1)], lists[0].schema))
    assert {r["doc_id"]: r["score"] for r in single.collect()} == {7: round(0.5 / 61, 9), 9: round(0.5 / 62 + 0.5 / 61, 9)}


def test_dense_blocks_and_zero_vectors(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(9, [0.0, 0.0])], "doc_id long, v array<float>")
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)] + [(7, [0.0, 0.0])], "query_id long, q array<float>")
    whole = sorted(dense.topk(vectors, asked, 4).collect())
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    assert sorted(dense.topk(vectors, asked, 4).collect()) == whole
    assert [r["score"] for r in whole if r["query_id"] == 7] == [0.0] * 4
    with pytest.raises(ValueError):
        dense.topk(vectors, asked, 4, "dot")


def test_rerank_falls_back(spark):
    rows = [(1, d, r, s) for d, r, s in ((5, 1, None), (6, 2, None), (7, 3, None))] + [(2, 5, 1, 0.1), (2, 6, 2, 0.9), (2, 7, 3, 0.9)]
    frame = spark.createDataFrame(rows, "query_id long, doc_id long, rank int, rerank_score double")
    found = {(r["query_id"], r["new_rank"]): r["doc_id"] for r in fusion.rerank(frame, 2).collect()}
    assert found == {(1, 1): 5, (1, 2): 6, (2, 1): 6, (2, 2): 7}


def test_ordinals_and_splits(spark):
    ids = spark.createDataFrame([(i * 7 % 1009,) for i in range(1000)], "item_id long").repartition(8)
    rows = corpus.with_ordinal(ids, "item_id").collect()
    assert [r["item_id"] for r in sorted(rows, key=lambda r: r["ordinal"])] == sorted(i * 7 % 1009 for i in range(1000))
    ten = spark.createDataFrame([(i,) for i in range(10)], "ordinal long")
    part = lambda f, p: [r["ordinal"] for r in f.where(F.col("part") == p).orderBy("ordinal").collect()]
    for test in (0, None):
        assert part(corpus.split(ten, 3, test), "test") == list(range(3, 10))
    assert part(corpus.split(ten, 3, 4), "test") == [3, 4, 5, 6] and part(corpus.split(ten, 3, 4), "dev") == [0, 1, 2]


def test_documents_and_unions(spark):
    chunks = spark.createDataFrame([("text", None, "t")], "content string, title string, source string")
    row = corpus.documents(chunks).first().asDict()
    assert row == {"content": "text", "id": "", "title": "", "source": "t", "textbook": "", "pmid": "", "journal": "", "year": ""}
    with pytest.raises(ValueError):
        corpus.documents(chunks.drop("content"))
    with pytest.raises(ValueError):
        corpus.union({"a": chunks}, [])
    assert corpus.source_counts(spark.createDataFrame([("",), (None,), ("a",)], "source string")).count() == 2


def test_running_blocks_do_not_matter(spark):
    rows = [(i, i % 2, (i * 7) % 3 == 0) for i in range(50)]
    frame = spark.createDataFrame(rows, "n long, part long, is_correct boolean")
    runs = [sorted(grading.running(frame, "n", "part", block=b).collect()) for b in (1, 7, 1000)]
    assert runs[0] == runs[1] == runs[2]


def test_recall_grows_with_k(spark):
    found = spark.createDataFrame([(1, 3, "Has the ANSWER"), (2, 1, "nothing"), (3, 2, "")], "query_id long, rank int, text string")
    asked = spark.createDataFrame([(1, "answer"), (2, "x"), (3, ""), (4, None)], "query_id long, answer string")
    assert {r["k"]: r["hit_questions"] for r in grading.recall_at_k(found, asked, [1, 3, 5]).collect()} == {1: 0, 3: 1, 5: 1}


def test_empty_stage(spark):
    none = spark.createDataFrame([], "is_correct boolean")
    row = grading.stage_result(none, elapsed=0.0).first()
    assert row["accuracy"] == 0 and row["questions_per_second"] == 0


def test_best_k_takes_the_first(spark):
    frame = spark.createDataFrame([(3, 0.5, 0), (1, 0.5, 1), (5, 0.2, 2)], "k int, accuracy double, place int")
    assert grading.best_k(frame, "accuracy", "place").first()["k"] == 3


def test_latest_incomplete(spark):
    rows = [("a", "2024-01-02", 1, 5, 9), ("a", "2024-01-02", 2, 6, 9), ("a", "2024-01-03", 3, 9, 9), ("b", "2024", 4, 1, 1)]
    frame = spark.createDataFrame(rows, "script_name string, timestamp string, checkpoint_id long, processed_questions long, total_questions long")
    assert [(r["script_name"], r["checkpoint_id"]) for r in caching.latest_incomplete(frame).collect()] == [("a", 1)]


QUESTIONS = '[{"question":"what is alpha","options":["x","y"],"answer_index":1},{"question":"beta?","answer":"b"}]'


@pytest.fixture
def questions(spark, tmp_path):
    path = tmp_path / "questions.json"
    path.write_text(QUESTIONS)
    return tables.read_questions(spark, str(path))


def test_read_questions(spark, questions, tmp_path):
    rows = questions.orderBy("ordinal").collect()
    assert [(r["ordinal"], r["answer_index"], r["answer"]) for r in rows] == [(0, 1, None), (1, None, "b")]
    with pytest.raises(FileNotFoundError):
        tables.read_questions(spark, str(tmp_path / "absent.json"))
    assert tables.read_questions(spark, str(tmp_path / "absent.json"), missing_ok=True).count() == 0


def test_two_stage_equals_one_stage(spark, docs, questions, tmp_path):
    config = evaluation.EvaluationConfig(top_k=2)
    asked = evaluation.prepared(questions)
    index = lexical.build_index(docs)
    found = lexical.topk_padded(index, docs, asked, "query_id", "question", 2)
    found = found.join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi")
    path = str(tmp_path / "cache")
    missing = evaluation.generate_from_cache(questions, path, config).collect()
    assert len(missing) == 2 and all(r["error"] and not r["is_correct"] for r in missing)
    for _ in range(2):  # the second time, nothing is missing
        evaluation.retrieve_to_cache(questions, found, docs, path, config)
    assert cache.read(spark, path, config.index_version, config.top_k).count() == 2
    two = {r["ordinal"]: (r["response"], r["is_correct"]) for r in evaluation.generate_from_cache(questions, path, config).collect()}
    one = {r["ordinal"]: (r["response"], r["is_correct"]) for r in evaluation.with_retrieval(questions, found, docs, config).collect()}
    assert one == two and len(one) == 2


def test_resume_equals_one_shot(spark, questions, tmp_path):
    run = lambda rows: evaluation.without_retrieval(rows).select("ordinal", "response", "is_correct")
    path = str(tmp_path / "results")
    evaluation.resume(questions.where("ordinal = 1"), path, run)
    assert sorted(evaluation.resume(questions, path, run).collect()) == sorted(run(questions).collect())


class CountedRewrites:
    """Answers with its prompt's question, and notes each call in a file."""

    folder = ""

    def complete(self, prompts):
        for prompt in prompts:
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
        return [f"{p} rewritten" for p in prompts]


def test_hybrid_evaluation(spark, docs, questions, tmp_path):
    vectors = evaluation.vector_rows(docs.fillna("").withColumn("source", F.lit("s")), "hashed-embedding").select("doc_id", "v")
    config = evaluation.EvaluationConfig(top_k=2, rewrite_model="echo-rewrite", rerank_model="overlap-pairs")
    filled = docs.fillna("")
    found = evaluation.hybrid_retrieval(questions, filled, lexical.build_index(filled), vectors, "hashed-embedding", str(tmp_path / "run"), config)
    assert {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()} == {0: 2, 1: 2}
    assert evaluation.with_retrieval(questions, found, filled, config).count() == 2
    assert evaluation.grid_search(questions, found, filled, [1, 2]).count() == 2


def test_k_of_a_search_follows_top_k():
    config = evaluation.EvaluationConfig(top_k=15)
    assert (config.searched, config.fetched) == (30, 90)
    assert (evaluation.EvaluationConfig(search_k=7).searched, evaluation.EvaluationConfig(search_k=7, fetch_k=9).fetched) == (7, 9)


def test_one_rewriting_call_a_query_and_the_gate_sees_the_question(spark, docs, tmp_path):
    """The dictionaries lengthen the first ten questions beyond the gate's limit
    of characters, so a gate on what they make would let none of those pass."""
    (tmp_path / "calls").mkdir()
    folder = str(tmp_path / "calls")

    def make():
        own = CountedRewrites()
        own.folder = folder
        return own

    make.takes_query = True
    short, long = "heart attack " * 11, "word " * 60
    rows = [(i, f"{short}{i}" if i < 10 else f"{long}{i}" if i >= 20 else f"plain {i}", [], 0, "") for i in range(25)]
    asked = spark.createDataFrame(rows, "ordinal long, question string, options array<string>, answer_index int, answer string")
    filled = docs.fillna("")
    vectors = evaluation.vector_rows(filled.withColumn("source", F.lit("s")), "hashed-embedding").select("doc_id", "v")
    config = evaluation.EvaluationConfig(top_k=2, rewrite_model=make, rerank_model="overlap-pairs")
    for _ in range(2):  # what is there is not retrieved again
        hits = evaluation.hybrid_retrieval(asked, filled, lexical.build_index(filled), vectors, "hashed-embedding", str(tmp_path / "run"), config)
        assert evaluation.with_retrieval(asked, hits, filled, config).count() == 25
    assert len(list((tmp_path / "calls").iterdir())) == 20
    queries = {r["query_id"]: r["query"] for r in spark.read.parquet(str(tmp_path / "run/queries")).collect()}
    assert all(q.endswith(" rewritten") == (i < 20) for i, q in queries.items()) and "myocardial" in queries[0]


def test_a_partly_failed_reranking_keeps_the_old_order(spark):
    rows = [(q, 10 * q + r, r, s) for q, scores in enumerate([[0.3, 0.1, 0.9], [None, 0.1, 0.9], [None, None, None]]) for r, s in enumerate(scores, 1)]
    hits = spark.createDataFrame(rows, "query_id long, doc_id long, rank int, rerank_score double")
    found = {(r["query_id"], r["new_rank"]): r["rank"] for r in fusion.rerank(hits, 3).collect()}
    assert [[found[q, r] for r in (1, 2, 3)] for q in range(3)] == [[3, 1, 2], [1, 2, 3], [1, 2, 3]]


def test_vector_index(spark, docs, tmp_path):
    named = docs.withColumn("source", F.lit("s"))
    meta = evaluation.build_vector_index(named, str(tmp_path)).first()
    assert meta["document_count"] == 5 and meta["sources"] == {"s": 5}
    assert evaluation.load_vector_index(spark, str(tmp_path), "hashed-embedding").count() == 5
    with pytest.raises(ValueError):
        evaluation.load_vector_index(spark, str(tmp_path), "another")


def test_writers(spark, docs, tmp_path):
    with pytest.raises(ValueError):
        tables.write_corpus(docs.where("false"), str(tmp_path / "c"))
    tables.write_corpus(docs, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 5
    stage = grading.stage_result(spark.createDataFrame([(True,), (False,)], "is_correct boolean"))
    shown = tables.write_summary(spark, str(tmp_path / "s"), "run", {"test_set": stage}, {"k": "3"})
    assert "accuracy: 0.5000" in shown and spark.read.json(str(tmp_path / "s" / "json")).first()["run"] == "run"


def test_a_stored_index_must_fit(spark, docs, tmp_path):
    path = str(tmp_path / "ix")
    assert lexical.SegmentedIndex.open(spark, path) is None
    assert lexical.stored_index(docs, path).terms.count() == 4
    assert lexical.stored_index(docs, path).version == 1
    assert lexical.stored_index(docs, path, 1.2).version == 2 and lexical.stored_index(docs, path, 1.2, 0.5).version == 3
    assert lexical.stored_index(docs.where("doc_id < 2"), path).documents == 2


def test_vectors_are_appended_once_and_may_be_missing(spark, docs, tmp_path):
    path, named = str(tmp_path / "v"), docs.withColumn("source", F.lit("s"))
    assert evaluation.load_vector_index(spark, path, missing_ok=True).count() == 0
    with pytest.raises(FileNotFoundError):
        evaluation.load_vector_index(spark, path)
    assert evaluation.append_to_vector_index(named.where("doc_id < 2"), path).first()["document_count"] == 2
    assert evaluation.append_to_vector_index(named, path).first()["document_count"] == 5
    with pytest.raises(ValueError):
        evaluation.append_to_vector_index(named, path, "another")


def test_metadata_values_and_maps(spark):
    frame = spark.sql("select 'null' as t, cast(null as string) as n, map('b', 1, 'a', 2) as m, named_struct('y', 1, 'x', array(1)) as s, 1.5 as d")
    row = frame.select(*(corpus.normalized(F.col(c), kind).alias(c) for c, kind in frame.dtypes)).first()
    assert row["t"] == "null" != row["n"]
    assert row["m"] == '[{"key":"a","value":2},{"key":"b","value":1}]' and row["s"] == '{"y":1,"x":[1]}' and row["d"] == "1.5"
    own = frame.withColumn("k", corpus.metadata_identity(frame, "t", ["n", "m", "s"]))
    assert own.withColumn("k2", corpus.metadata_identity(frame, "t", ["s", "m", "n"])).where("k = k2").count() == 1
    maps = spark.sql("select map('a', '1') as m, map('a', '2', 'c', '3') as o, cast(null as map<string,string>) as none")
    row = maps.select(
        corpus.sorted_items(corpus.updated(F.col("m"), F.col("o"))).alias("u"), corpus.updated(F.col("none"), F.col("m")).alias("e"),
        corpus.with_default(F.col("m"), "z", F.lit("d")).alias("d"), corpus.with_default(F.col("none"), "a", F.lit("d")).alias("nd"),
    ).first()
    assert [tuple(x) for x in row["u"]] == [("a", "2"), ("c", "3")] and row["e"] == {"a": "1"} and row["d"] == row["nd"] == "d"


def test_passages_of_articles(spark):
    rows = spark.createDataFrame([(1, " ".join("abcdefghij")), (2, "a b"), (3, " "), (4, None)], "id int, text string")
    found = corpus.chunks(rows, "text", 4, 1).orderBy("id", "chunk").collect()
    assert [(r["id"], r["chunk"], r["text"]) for r in found] == [(1, 0, "a b c d"), (1, 1, "d e f g"), (1, 2, "g h i j"), (2, 0, "a b")]
    with pytest.raises(ValueError):
        corpus.chunks(rows, "text", 4, 4)


def test_dense_scores_against_plain_python(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]) for i in range(60)] + [(60, None), (61, [1.0])]
    asked = [(i, v) for i, v in vectors[:9]] + [(99, None)]
    left = spark.createDataFrame(vectors, "doc_id long, v array<double>").repartition(5)
    right = spark.createDataFrame(asked, "query_id long, q array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))

    def score(a, b, measure):
        if measure == "l2":
            return round(max(0.0, sum((x - y) ** 2 for x, y in zip(a, b))), 6)
        size = (dot(a, a) * dot(b, b)) ** 0.5
        return round(dot(a, b) / size, 6) if size else 0.0

    for measure in ("cosine", "l2"):
        found = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in dense.topk(left, right, 7, measure).collect()}
        for q, x in asked[:9]:
            sign = 1 if measure == "l2" else -1
            want = sorted((sign * score(x, v, measure), i) for i, v in vectors[:60])[:7]
            assert [found[q, r + 1] for r in range(7)] == [(i, pytest.approx(sign * s)) for s, i in want]
    assert dense.topk(left, right.where("false"), 3).count() == 0
