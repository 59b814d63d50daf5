"""Models that a user plugs in: a chat endpoint, rates, retries and jobs that use them."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomdex.functions import models, text
from loomdex.plans import config, evaluation, jobs


class Endpoint(BaseHTTPRequestHandler):
    """Answers B; fails once for prompts with `flaky`, always for those with `broken`."""

    seen: list = []
    failed: set = set()
    lock = threading.Lock()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = body["messages"][0]["content"]
        with self.lock:
            self.seen.append((time.time(), self.path, self.headers.get("Authorization"), body))
            fails = "broken" in prompt or ("flaky" in prompt and prompt not in self.failed)
            self.failed.add(prompt)
        self.send_response(503 if fails else 200)
        self.end_headers()
        key = "reasoning_content" if "reason" in prompt else "content"
        said = "more about it" if "rewriting" in prompt else "Answer: B"
        self.wfile.write(json.dumps({"choices": [{"message": {key: said}}]}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def endpoint():
    Endpoint.seen, Endpoint.failed = [], set()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def settings(endpoint, **more):
    return {"RAG_LLM_BASE_URL": endpoint, "RAG_LLM_API_KEY": "k", "RAG_LLM_MODEL": "m", "RAG_LLM_MAX_RETRIES": "2"} | more


def test_a_job_against_an_endpoint(spark, endpoint, tmp_path, monkeypatch):
    for k, v in settings(endpoint, RAG_EVAL_RPM_LIMIT="6000", OMP_NUM_THREADS="many").items():
        monkeypatch.setenv(k, v)
    monkeypatch.setattr(time, "sleep", time.sleep)
    asked = ["plain", "flaky", "broken", "reason"]
    questions = [{"question": q, "options": ["x", "y"], "answer_index": 1} for q in asked]
    (tmp_path / "q.json").write_text(json.dumps(questions))
    said = jobs.main(["evaluate-no-rag", "--questions", str(tmp_path / "q.json"), "--batch", "3", "--out", str(tmp_path / "out")], spark)
    assert "total_questions: 4" in said and "correct: 3" in said and "accuracy: 0.7500" in said and "llm_model: m" in said
    rows = {r["question"]: r for r in spark.read.parquet(str(tmp_path / "out/results")).collect()}
    assert rows["broken"]["error"].startswith("Error generating answer:") and not rows["broken"]["is_correct"]
    assert rows["flaky"]["is_correct"] and rows["reason"]["response"] == "Answer: B"
    _, path, key, body = Endpoint.seen[0]
    assert path == "/v1/chat/completions" and key == "Bearer k"
    assert body["model"] == "m" and body["temperature"] == 0.1 and body["enable_thinking"] is False
    final = json.loads((tmp_path / "out/summary/evaluate_no_rag_final.json").read_text())
    assert final["status"] == "completed" and "k" not in json.dumps(final["config"]).split('"')
    assert not list((tmp_path / "out").glob("checkpoint*")) and not list((tmp_path / "out/summary").glob("*live*"))


def test_rate_of_a_job(spark, endpoint):
    """Eight calls a second at most after a burst of one, over two tasks."""
    own = evaluation.EvaluationConfig.read(settings(endpoint, RAG_EVAL_RPM_LIMIT="480", RAG_EVAL_MAX_CONCURRENT="1"), call_partitions=2)
    assert own.calls == config.CallSettings(480.0, 1, 2)
    prompts = spark.range(12).select(F.lit("A").alias("correct_answer"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    assert evaluation.answered(prompts, own).where("predicted_answer = 'B'").count() == 12
    times = sorted(t for t, *_ in Endpoint.seen)
    assert times[-1] - times[0] >= (12 / 2 - 1) / (0.9 * 8 / 2) * 0.8


def test_hybrid_settings(spark, endpoint):
    env = settings(endpoint, RAG_QUERY_REWRITE_TEMPERATURE="0.5", RAG_ENHANCED_EVAL_RPM_LIMIT="12000", RAG_RERANKER_MODEL="none/such")
    own = evaluation.EvaluationConfig.read(env, True)
    assert own.rewrite_chat.options() == {"model": "m", "temperature": 0.5, "max_tokens": 200, "enable_thinking": False}
    assert own.calls.requests_per_minute == 12000
    shown = own.shown()
    assert shown["answer_model"] == "ChatModel" and shown["reranker_available"] is False and "k" not in map(str, shown.values())
    off = evaluation.EvaluationConfig.read(env | {"RAG_ENHANCED_USE_LLM_QUERY_REWRITE": "no"}, True)
    assert off.rewrite_model is None and evaluation.EvaluationConfig.read({}).answer_model == "hashed-answers"
    asked = spark.createDataFrame([(1, "what of it"), (2, "")], "id long, query string")
    found = models.rewrite_queries(asked, "query", text.needs_model_rewrite("query"), own.rewrite_model, **own.call_options())
    assert {r["id"]: r["rewritten"] for r in found.collect()} == {1: "more about it", 2: ""}
    assert "Original question: what of it" in Endpoint.seen[0][3]["messages"][0]["content"]


def test_models_by_name_path_and_callable(spark):
    class Shout:
        def complete(self, prompts):
            return [p.upper() for p in prompts]

    models.register("shout", Shout)
    frame = spark.createDataFrame([("a",), (None,)], "p string")
    for model in ("shout", Shout, "loomdex.functions.models:EchoRewrite"):
        found = [r[0] for r in frame.select(models.complete_column("p", model)).collect()]
        assert found == (["A", ""] if model != "loomdex.functions.models:EchoRewrite" else ["a", ""])
    with pytest.raises(ValueError):
        models.maker("unheard-of")
    del models.REGISTRY["shout"]


def test_a_reranker_that_cannot_be_made_or_fails_gives_no_scores(spark):
    class Broken:
        def score(self, pairs):
            raise RuntimeError("no")

    frame = spark.createDataFrame([("q", "t")], "q string, t string")
    for model in ("cross-encoder", Broken):
        assert frame.select(models.score_pairs("q", "t", model)).first()[0] is None
    assert models.pair_stats("overlap-pairs", 5) == {"reranking": True, "available": True, "model": "overlap-pairs", "device": "cpu", "top_k": 5}
    assert models.pair_stats(None, 5)["reranking"] is False


def test_a_slow_call_does_not_hold_up_the_next_batch():
    done = []

    def call(p):
        time.sleep(0.5 if p == "slow" else 0.0)
        done.append(p)
        return p

    batches = [pd.Series(["slow", "a"]), pd.Series(["b", "c"]), pd.Series([], dtype=object), pd.Series(["d"])]
    found = [list(x) for x in models.rolling(iter(batches), call, in_flight=2, ahead=4)]
    assert found == [["slow", "a"], ["b", "c"], [], ["d"]] and done[-1] == "slow"


def test_environment():
    env = {"OMP_NUM_THREADS": "0"}
    assert config.sane_environment(env) == ["OMP_NUM_THREADS"] and env == {}
    assert config.sane_environment({"OMP_NUM_THREADS": " 4 "}) == [] == config.sane_environment({})
    known = config.embedding_runtime({"embedding_model": "r"}, "d", {})
    assert known == {"model": "r", "device": "cpu", "recorded_model": "r"}
    assert config.embedding_runtime({}, "d", {"RAG_EMBEDDING_MODEL": "e"})["model"] == "e"
    assert config.GateSettings.read({"RAG_ENHANCED_LLM_QUERY_REWRITE_AUTO_MAX_CHARS": "0"}).max_chars == 1
    with pytest.raises(ValueError):
        config.ChatSettings.read(env={"RAG_LLM_ENABLE_THINKING": "perhaps"})
