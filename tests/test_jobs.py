import json

import pytest

from loomdex.plans import config, jobs
from loomdex.sources import tables


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    chunks = [{"content": f"passage {i} on topic {i % 3}", "source": "s", "id": str(i)} for i in range(12)]
    (root / "a.json").write_text(json.dumps(chunks + chunks[:2]))
    questions = [{"question": f"topic {i % 3}?", "options": ["x", "y", "z"], "answer_index": i % 3, "answer": f"topic {i % 3}"} for i in range(8)]
    (root / "q.json").write_text(json.dumps(questions))
    return root


def test_jobs_from_corpus_to_report(spark, files):
    run = lambda *a: jobs.main([str(x) for x in a], spark)
    said = run("combine-corpora", "--corpora", f"a={files}/a.json", f"b={files}/absent.json", "--out", files / "combined")
    assert said.splitlines() == ["a: 14", "b: missing"]
    assert run("build-index", "--corpus", files / "combined/corpus", "--out", files / "index").startswith("12 documents")
    given = ["--index", files / "index", "--questions", files / "q.json"]
    assert "accuracy" in run("evaluate-no-rag", *given[2:], "--dev", 2, "--out", files / "plain")
    naive = run("evaluate-naive-rag", *given, "--dev", 2, "--out", files / "naive")
    assert "development_set_evaluation" in naive and "recall_at_10: 1.0000" in naive
    for _ in range(2):  # the second run finds everything done
        hybrid = run("evaluate-hybrid-rag", *given, "--rewrite-model", "echo-rewrite", "--rerank-model", "overlap-pairs", "--out", files / "hybrid")
        assert "total_questions: 8" in hybrid
    assert "verdict" in run("compare-sample", *given, "--test", 4, "--out", files / "sample")


def test_two_stages_samples_and_added_documents(spark, files):
    run = lambda *a: jobs.main([str(x) for x in a], spark)
    (files / "articles.json").write_text(json.dumps([{"content": " ".join(f"w{i}" for i in range(50)), "id": "x", "source": "s"}, {"content": " "}]))
    assert run("chunk-corpus", "--articles", files / "articles.json", "--words", 20, "--overlap", 5, "--out", files / "cut") == "2 articles, 3 passages"
    run("combine-corpora", "--corpora", f"a={files}/a.json", "--out", files / "one")
    assert "hypertension treatment: 1." in run("build-index", "--corpus", files / "one/corpus", "--out", files / "ix")
    given = ["--index", files / "ix", "--questions", files / "q.json", "--dev", 2]
    assert "total_questions: 6" in run("evaluate-sample", *given, "--out", files / "sample-run")
    first = run("retrieve", *given, "--cache", files / "cache", "--out", files / "two")
    assert "cached_count: 0" in first and "processed_questions: 6" in first
    totals = run("retrieve", *given, "--cache", files / "cache", "--out", files / "two")
    assert "total_questions: 6" in totals and "cached_count: 6" in totals
    assert json.loads((files / "two/retrieval_results.json").read_text())["cached_count"] == 6
    assert "total_questions: 6" in run("generate", *given, "--cache", files / "cache", "--out", files / "two")
    run("combine-corpora", "--corpora", f"a={files}/a.json", f"cut={files}/cut/chunks", "--out", files / "both")
    assert run("add-documents", "--index", files / "ix", "--corpus", files / "both/corpus", "--out", files / "ix") == "15 documents"
    assert run("add-documents", "--index", files / "ix", "--corpus", files / "both/corpus", "--out", files / "ix") == "15 documents"


def test_a_run_that_is_cut_off_goes_on(spark, files, monkeypatch):
    out = str(files / "cut-off")
    args = ["evaluate-no-rag", "--questions", str(files / "q.json"), "--batch", "3", "--out", out]
    append, calls = tables.append_results, []

    def failing(results, path):
        if len(calls) == 2:
            raise RuntimeError("cut off")
        calls.append(path)
        append(results, path)

    monkeypatch.setattr(tables, "append_results", failing)
    with pytest.raises(RuntimeError):
        jobs.main(args, spark)
    monkeypatch.undo()
    (files / "cut-off" / "checkpoint_evaluate-naive-rag.json").write_text("{ not json")
    found = jobs.interrupted_runs(spark, out).collect()
    assert [(r["script_name"], r["processed_questions"], r["total_questions"]) for r in found] == [("evaluate-no-rag", 6, 8)]
    assert "cut off" in found[0]["error_message"]
    live = json.loads((files / "cut-off/summary/evaluate_no_rag_live.json").read_text())
    assert live["status"] == "running" and live["current_stage"]["processed_questions"] == 6
    said = jobs.main(["resume", "--out", out], spark)
    assert "evaluate-no-rag: 6/8" in said and "total_questions: 8" in said
    assert spark.read.parquet(f"{out}/results").count() == 8
    assert jobs.main(["resume", "--out", out], spark) == "no interrupted run"
    # A run that ended is not gone on with: the next one starts anew.
    (files / "fewer.json").write_text(json.dumps(json.loads((files / "q.json").read_text())[:2]))
    again = jobs.main(["evaluate-no-rag", "--questions", str(files / "fewer.json"), "--out", out], spark)
    assert "total_questions: 2" in again and spark.read.parquet(f"{out}/results").count() == 2


def test_settings():
    assert [config.optional_bool(x) for x in (None, " ", "Yes", "0")] == [None, None, True, False]
    with pytest.raises(ValueError):
        config.optional_bool("maybe")
    assert config.flag("X", True, {}) and not config.flag("X", True, {"X": "off"})
    assert config.first_set(["A", "B"], "d", {"A": " ", "B": "b"}) == "b" and config.first_set(["A"], "d", {}) == "d"
    assert config.resolve(None, "r", "d") == "r" and config.resolve("c", "r", "d") == "c" and config.resolve(None, None, "d") == "d"
    assert config.resolve_device("auto", ["cpu", "cuda"]) == "cuda" and config.resolve_device("cuda:1", ["cpu"]) == "cpu"
    with pytest.raises(ValueError):
        config.resolve_device("tpu", [])
    assert config.thinking_options(None) == {} and config.thinking_options(False, {"a": 1}) == {"a": 1, "enable_thinking": False}
