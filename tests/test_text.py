import pytest
from pyspark.sql import functions as F

from loomdex.functions import models, text


def values(spark, rows, schema, column):
    return [r["out"] for r in spark.createDataFrame(rows, schema).select(column.alias("out")).collect()]


def one_by_one(spark, cases, function):
    found = values(spark, [(c,) for c, _ in cases], "c string", function("c"))
    assert found == [w for _, w in cases]


def test_extract_answer(spark):
    cases = [
        ("Answer: B", "B"), ("answer： e", "E"), ("Answer: [C]", "C"), ("Answer: According to", "A"),
        ("Error generating answer: Connection error.", "C"), ("**A** then **B**", "B"), ("(A) or (C)", "C"),
        ("A patient has D", "D"), ("x_A_ E1", None), ("心A", None), ("", None), (None, None), ("ANSWER : C or D", "C"),
        ("the correct option is d", "D"), ("final answer: e", "E"), ("[A] [B]", "B"),
    ]
    one_by_one(spark, cases, text.extract_answer)


def test_tokenize(spark):
    words = values(spark, [("Naïve x² Ⅷ 心梗mi 3.5 don't a_b",), ("",), (None,)], "c string", text.tokenize("c"))
    assert words == [["naïve", "x²", "ⅷ", "心梗mi", "3", "5", "don", "t", "a_b"], [], None]


def test_expand_abbreviations(spark):
    cases = [
        ("HTN and PE", "hypulmonary embolism (pe)rtension (htn) and pulmonary embolism (pe)"),
        ("Patient admitted with MI", "patient adiabetes mellitus (dm)yocardial infarction (mi)tted with myocardial infarction (mi)"),
        ("given copd", "gastrointestinal (gi)ven chronic obstructive pulmonary disease (copd)"),
        ("", ""), (None, None),
    ]
    one_by_one(spark, cases, text.expand_abbreviations)
    words = [("HTN and PE", "hypertension (htn) and pulmonary embolism (pe)"), ("given copd", "given chronic obstructive pulmonary disease (copd)")]
    one_by_one(spark, words, lambda c: text.expand_abbreviations(c, "word"))
    with pytest.raises(ValueError):
        text.expand_abbreviations("c", "other")


def test_other_rewrites(spark):
    one_by_one(spark, [("Heart Attack, nausea", "myocardial infarction, feeling sick")], text.replace_synonyms)
    one_by_one(spark, [("心梗 A", "心肌梗死 (心梗) A")], text.expand_chinese_terms)
    one_by_one(spark, [("HF", "HF")], lambda c: text.dictionary_rewrite(c, ["chinese"]))
    with pytest.raises(ValueError):
        text.dictionary_rewrite("c", ["spelling"])


def test_gate(spark):
    cases = [
        (None, False), ("  ", False), ("心 " + "x" * 200, True), ("x " * 200 + "CKD", True), ("micky", True), ("word " * 30, False),
        ("y" * 161, False), ("y" * 160, True),
    ]
    one_by_one(spark, cases, text.needs_model_rewrite)
    one_by_one(spark, [("心", False)], lambda c: text.needs_model_rewrite(c, mode="never"))
    one_by_one(spark, [("", True)], lambda c: text.needs_model_rewrite(c, mode="always"))
    one_by_one(spark, [("心", False)], lambda c: text.needs_model_rewrite(c, enabled=False))


def test_letters_options_prompts(spark):
    rows = [(2, "x"), (-1, "b"), (None, None), (0, None)]
    assert values(spark, rows, "i int, a string", text.correct_letter("i", "a")) == ["C", "B", "", "A"]
    shown = values(spark, [(["x", "y"],), ([],), (None,)], "o array<string>", text.format_options("o"))
    assert shown == ["A. x\nB. y", text.NO_OPTIONS, text.NO_OPTIONS]
    prompts = spark.createDataFrame([("q", ["x"], "c"), ("q", ["x"], ""), ("q", ["x"], None)], "q string, o array<string>, c string")
    found = prompts.select(text.build_prompt("q", "o", "c").alias("p"), text.build_prompt("q", "o").alias("plain")).collect()
    assert "\n\nContext:\nc\n\nQuestion: q\n\nOptions:\nA. x\n\n" in found[0]["p"]
    assert found[1]["p"] == found[1]["plain"] == found[2]["p"] and found[0]["plain"] == found[1]["plain"]
    assert values(spark, [(["u", "v"],)], "c array<string>", text.render_contexts("c")) == ["[1] u\n\n[2] v"]


def test_preview_and_errors(spark):
    one_by_one(spark, [("a  b\n c", "a b c"), (None, ""), ("x" * 90, "x" * 77 + "..."), ("y" * 76 + " zzzzzz", "y" * 76 + "...")], text.question_preview)
    one_by_one(spark, [("Error generating answer: x", True), ("ok", False), (None, False)], text.is_error)
    rows = [("A", "A"), (None, "A"), ("A", "a")]
    assert values(spark, rows, "p string, k string", text.is_correct("p", "k")) == [True, False, False]
    assert values(spark, rows, "p string, k string", text.is_correct("p", "k", True)) == [True, False, True]


def test_token_bucket_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = models.TokenBucket(2.0, 3, lambda: now[0], sleep)
    for _ in range(7):
        bucket.acquire()
    assert now[0] == pytest.approx(2.0) and len(slept) == 4
    assert models.rate_for(60, 3) == pytest.approx(0.3)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return "yes"

    assert models.with_retries(flaky, sleep=slept.append) == "yes"
    with pytest.raises(ZeroDivisionError):
        models.with_retries(lambda: 1 / 0, attempts=2, sleep=slept.append)


def test_model_columns(spark, monkeypatch):
    rows = spark.createDataFrame([("a b",), (None,)], "t string")
    vectors = [r["v"] for r in rows.select(models.embed_column("t").alias("v")).collect()]
    assert sum(x * x for x in vectors[0]) == pytest.approx(1) and not any(vectors[1])
    gated = models.rewrite_queries(spark.createDataFrame([("a   b", 1), ("c   d", 2)], "q string, n int"), "q", F.col("n") == 1)
    assert {r["n"]: r["rewritten"] for r in gated.collect()} == {1: "a b", 2: "c   d"}
    with pytest.raises(ValueError):
        models.create("absent")
