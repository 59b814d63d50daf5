import time

from loomdex.operators import grading
from loomdex.streaming import incremental, progress

SCHEMA = "conv_id long, ts timestamp, response string, correct_answer string"


def rows(spark, ids):
    return spark.createDataFrame([(i, None, f"Answer: {'ABCDE'[i % 5]}", "A") for i in ids], SCHEMA)


def test_restarts_grade_each_question_once(spark, tmp_path):
    inbox, results, state = (str(tmp_path / n) for n in ("inbox", "results", "state"))
    schema = rows(spark, []).schema
    for part in (range(5), range(5, 12), range(0)):
        if part:
            rows(spark, part).coalesce(1).write.mode("append").parquet(inbox)
        incremental.evaluate_stream(spark, inbox, schema, grading.grade, results, state, files_per_batch=1).awaitTermination()
    found = spark.read.parquet(results)
    assert sorted(r["conv_id"] for r in found.collect()) == list(range(12))
    whole = grading.grade(rows(spark, range(12)))
    assert grading.stage_result(found).collect() == grading.stage_result(whole).collect()


def test_windowed_accuracy(spark, tmp_path):
    inbox = str(tmp_path / "in")
    spark.sql(
        "select timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) as ts, id % 2 = 0 as is_correct, 's' as stage from range(20) t(id)"
    ).coalesce(1).write.parquet(inbox)
    stream = spark.readStream.schema("ts timestamp, is_correct boolean, stage string").parquet(inbox)
    out = incremental.windowed_accuracy(stream, "ts", "10 minutes", "0 seconds", "stage")
    query = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["total"], r["correct"]) for r in spark.table("windows").collect()) == [(10, 5), (10, 5)]


def test_progress(spark, tmp_path):
    assert progress.line(0, 4, 0, 0.0) == "0/4 questions, accuracy 0.0000, 0.00 a second"
    assert progress.line(2, None, 1, 4.0) == "2 questions, accuracy 0.5000, 0.50 a second"
    said = []
    listener = progress.Heartbeat(said.append)
    spark.streams.addListener(listener)
    inbox = str(tmp_path / "inbox")
    rows(spark, range(3)).write.parquet(inbox)
    query = incremental.evaluate_stream(spark, inbox, rows(spark, []).schema, grading.grade, str(tmp_path / "r"), str(tmp_path / "s"))
    query.awaitTermination()
    for _ in range(50):
        if "ended" in said:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert said[0].startswith("started") and "batch 0: 3 rows" in said and "ended" in said
