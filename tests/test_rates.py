import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomdex.functions import models
from loomdex.functions.rates import Schedule, SharedRate
from loomdex.plans import evaluation
from loomdex.plans.config import CallSettings


def test_schedule_by_a_clock_of_its_own():
    now = [0.0]
    schedule = Schedule(2.0, 3, lambda: now[0])
    assert schedule.take(5) == [0.0, 0.0, 0.0, 0.5, 1.0]
    now[0] = 1.0
    assert schedule.take(1) == [0.5]
    now[0] = 100.0  # what was not used is lost but for the burst
    assert schedule.take(4) == [0.0, 0.0, 0.0, 0.5]
    with pytest.raises(ValueError):
        Schedule(0)


class Timed:
    """Answers with the time of the call."""

    takes_query = True

    def complete(self, prompts):
        return [repr(time.time()) for _ in prompts]


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_tasks_share_one_rate(spark, partitions):
    """Of one very large partition and others that are nearly empty too."""
    rows = spark.range(120).withColumn("prompt", F.col("id").cast("string"))
    large = rows.where("id < 100").coalesce(1)
    dealt = large.union(rows.where("id >= 100").repartition(partitions - 1)) if partitions > 1 else rows.coalesce(1)
    with SharedRate(40.0) as shared:
        said = dealt.select(models.complete_column("prompt", Timed, in_flight=4, places=shared.places()).alias("at"))
        times = sorted(float(r["at"]) for r in said.collect())
    rate = (len(times) - 1) / (times[-1] - times[0])
    assert rate == pytest.approx(40.0, rel=0.05)


def test_a_stranger_gets_no_places():
    with SharedRate(1.0) as shared:
        with pytest.raises(ConnectionError):
            replace(shared.places(), key="another").acquire()


def test_rewriting_and_answering_share_it(spark):
    config = evaluation.EvaluationConfig(calls=CallSettings(requests_per_minute=60 * 40 / 0.9, in_flight=1), call_partitions=3, answer_model=Timed, rewrite_model=Timed)
    rows = [(i, f"question {i}", ["x"], 0, "x") for i in range(30)]
    asked = spark.createDataFrame(rows, "ordinal long, question string, options array<string>, answer_index int, answer string")
    with config.sharing(spark) as shared:
        times = [float(r["query"]) for r in evaluation.rewritten_queries(evaluation.prepared(asked), shared).collect()]
        times += [float(r["response"]) for r in evaluation.without_retrieval(asked, shared).collect()]
    times.sort()
    assert len(times) == 60 and all(times[i + 20] - times[i] > 19 / 40 * 0.9 for i in range(40))
    with replace(config, calls=CallSettings(requests_per_minute=None)).sharing(spark) as alone:
        assert alone.places is None
