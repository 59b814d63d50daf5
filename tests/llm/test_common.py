"""Scratch tables, slices of texts and salted joins."""

import os
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomdex.llm import common


def test_a_cluster_needs_a_shared_folder():
    nothing = SimpleNamespace(isDefined=lambda: False)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nothing))
    context = SimpleNamespace(master="spark://host:7077", _jsc=jsc)
    with pytest.raises(ValueError):
        common.shared_dir(SimpleNamespace(conf={}, sparkContext=context))
    assert common.shared_dir(SimpleNamespace(conf={common.CHECKPOINT_KEY: "hdfs:/x/"}, sparkContext=context)) == "hdfs:/x"
    assert all(common.LOCAL_MASTER.fullmatch(m) for m in ("local", "local[8]", "local[*]"))
    assert not common.LOCAL_MASTER.fullmatch("local-cluster[3,2,3000]")


def test_scratch_tables_go_when_they_are_done_with(spark):
    there = lambda frame: os.path.isdir(frame._loomdex_path.removeprefix("file:"))
    with common.scratch_scope():
        scratch = common.Scratch(spark, "test")
        a, b, c = (scratch.write(spark.range(n)) for n in (1, 2, 3))
        scratch.drop(a)
        assert not there(a) and there(b) and there(c)
        scratch.drop_all_but(c)
        assert not there(b) and c.count() == 3
    assert not there(c)


def test_files_of_a_table_are_bounded(spark, scratch, monkeypatch):
    many = spark.range(1000).repartition(100)
    cores = spark.sparkContext.defaultParallelism
    assert len(scratch.write(many).inputFiles()) <= common.FILES_PER_CORE * cores
    kept = scratch.write(spark.range(100_000))
    assert common.bytes_read(kept) > 1000 and common.bytes_read(kept.where("id > 3")) == common.bytes_read(kept)
    monkeypatch.setattr(common, "FILE_BYTES", 1000)
    assert len(scratch.write(kept.repartition(60)).inputFiles()) > common.FILES_PER_CORE * cores


def test_slices_hold_whole_rows_of_bounded_size():
    texts = ["a" * 10, None, "", "é" * 100, "b" * 3, "c" * 3, "d" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(7))], names=["t", "i"])
    empty = batch.slice(0, 0)
    found = list(common.slices([batch, empty, batch], "t", 16))
    assert [i for part in found for i in part.column("i").to_pylist()] == [*range(7), *range(7)]
    sizes = [[len((t or "").encode()) for t in part.column("t").to_pylist()] for part in found]
    assert all(sum(s) <= 16 or len(s) == 1 for s in sizes)
    assert common.texts_of(batch, "t")[1] == ""


def test_a_salted_join_is_a_join(spark, monkeypatch):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("key"), F.col("id").alias("row"))
    rows = rows.unionByName(spark.createDataFrame([(None, -1), (999, -2)], "key int, row long").select(F.col("key").cast("long"), "row"))
    keys = rows.where("key is not null and key < 900").groupBy("key").agg(F.count("*").alias("times"))
    want = sorted(map(tuple, rows.join(keys, "key").collect()))
    for least in (10_000, 1):
        monkeypatch.setattr(common, "HOT_ROWS", least)
        found = common.hot_join(rows, keys, "key", "times", F.col("row"))
        assert sorted(map(tuple, found.collect())) == want and found.columns == ["key", "row", "times"]
    spread = common.hot_join(rows, keys, "key", "times", F.col("row")).where("key = 7")
    assert spread.select(F.spark_partition_id()).distinct().count() > 1
