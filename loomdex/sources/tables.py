"""Readers of questions, corpora and caches, and writers of results."""

from __future__ import annotations

import atexit
import hashlib
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("content", "id", "title", "source", "textbook", "pmid", "journal", "year")]
)
QUESTION_SCHEMA = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("options", T.ArrayType(T.StringType())),
        T.StructField("answer_index", T.IntegerType()),
        T.StructField("answer", T.StringType()),
    ]
)

def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def store_of(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in whatever store Spark writes, all at once: it is written
    under another name that then takes its place."""
    store, target = store_of(spark, path)
    _, fresh = store_of(spark, f"{path}.{uuid.uuid4().hex}.new")
    out = store.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(target, False)
    if not store.rename(fresh, target):
        raise OSError(f"could not write {path}")


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it is not there."""
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()["value"]


def remove(spark: SparkSession, path: str) -> None:
    store, target = store_of(spark, path)
    store.delete(target, True)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Gives a folder a name that is free; False if that fails, as when another run was first."""
    store, old = store_of(spark, source)
    _, new = store_of(spark, target)
    return not store.exists(new) and store.rename(old, new)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share; one of this machine where all
    tasks run in this process; None on a cluster without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        made = tempfile.mkdtemp(prefix="loomdex-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(made)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/") if found else None


def kept(frame: DataFrame) -> DataFrame:
    """The frame as a checkpoint in the shared folder: computed once, read often."""
    if shared_folder(frame.sparkSession) is None:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return frame.checkpoint()


#: Most rows that are broadcast.
BROADCAST_ROWS = 200_000


def few_rows(rows: DataFrame, value: Column | None = None, times: int = 1) -> tuple[DataFrame, set[int]]:
    """The rows of a checkpoint, marked for broadcasting if they are few, and the
    values of a column of few different ones.  Of short rows, so many times as many are few."""
    found = rows.agg(F.count("*").alias("n"), F.collect_set(F.lit(0) if value is None else value).alias("values")).first()
    return F.broadcast(rows) if found["n"] <= times * BROADCAST_ROWS else rows, set(found["values"])


def small(rows: DataFrame) -> DataFrame:
    """Rows that meet a large table: computed once and broadcast if they are few,
    so that the table is not moved; as they are where no folder is shared."""
    if rows.isStreaming or shared_folder(rows.sparkSession) is None:
        return rows
    return few_rows(kept(rows))[0]


def files_key(frame: DataFrame) -> str:
    """A short name of the files that a frame is read from, which changes with them."""
    spark, said = frame.sparkSession, []
    for path in sorted(frame.inputFiles()):
        store, target = store_of(spark, path)
        status = store.getFileStatus(target)
        said.append(f"{path} {status.getLen()} {status.getModificationTime()}")
    return hashlib.md5("\n".join(said).encode()).hexdigest()[:16]


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Corpus chunks from JSON arrays, or from a folder of Parquet."""
    store, target = store_of(spark, path)
    if store.exists(target) and store.getFileStatus(target).isDirectory():
        return spark.read.parquet(path)
    return spark.read.schema(CHUNK_SCHEMA).option("multiLine", True).json(path)


def read_questions(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Questions of a JSON array with their place in it, the column ordinal.
    A missing file is an error, or no questions with `missing_ok`."""
    if not exists(spark, path):
        if not missing_ok:
            raise FileNotFoundError(f"no question file at {path}")
        return spark.createDataFrame([], QUESTION_SCHEMA).withColumn("ordinal", F.lit(0).cast("long"))
    whole = spark.read.text(path, wholetext=True)
    item = T.ArrayType(QUESTION_SCHEMA)
    rows = whole.select(F.posexplode(F.from_json("value", item)).alias("ordinal", "q"))
    return rows.select("q.*", F.col("ordinal").cast("long").alias("ordinal"))


def write_corpus(docs: DataFrame, path: str) -> None:
    """A combined corpus; an empty one is an error."""
    if docs.isEmpty():
        raise ValueError("the combined corpus is empty")
    docs.write.mode("overwrite").parquet(path)


def append_results(results: DataFrame, path: str) -> None:
    """Results are only ever appended; a resumed run skips what is there."""
    results.write.mode("append").parquet(path)


CHECKPOINT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("script_name", T.StringType()),
        T.StructField("dataset_name", T.StringType()),
        T.StructField("total_questions", T.LongType()),
        T.StructField("processed_questions", T.LongType()),
        T.StructField("correct_count", T.LongType()),
        T.StructField("total_count", T.LongType()),
        T.StructField("elapsed_time", T.DoubleType()),
        T.StructField("config", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error_message", T.StringType()),
        T.StructField("unreadable", T.StringType()),
    ]
)


def checkpoint_path(folder: str, script: str) -> str:
    return f"{folder}/checkpoint_{script}.json"


def write_checkpoint(spark: SparkSession, folder: str, script: str, **values) -> None:
    """How far a run is; the state before stays as a backup."""
    path = checkpoint_path(folder, script)
    before = get_text(spark, path)
    if before is not None:
        put_text(spark, checkpoint_path(folder, f"{script}.backup"), before)
    values = {"script_name": script, "timestamp": datetime.now().isoformat()} | values
    config = {k: str(v) for k, v in values.pop("config", {}).items()}
    put_text(spark, path, json.dumps(values | {"config": config}))


def clear_checkpoint(spark: SparkSession, folder: str, script: str) -> None:
    for path in (checkpoint_path(folder, script), checkpoint_path(folder, f"{script}.backup")):
        remove(spark, path)


def read_checkpoints(spark: SparkSession, folder: str, scripts: Sequence[str]) -> DataFrame:
    """The checkpoints and backups of scripts, with `file`; unreadable files are left out."""
    paths = [p for s in scripts for p in (checkpoint_path(folder, s), checkpoint_path(folder, f"{s}.backup")) if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], CHECKPOINT_SCHEMA).withColumn("file", F.lit("")).drop("unreadable")
    options = {"multiLine": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable"}
    # Files are few and small; they are kept apart from their parse, whose corrupt column cannot be asked for alone.
    rows = spark.read.schema(CHECKPOINT_SCHEMA).options(**options).json(paths).withColumn("file", F.input_file_name())
    return rows.where("unreadable is null and script_name is not null").drop("unreadable")


def summary_text(run: str, status: str, config: Mapping[str, object], sections: Mapping[str, Mapping[str, object]]) -> str:
    stamp = datetime.now().isoformat(timespec="seconds")
    lines = [f"Run: {run}", f"Status: {status}", f"Updated: {stamp}", "", "Configuration:", *(f"  {k}: {v}" for k, v in config.items())]
    for name, row in sections.items():
        shown = ((k, f"{v:.4f}" if isinstance(v, float) else v) for k, v in row.items())
        lines += ["", f"{name}:", *(f"  {k}: {v}" for k, v in shown)]
    return "\n".join(lines) + "\n"


class RunFiles:
    """The results of one run as JSON and text beside each other: the state so
    far while it goes on, replaced by the final one."""

    def __init__(self, spark: SparkSession, folder: str, run: str, config: Mapping[str, object]):
        self.spark, self.run, self.config = spark, run, dict(config)
        self.folder = folder
        self.name = re.sub(r"[^a-z0-9]+", "_", run.lower()).strip("_")

    def paths(self, status: str) -> tuple[str, str]:
        kind = "live" if status == "running" else "final"
        return f"{self.folder}/{self.name}_{kind}.json", f"{self.folder}/{self.name}_{kind}.txt"

    def write(self, sections: Mapping[str, Mapping[str, object]], status: str) -> str:
        text = summary_text(self.run, status, self.config, sections)
        body = {"run": self.run, "status": status, "updated_at": datetime.now().isoformat(), "config": self.config, **sections}
        for path, content in zip(self.paths(status), (json.dumps(body, default=str, indent=1), text)):
            put_text(self.spark, path, content)
        return text

    def live(self, stage: Mapping[str, object], **sections: Mapping[str, object]) -> str:
        return self.write({"current_stage": stage, **sections}, "running")

    def final(self, sections: Mapping[str, Mapping[str, object]]) -> str:
        text = self.write(sections, "completed")
        for path in self.paths("running"):
            remove(self.spark, path)
        return text


def write_summary(spark: SparkSession, path: str, run: str, sections: dict[str, DataFrame], config: dict[str, str]) -> str:
    """A run's one-row results as JSON and text beside each other; returns the
    text.  Each section is a frame of one row."""
    values = {name: frame.first().asDict(recursive=True) for name, frame in sections.items()}
    text = summary_text(run, "completed", config, values)
    put_text(spark, f"{path}/json", json.dumps({"run": run, "updated_at": datetime.now().isoformat(), "config": config, **values}, default=str))
    put_text(spark, f"{path}/txt", text)
    return text
