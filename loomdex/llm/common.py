"""Helpers shared by the training-data operators: shared scratch tables, table
reading and Arrow batch plumbing."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Masters whose tasks run in the driver's process.
LOCAL_MASTER = re.compile(r"local(\[[^\]]*\])?")
#: Files of a scratch table for each core, and bytes of its input for each file; the greater number is the limit.
FILES_PER_CORE, FILE_BYTES = 2, 32 << 20
#: Keys that can be hot, the least rows of one, and the partitions its rows are dealt to.
HOT_KEYS, HOT_ROWS, SALTS = 512, 10_000, 64
#: Bytes of text that are handled at a time.
GROUP_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  The session's own setting
    is used; a local one is made only where none is set and all tasks run in
    this process, as in tests."""
    set_dir = spark.conf.get(CHECKPOINT_KEY, None)
    if set_dir:
        return set_dir.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not LOCAL_MASTER.fullmatch(spark.sparkContext.master):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="loomdex-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: The scratch folders made inside `scratch_scope`.
_SCOPE: ContextVar[list[Scratch] | None] = ContextVar("scratch_scope", default=None)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """On leaving, every scratch folder made inside is deleted; what was made
    of its tables must have been written by then."""
    made: list[Scratch] = []
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for scratch in made:
            scratch.close()


def bytes_read(frame: DataFrame) -> int:
    """The size of the files that a frame is made of; what has no known size counts as nothing."""
    leaves = frame._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < 1 << 60)


class Scratch:
    """Tables written under the shared folder, to cut lineage and to be read
    more than once.  A table survives lost executors; `drop` frees its space
    when every reader has itself been written."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loomdex-{label}-{uuid.uuid4().hex}"
        self._count = 0
        self._there: set[str] = set()
        if (made := _SCOPE.get()) is not None:
            made.append(self)

    def write(self, frame: DataFrame, name: str = "t") -> DataFrame:
        """The frame as a table.  Many small files cost more to make, list and
        open than they hold, so there are no more than a few for each core, or
        one for each FILE_BYTES that are read for it, if that is more."""
        self._count += 1
        path = f"{self.root}/{self._count:03d}_{name}"
        cores = self.spark.sparkContext.defaultParallelism
        frame.coalesce(max(FILES_PER_CORE * cores, -(-bytes_read(frame) // FILE_BYTES))).write.parquet(path)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        kept._loomdex_path = path
        self._there.add(path)
        return kept

    def _delete(self, path: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._delete(frame._loomdex_path)
            self._there.discard(frame._loomdex_path)

    def drop_all_but(self, *frames: DataFrame) -> None:
        kept = {frame._loomdex_path for frame in frames if hasattr(frame, "_loomdex_path")}
        for path in self._there - kept:
            self._delete(path)
        self._there &= kept

    def close(self) -> None:
        self._delete(self.root)
        self._there.clear()


def key_limit(share: float) -> int:
    """The hash below which about this share of all 64-bit hashes lies."""
    return min(2**63 - 1, int((2 * share - 1) * 2**63))


def hot_join(rows: DataFrame, keys: DataFrame, key: str, times: str, spread: Column) -> DataFrame:
    """rows joined with keys (key, times, …), which has one row for each key
    and about how many rows hold it.  A key with a HOT_KEYS-th of all that are
    counted is hot; there are HOT_KEYS of them at most, so those are broadcast
    to mark their rows, which `spread` deals to SALTS partitions."""
    total = keys.agg(F.sum(times)).first()[0] or 0
    hot = F.col(times) >= F.lit(max(HOT_ROWS, -(-total // HOT_KEYS)))
    marks = keys.where(hot).select(key, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread, F.lit(5)), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    left = rows.join(F.broadcast(marks), key, "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(keys.withColumn("_salt", F.explode(every)), [key, "_salt"]).drop("_salt")


def give_back() -> None:
    """Returns unused memory to the system at the end of a task, as a worker
    that waits for other work should be small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def parts(batch: pa.RecordBatch, column: int | str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about so many bytes of a text column; a row is never cut."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def slices(batches: Iterable[pa.RecordBatch], column: int | str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """All batches in such slices.  Gives memory back after the last one."""
    for batch in batches:
        yield from parts(batch, column, size)
    give_back()


def texts_of(batch: pa.RecordBatch, column: int | str) -> list[str]:
    """A text column; a null text counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def map_rows(
    frame: DataFrame,
    make: Callable[[], Callable[[list[str]], Iterable[tuple]]],
    schema: pa.Schema,
    ddl: str,
    keep: list[str],
    text: str = "text",
    size: int = GROUP_BYTES,
) -> DataFrame:
    """Applies a function of a list of texts, made once per task by `make`, and
    returns the columns in `keep` followed by the fields of the returned
    tuples.  Texts are taken in groups of bounded size.  If the function has an
    attribute `done`, that is called at the end of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for part in slices(batches, text, size):
            rows = list(score(texts_of(part, text)))
            made = [pa.array([r[i] for r in rows], type=schema.field(i).type) for i in range(len(schema))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=keep + schema.names)
        getattr(score, "done", lambda: None)()
        del score
        give_back()

    kept_ddl = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keep)
    return frame.select(*dict.fromkeys([*keep, text])).mapInArrow(run, f"{kept_ddl}, {ddl}")


def filter_rows(frame: DataFrame, make: Callable[[], Callable[[list[str]], Iterable[bool]]], text: str = "text") -> DataFrame:
    """The rows whose text the function, made once per task by `make`, accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = make()
        for part in slices(batches, text, GROUP_BYTES):
            yield part.filter(pa.array([bool(x) for x in accept(texts_of(part, text))]))
        del accept
        give_back()

    return frame.mapInArrow(run, frame.schema)
