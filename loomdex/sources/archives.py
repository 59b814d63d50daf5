"""Members of tar and zip archives as rows: `spark.read.format("archive")`.

Options: `path` (several, separated by commas), `suffix` of the members that
are read, and `partitionBytes`.  A zip archive is cut into partitions by its
directory, a tar archive that is not compressed by its headers, so its members
are read in parallel and by offset; a compressed tar archive can only be read
from its start, so it is one partition.  Paths are those that Arrow's file
systems read (local files, HDFS, S3, GCS), on driver and executors alike.

A member that is no file is left out; one that is empty has empty content."""

from __future__ import annotations

import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of the members of a partition, and of a batch of rows.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
SCHEMA = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


def opened(path: str) -> pa.NativeFile:
    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


@dataclass
class Members(InputPartition):
    """Members of one archive: names of a zip archive, (name, offset, size) of a
    tar archive, or all of a compressed one."""

    path: str
    kind: str
    members: list = field(default_factory=list)


def dealt(sized: list[tuple[int, object]], bound: int) -> Iterator[list]:
    """Members one after the other, so many bytes at a time and one at least."""
    held, total = [], 0
    for size, member in sized:
        if held and total + size > bound:
            yield held
            held, total = [], 0
        held.append(member)
        total += size
    if held:
        yield held


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.suffix = options.get("suffix", "")
        self.bound = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def partitions(self) -> list[Members]:
        return [m for path in self.paths for m in self.members_of(path)]

    def members_of(self, path: str) -> Iterator[Members]:
        with opened(path) as file:
            if zipfile.is_zipfile(file):
                file.seek(0)
                with zipfile.ZipFile(file) as archive:
                    found = [(i.file_size, i.filename) for i in archive.infolist() if not i.is_dir() and i.filename.endswith(self.suffix)]
                yield from (Members(path, "zip", some) for some in dealt(found, self.bound))
                return
            file.seek(0)
            try:
                with tarfile.open(fileobj=file, mode="r:") as archive:
                    files = [m for m in archive if m.isreg() and m.name.endswith(self.suffix)]
                found = [(m.size, (m.name, m.offset_data, m.size)) for m in files]
                yield from (Members(path, "tar", some) for some in dealt(found, self.bound))
            except tarfile.ReadError:
                yield Members(path, "stream")

    def contents(self, some: Members) -> Iterator[tuple[str, bytes]]:
        with opened(some.path) as file:
            if some.kind == "zip":
                with zipfile.ZipFile(file) as archive:
                    yield from ((name, archive.read(name)) for name in some.members)
            elif some.kind == "tar":
                for name, offset, size in some.members:
                    file.seek(offset)
                    yield name, file.read(size)
            else:
                with tarfile.open(fileobj=file, mode="r|*") as archive:
                    for m in archive:
                        if m.isreg() and m.name.endswith(self.suffix):
                            yield m.name, archive.extractfile(m).read()

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        rows, total = [], 0
        for name, content in self.contents(partition):
            rows.append((partition.path, name, len(content), content))
            total += len(content)
            if total >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)
                rows, total = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, member string, size long, content binary"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, *paths: str, suffix: str = "", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(archive, member, size, content) of the members of archives."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("path", ",".join(paths)).option("suffix", suffix).option("partitionBytes", partition_bytes).load()


def read_articles(spark: SparkSession, *paths: str, suffix: str = "") -> DataFrame:
    """(id, source, content) of archived articles, content as text."""
    rows = read_archives(spark, *paths, suffix=suffix)
    return rows.select(F.col("member").alias("id"), F.element_at(F.split("archive", "/"), -1).alias("source"), F.decode("content", "UTF-8").alias("content"))
