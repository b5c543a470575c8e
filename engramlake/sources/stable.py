"""Files as stable snapshots: a Python data source whose tasks look at each file before and after they read it."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, modified_ms long, bytes long, lines long, hash string, stable boolean, reason string"
#: Bytes read at a time.
BLOCK = 1 << 20


def snapshot(path: str, modified_ms: int, opened: Callable = open) -> tuple:
    """One row of SCHEMA. A file whose size or time changes while it is read, or that can't be read, is not stable: it has a reason and no hash. Read in blocks, whatever its size."""
    try:
        before = os.stat(path)
        digest, size, breaks = hashlib.sha256(), 0, 0
        with opened(path, "rb") as f:
            while block := f.read(BLOCK):
                digest.update(block)
                size, breaks = size + len(block), breaks + block.count(b"\n")
        after = os.stat(path)
    except OSError as e:
        return path, modified_ms, None, None, None, False, type(e).__name__
    if (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns) or size != after.st_size:
        return path, before.st_mtime_ns // 1_000_000, None, None, None, False, "changed"
    return path, before.st_mtime_ns // 1_000_000, size, breaks + 1, digest.hexdigest(), True, None


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(None)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.glob, self.each = options["path"], options.get("glob", "*.jsonl"), int(options.get("filesPerTask", 16))

    def partitions(self) -> list[InputPartition]:
        """The files of the folder, the oldest first, some for each task."""
        found = []
        for folder, _, names in os.walk(self.root):
            for name in names:
                path = os.path.join(folder, name)
                if fnmatch(name, self.glob) and not os.path.islink(path):
                    try:
                        found.append((os.stat(path).st_mtime_ns // 1_000_000, path))
                    except OSError:
                        found.append((0, path))  # gone meanwhile: its task says so
        found.sort()
        return [_Files([(p, t) for t, p in found[k : k + self.each]]) for k in range(0, len(found), self.each)] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, modified_ms in partition.files:
            yield snapshot(path, modified_ms)


class StableFiles(DataSource):
    """Format `stable_files`: options path, glob (of names), filesPerTask. The folder must be one that the driver and the executors see under the same path; symbolic links are left out."""

    @classmethod
    def name(cls) -> str:
        return "stable_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def stable_snapshots(spark: SparkSession, path: str, glob: str = "*.jsonl", files_per_task: int = 16) -> DataFrame:
    """A row for each file of a folder, the oldest first: bytes, lines and SHA-256 of those that stayed as they were while they were read, and why the others have none."""
    spark.dataSource.register(StableFiles)
    return spark.read.format("stable_files").option("glob", glob).option("filesPerTask", files_per_task).load(path)
