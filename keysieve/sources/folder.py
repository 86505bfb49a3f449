"""Folders of source files as a Spark data source, names that begin with ``.`` or ``_`` included.

    register_folders(spark)
    files = spark.read.format("source_files").load(folder)   # path, size, text, reason

Tasks are planned by the files' bytes, so a large file does not share its task
with others, and many small ones do. A file's text is one row; text is
whatever the file's UTF-8 bytes say, invalid ones as U+FFFD. A file that is
gone by the time it is read keeps its row, with null text and a reason. The
driver lists names and sizes, as Spark's own file sources do, and no contents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size bigint, text string, reason string"
TASK_BYTES = 64 << 20
# What opening a file costs, in bytes: a task does not get any number of empty files.
OPEN_BYTES = 64 << 10
# Rows are handed on after so many bytes of text.
BATCH_BYTES = 16 << 20


@dataclass
class FileGroup(InputPartition):
    files: tuple[tuple[str, int], ...]


def grouped(files: Iterable[tuple[str, int]], limit: int) -> list[FileGroup]:
    """Files as groups of at most ``limit`` bytes; a file of that size or more is a group of its own."""
    groups, group, total = [], [], 0
    for name, size in files:
        cost = size + OPEN_BYTES
        if cost >= limit:
            groups.append(FileGroup(((name, size),)))
            continue
        if total + cost > limit:
            groups.append(FileGroup(tuple(group)))
            group, total = [], 0
        group.append((name, size))
        total += cost
    if group:
        groups.append(FileGroup(tuple(group)))
    return groups


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"path": pa.string(), "size": pa.int64(), "text": pa.string(), "reason": pa.string()}
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types.values(), strict=True)]
    return pa.record_batch(columns, names=list(types))


class _FolderReader(DataSourceReader):
    def __init__(self, root: str, limit: int) -> None:
        self._root = root
        self._limit = limit

    def _opened(self):
        from pyarrow import fs

        # A path or a URI that pyarrow knows; Spark's own local URIs may have one slash.
        root = self._root if not self._root.startswith("file:/") else "file:///" + self._root[5:].lstrip("/")
        return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)

    def partitions(self) -> list[FileGroup]:
        from pyarrow import fs

        system, root = self._opened()
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File)
        # Without files there is still one, empty, task.
        return grouped(names, self._limit) or [FileGroup(())]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        system, root = self._opened()
        rows: list[tuple] = []
        held = 0
        for name, size in partition.files:
            text, reason = None, None
            try:
                with system.open_input_stream(name) as stream:
                    text = stream.read().decode("utf-8", errors="replace")
            except (OSError, pa.ArrowException) as error:
                # Gone or closed to us since the folder was listed.
                reason = type(error).__name__
            rows.append((name[len(root.rstrip("/")) + 1 :], size, text, reason))
            held += len(text or "")
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


class SourceFiles(DataSource):
    """``spark.read.format("source_files").option("taskBytes", n).load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        root = self.options.get("path")
        if not root:
            raise ValueError("source_files needs the path of a folder")
        limit = int(self.options.get("taskBytes", TASK_BYTES))
        if limit < 1:
            raise ValueError("taskBytes must be positive")
        return _FolderReader(root, limit)


def register_folders(spark: SparkSession) -> None:
    spark.dataSource.register(SourceFiles)


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _FolderReader(root, 1)._opened()
        base = base.rstrip("/")
        # Beside the folder: what a lost task leaves here is not among its files.
        parts = f"{base}.parts"
        system.create_dir(parts, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                folder, _, name = f"{base}/{row['path']}".rpartition("/")
                system.create_dir(folder, recursive=True)
                # Moved into place when whole: no half file ever stands under the name.
                part = f"{parts}/{uuid.uuid4().hex}"
                with system.open_output_stream(part) as stream:
                    stream.write((row["text"] or "").encode())
                system.move(part, f"{folder}/{name}")
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["files"])

    return write


def write_folder(files: DataFrame, root: str) -> int:
    """Write ``files(path, text)`` as files below ``root``; null text is an empty file. Paths must be unique."""
    done = files.select("path", "text").mapInArrow(_writer(root), "files bigint")
    return done.agg({"files": "sum"}).first()[0] or 0
