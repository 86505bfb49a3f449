"""Reading source files and fetched file contents into ``files(path, text)``, with ``repo`` where the source names it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_directory(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` as ``path, text``; invalid bytes become U+FFFD.

    Spark's file sources skip names that start with ``.`` or ``_``. Read those
    (``.env`` is a scanned path) through :func:`load_manifest`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # The file system resolves the root, as it does the files' own paths.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    tail = F.substring(F.col("path"), F.lit(len(whole.rstrip("/")) + 2), F.length("path"))
    return files.select(tail.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


# Rows are handed on after so many bytes of text.
BATCH_BYTES = 16_000_000


def _read_locations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    clients: dict[str, fs.FileSystem] = {}

    def read(location: str) -> str:
        if "://" in location:
            # One client per scheme and host.
            root = "/".join(location.split("/", 3)[:3])
            if root not in clients:
                clients[root] = fs.FileSystem.from_uri(location)[0]
            source, name = clients[root], fs.FileSystem.from_uri(location)[1] if root == "file://" else location.split("://", 1)[1]
        else:
            source, name = clients.setdefault("", fs.LocalFileSystem()), location
        with source.open_input_stream(name) as stream:
            return stream.read().decode("utf-8", errors="replace")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.record_batch([pa.array(c, pa.string()) for c in columns], names=["repo", "path", "text", "reason"])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for one in batch.to_pylist():
            text, reason = None, None
            try:
                text = read(one["location"] or "")
            except (OSError, pa.ArrowException) as error:
                reason = type(error).__name__
            rows.append((one["repo"], one["path"], text, reason))
            size += len(text or "")
            if size >= BATCH_BYTES:
                yield batch_of(rows)
                rows, size = [], 0
    if rows:
        yield batch_of(rows)


def load_manifest(manifest: DataFrame, partitions: int | None = None) -> DataFrame:
    """Read ``manifest(repo, path, location)`` file by file, dot names included.

    Files that are absent, unreadable or no files keep their row with null text
    and a ``reason``. Locations are URIs or paths that every executor can
    reach. The rows are dealt out anew, so that a manifest in one split is not
    read by one task.
    """
    spread = manifest.select("repo", "path", F.col("location").cast("string"))
    spread = spread.repartition(partitions) if partitions else spread.repartition(F.col("location"))
    return spread.mapInArrow(_read_locations, "repo string, path string, text string, reason string")


def _lenient_base64(content: Column) -> Column:
    """Decode as JavaScript's Buffer does: both alphabets, other characters ignored."""
    payload = F.regexp_replace(F.split_part(content, F.lit("="), F.lit(1)), "[^A-Za-z0-9+/_-]", "")
    standard = F.translate(payload, "-_", "+/")
    whole = F.when(F.length(standard) % 4 == 1, F.left(standard, F.length(standard) - 1)).otherwise(standard)
    return F.unbase64(whole)


def decode_contents(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``fetched(..., encoding, content)`` into rows with decoded ``text`` and unreadable rows."""
    has_content = (F.col("encoding") == "base64") & (F.col("content") != "")
    readable = F.coalesce(has_content, F.lit(False))
    text = F.make_valid_utf8(_lenient_base64(F.replace(F.col("content"), F.lit("\n"), F.lit(""))).cast("string"))
    good = fetched.filter(readable).withColumn("text", text).drop("encoding", "content")
    return good, fetched.filter(~readable)
