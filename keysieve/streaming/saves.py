"""File saves as a stream: scan on save, current findings, running stats, snapshots.

The stateful parts use aggregates that Spark combines before the shuffle, so a
workspace or file that owns a large share of the saves does not land in one
task row by row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keysieve.catalog import Catalog, default_catalog
from keysieve.functions.paths import is_confined, is_supported
from keysieve.operators.detect import annotate_spans, detect_located
from keysieve.operators.history import chunk_summaries, fold_chunks, hour_chunk
from keysieve.operators.targets import normalise_changes
from keysieve.sources.shared import shared_folder
from keysieve.sources.snapshots import snapshot_documents
from keysieve.sources.versions import VersionedTable

SAVE_SCHEMA = "workspace string, path string, ts timestamp, seq bigint, kind string, text string"
EVENT_SCHEMA = "workspace string, ts timestamp, seq bigint, kind string, n_open bigint"


def read_saves(spark: SparkSession, folder: str, schema: str = SAVE_SCHEMA, **options) -> DataFrame:
    """Save events (``kind`` is ``save`` or ``close``) from a folder of parquet files."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def scan_saves(saves: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Findings of each save of a supported, confined path. Stateless, append mode."""
    path = F.col("path")
    return detect_located(saves.filter((F.col("kind") == "save") & is_confined(path) & is_supported(path)), catalog)


def current_spans(saves: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Newest state of each document, for update mode: ``workspace, path, ts, seq, is_open, spans``.

    The newest (ts, seq) wins, so late or repeated saves change nothing. A
    close leaves a row with ``is_open`` false and no spans.
    """
    path = F.col("path")
    usable = saves.filter(is_confined(path) & is_supported(path))
    spans = annotate_spans(usable, catalog or default_catalog())
    state = F.struct(
        "ts",
        "seq",
        (F.col("kind") != "close").alias("is_open"),
        F.when(F.col("kind") != "close", F.col("spans")).otherwise(F.array()).alias("spans"),
    )
    return (
        spans.select("workspace", "path", state.alias("state"))
        .groupBy("workspace", "path")
        .agg(F.max_by("state", F.struct("state.ts", "state.seq")).alias("state"))
        .select("workspace", "path", "state.*")
    )


class RunningStats:
    """found / fixed / open per workspace, kept across micro-batches in any order.

    State is one summary per workspace and hour, folded when it is read. What a
    summary says depends on the order of its hour's events, so events are kept
    as narrow rows by day, and a batch works out anew the hours that it touches
    from all their events, late ones in their place. Repeated events (equal
    workspace, ts and seq) count once. Each batch writes its own version: a
    batch that is run again after a failure replaces itself, and what later
    batches have written does not change what it reads.
    """

    _EVENTS = "workspace string, ts timestamp, seq bigint, kind string, n_open bigint, chunk bigint, batch bigint, day bigint"
    _SUMMARIES = "workspace string, chunk bigint, fixes bigint, scan struct<fixed: bigint, n: bigint>, peak bigint, batch bigint"

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self._spark = spark
        self._folder = folder or f"{shared_folder(spark)}/keysieve/running-stats-{uuid.uuid4().hex}"

    def _version(self, batch_id: int, kind: str) -> str:
        return f"{self._folder}/batch={batch_id:012d}/part={kind}"

    def _written(self, kind: str, schema: str, batch_id: int) -> DataFrame:
        read = self._spark.read.schema(schema).option("basePath", self._folder)
        return read.parquet(f"{self._folder}/batch=*/part={kind}").filter(F.col("batch") <= batch_id)

    def state(self, batch_id: int) -> DataFrame:
        """State after a batch: ``workspace, found, fixed, open``."""
        summaries = self._written("summaries", self._SUMMARIES, batch_id)
        newest = summaries.groupBy("workspace", "chunk").agg(F.max_by(F.struct("fixes", "scan", "peak"), "batch").alias("last"))
        return fold_chunks(newest.select("workspace", "chunk", "last.*"))

    def update(self, events: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` function."""
        chunk = F.coalesce(hour_chunk(F.col("ts")).cast("bigint"), F.lit(-(1 << 40)))
        rows = events.select(
            F.col("workspace").cast("string").alias("workspace"), "ts", F.col("seq").cast("bigint").alias("seq"), "kind",
            F.col("n_open").cast("bigint").alias("n_open"), chunk.alias("chunk"), F.floor(chunk / 24).alias("day"),
        )
        rows.write.mode("overwrite").partitionBy("day").parquet(self._version(batch_id, "events"))
        known = self._written("events", self._EVENTS, batch_id)
        own = known.filter(F.col("batch") == batch_id)
        # The days of one batch: its span of time bounds them, and other days are not read.
        days = [r["day"] for r in own.select("day").distinct().collect()]
        key = [F.struct("workspace").alias("__workspace"), "chunk"]
        touched = own.select(*key).distinct()
        rest = known.filter(F.col("day").isin(days)).select("*", key[0]).join(touched, ["__workspace", "chunk"], "left_semi")
        once = rest.dropDuplicates(["workspace", "ts", "seq"])
        chunk_summaries(once, F.col("chunk")).write.mode("overwrite").parquet(self._version(batch_id, "summaries"))

    def start(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def newest_saves(saves: DataFrame) -> DataFrame:
    """``workspace, path, is_open, text, ts, seq`` of each supported, confined file's newest event in a batch."""
    path = F.col("path")
    usable = saves.filter(is_confined(path) & is_supported(path))
    is_open = F.coalesce(F.col("kind") != "close", F.lit(True)).alias("is_open")
    last = F.max_by(F.struct(is_open, F.coalesce("text", F.lit("")).alias("text"), "ts", "seq"), F.struct("ts", "seq"))
    return usable.groupBy("workspace", "path").agg(last.alias("last")).select("workspace", "path", "last.*")


class CurrentSnapshots:
    """The state that readers see: a snapshot document of every open file, without findings too.

    Each batch writes the newest state of the files it touches, closed ones as
    tombstones, and publishes its number afterwards; until then readers see the
    batch before. The newest (ts, seq) of a file wins, so late saves change
    nothing. Every ``fold_every`` batches all states are folded into one
    version, so that readers never go through more than that many. Documents
    hold redacted text only.
    """

    _STATES = "workspace string, path string, ts timestamp, seq bigint, is_open boolean, document string"

    def __init__(self, spark: SparkSession, folder: str, updated_at: Callable[[int], str] | None = None, catalog: Catalog | None = None, fold_every: int = 16) -> None:
        self._changes = VersionedTable(spark, f"{folder}/changes", self._STATES)
        self._folded = VersionedTable(spark, f"{folder}/folded", self._STATES)
        self._updated_at = updated_at or (lambda _: datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"))
        self._catalog = catalog
        self._every = fold_every

    def update(self, saves: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` function."""
        newest = newest_saves(saves)
        keys = ("workspace", "path", "ts", "seq", "is_open")
        emptied = newest.withColumn("text", F.when(F.col("is_open"), F.col("text")).otherwise(F.lit("")))
        self._changes.write(snapshot_documents(emptied, self._updated_at(batch_id), keys, self._catalog, empty=True), batch_id)
        if (batch_id + 1) % self._every == 0:
            self._folded.write(self._states(batch_id), batch_id)

    def _states(self, batch_id: int) -> DataFrame:
        """Newest state of every file after a batch, tombstones included: they outlive late saves."""
        base = self._folded.newest()
        rows = self._changes.rows(0 if base is None else base + 1, batch_id)
        if base is not None:
            # A batch that runs again may be older than the last fold.
            rows = rows.unionByName(self._folded.rows(base, base))
        newest = rows.groupBy("workspace", "path").agg(F.max_by(F.struct("ts", "seq", "is_open", "document"), F.struct("ts", "seq", "version")).alias("last"))
        return newest.select("workspace", "path", "last.*")

    def documents(self) -> DataFrame:
        """``workspace, path, ts, seq, document`` of all open files as last published."""
        version = self._changes.newest()
        if version is None:
            raise ValueError("no batch has been published yet")
        return self._states(version).filter("is_open").drop("is_open")

    def totals(self) -> DataFrame:
        """``workspace, open, documents``; workspaces whose files are all closed have zero of both."""
        version = self._changes.newest()
        if version is None:
            raise ValueError("no batch has been published yet")
        found = F.when(F.col("is_open"), F.get_json_object("document", "$.open").cast("bigint")).otherwise(F.lit(0))
        return self._states(version).groupBy("workspace").agg(F.sum(found).alias("open"), F.count_if("is_open").alias("documents"))

    def start(self, saves: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = saves.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


class ModifiedSets:
    """Versions of the set of modified files, and saves scanned against the newest one.

    A micro-batch takes the newest version published when it begins; all its
    saves meet that one.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._sets = VersionedTable(spark, folder, "workspace string, path string")

    def replace(self, changes: DataFrame, rename: str = "new") -> int:
        """Publish ``changes(repo, status, path, old_path)`` as the next version."""
        newest = self._sets.newest()
        version = 0 if newest is None else newest + 1
        modified = normalise_changes(changes, rename).select(F.col("repo").alias("workspace"), "path").distinct()
        self._sets.write(modified, version)
        return version

    def members(self, saves: DataFrame) -> DataFrame:
        """Saves of supported, confined files in the newest set; none before there is one."""
        newest = self._sets.newest()
        path = F.col("path")
        usable = saves.filter((F.col("kind") == "save") & is_confined(path) & is_supported(path))
        if newest is None:
            return usable.filter(F.lit(False))
        return usable.join(self._sets.rows(newest, newest).drop("version"), ["workspace", "path"], "left_semi")

    def start(self, saves: DataFrame, folder: str, checkpoint: str, catalog: Catalog | None = None, **trigger) -> StreamingQuery:
        """Write the findings of each micro-batch's members under its batch id, without values."""

        def scan(batch: DataFrame, batch_id: int) -> None:
            found = detect_located(self.members(batch), catalog)
            found.drop("value").write.mode("overwrite").json(f"{folder}/batch={batch_id:012d}")

        writer = saves.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def publish_snapshots(findings: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each micro-batch's findings under its batch id; a repeated batch replaces itself."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.drop("value").write.mode("overwrite").json(f"{folder}/batch={batch_id:012d}")

    writer = findings.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
