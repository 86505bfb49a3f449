"""Totals and audit rows that are kept up to date from micro-batches, without going through all files again.

Both keep mergeable state in versions (:class:`MergedTable`): a batch writes
what it changes, and readers merge the last few versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keysieve.catalog import PROVIDERS, SEVERITIES, Catalog, default_catalog
from keysieve.operators.detect import annotate_spans
from keysieve.operators.history import AUDIT_ROWS, audit_events, audit_trail
from keysieve.operators.summary import score
from keysieve.sources.versions import MergedTable
from keysieve.streaming.saves import newest_saves

# Stands for "one open document" among the rule numbers, which begin at 1.
_DOCUMENT = 0


def _newest_documents(rows: DataFrame) -> DataFrame:
    rest = F.struct("ts", "seq", "is_open", "counts")
    newest = rows.groupBy("workspace", "path").agg(F.max_by(rest, F.struct("ts", "seq")).alias("last"))
    return newest.select("workspace", "path", "last.*")


def _summed(rows: DataFrame) -> DataFrame:
    # Zero sums stay: a workspace whose files are all closed keeps its row.
    return rows.groupBy("workspace", "item").agg(F.sum("n").alias("n"))


class RunningTotals:
    """Open documents, findings, score, severities and providers per workspace, by retraction.

    A batch looks up what was last counted for the files it touches, takes that
    off and adds the new counts. Only texts in the batch are searched; state
    holds numbers, no text and no value. The newest (ts, seq) of a file wins,
    so late and repeated saves change nothing. Rows with a null workspace or
    path are files like others.
    """

    _DOCUMENTS = "workspace string, path string, ts timestamp, seq bigint, is_open boolean, counts array<struct<item: int, n: bigint>>"
    _COUNTERS = "workspace string, item int, n bigint"

    def __init__(self, spark: SparkSession, folder: str, catalog: Catalog | None = None, fold_every: int = 16) -> None:
        self._catalog = catalog or default_catalog()
        self._documents = MergedTable(spark, f"{folder}/documents", self._DOCUMENTS, _newest_documents, fold_every)
        self._counters = MergedTable(spark, f"{folder}/counters", self._COUNTERS, _summed, fold_every)

    def _counted(self, saves: DataFrame) -> DataFrame:
        """Newest event per file of a batch, with its findings per rule: at most one entry per rule of the catalog."""
        newest = newest_saves(saves)
        emptied = newest.withColumn("text", F.when(F.col("is_open"), F.col("text")).otherwise(F.lit("")))
        found = annotate_spans(emptied, self._catalog)
        orders = F.transform("spans", lambda span: span.getField("rule_order"))
        rows = found.withColumn("orders", orders)

        def entry(order: Column) -> Column:
            hits = F.size("orders") - F.size(F.array_remove("orders", order))
            return F.struct(order.cast("int").alias("item"), hits.cast("bigint").alias("n"))

        return rows.select("workspace", "path", "ts", "seq", "is_open", F.transform(F.array_distinct("orders"), entry).alias("counts"))

    def update(self, saves: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` function."""
        before = self._documents.before(batch_id)
        self._documents.write(self._counted(saves), batch_id)
        # Structs of one field: never null themselves, so that null keys meet.
        key = {n: F.struct(F.col(n).alias("key")) for n in ("workspace", "path")}
        new = self._documents.changes(batch_id).withColumns(key)
        last = F.struct("ts", "seq").alias("last_at"), F.col("is_open").alias("was_open"), F.col("counts").alias("last_counts")
        old = before.withColumns(key).select("workspace", "path", *last)
        both = new.join(old, ["workspace", "path"], "left")
        # The saves may be read again with other results only if their source has changed; equal positions are the same save.
        is_newer = F.col("last_at").isNull() | (F.struct("ts", "seq") > F.col("last_at"))

        def signed(counts: str, is_open: str, sign: int) -> Column:
            entries = F.transform(counts, lambda c: F.struct(c["item"].alias("item"), (c["n"] * sign).alias("n")))
            document = F.struct(F.lit(_DOCUMENT).alias("item"), (F.col(is_open).cast("bigint") * sign).alias("n"))
            return F.coalesce(F.concat(entries, F.array(document)), F.array().cast("array<struct<item: int, n: bigint>>"))

        changes = F.concat(signed("counts", "is_open", 1), signed("last_counts", "was_open", -1))
        rows = both.select(F.col("workspace.key").alias("workspace"), F.explode(F.when(is_newer, changes)).alias("change"))
        self._counters.write(_summed(rows.select("workspace", "change.*")), batch_id)

    def totals(self) -> DataFrame:
        """``workspace, documents, open, score`` and zero-filled counts per severity and provider, as last published."""
        item = F.col("item")
        is_rule = item != _DOCUMENT
        severity, provider = (self._catalog.attribute(name, item) for name in ("severity", "provider"))

        def total(condition: Column) -> Column:
            return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

        return (
            self._counters.state()
            .withColumns({"__severity": F.when(is_rule, severity), "__provider": F.when(is_rule, provider)})
            .groupBy("workspace")
            .agg(
                total(~is_rule).alias("documents"),
                total(is_rule).alias("open"),
                *[total(F.col("__severity") == s).alias(s) for s in SEVERITIES],
                *[total(F.col("__provider") == p).alias(p) for p in PROVIDERS],
            )
            .withColumn("score", score(F.col("open")))
        )

    def start(self, saves: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = saves.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


class RunningAudit:
    """The newest audit rows per workspace, kept across micro-batches in any order.

    A batch keeps its own newest rows of each workspace, and the newest of the
    newest are the newest of all: events that come late find their place, and
    state never holds more than ``keep`` rows per workspace and version.
    Repeated events (equal workspace, ts and seq) count once.
    """

    _EVENTS = (
        "workspace string, ts timestamp, seq bigint, kind string, n_open bigint, provider string, severity string, "
        "secret_type string, path string"
    )

    def __init__(self, spark: SparkSession, folder: str, keep: int = AUDIT_ROWS, fold_every: int = 16) -> None:
        self._keep = keep
        self._events = MergedTable(spark, folder, self._EVENTS, self._newest, fold_every)

    def _newest(self, events: DataFrame) -> DataFrame:
        newest = Window.partitionBy("workspace").orderBy(F.desc("ts"), F.desc("seq"))
        once = events.dropDuplicates(["workspace", "ts", "seq"])
        return once.withColumn("__rank", F.row_number().over(newest)).filter(F.col("__rank") <= self._keep).drop("__rank")

    def update(self, events: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` function."""
        typed = [F.col(name).cast(kind).alias(name) for name, kind in (c.split(" ") for c in self._EVENTS.split(", "))]
        self._events.write(self._newest(audit_events(events).select(*typed)), batch_id)

    def trail(self) -> DataFrame:
        """The audit trail as last published."""
        return audit_trail(self._events.state(), self._keep)

    def start(self, events: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
