"""Found / fixed / open over time, the audit trail and the current view.

``events(workspace, ts, seq, kind, n_open, ...)``: ``kind`` is ``scan`` (with
``n_open`` findings) or ``fix``; order is ``(ts, seq)``.

Running values depend on order, but one workspace may own a large share of all
events, even in one second, so no window spans a workspace or a stretch of
time. Events are range-partitioned by workspace, time and number, and the part
of a workspace in one range is a chunk: windows run inside a chunk, one summary
row per chunk is carried along the workspace, and the carry is joined back.
Ranges are as many as Spark's shuffle partitions and equally full, whatever the
events look like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysieve.functions.text import base_name
from keysieve.sources.shared import written

AUDIT_ROWS = 20  # fixed value: audit rows kept per workspace


def hour_chunk(ts: Column) -> Column:
    """One hour as a chunk: never decreases as ``ts`` grows."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)


def _ranged(events: DataFrame, chunk: Column | None) -> tuple[DataFrame, Column]:
    """``events`` and the chunk of each: by default the number of its range.

    The ranges are written, so that all uses see the same ones.
    """
    if chunk is not None:
        return events, chunk
    ranged = events.repartitionByRange("workspace", "ts", "seq").withColumn("__range", F.spark_partition_id())
    return written(ranged, "event-ranges"), F.col("__range")


def _chunk_key(chunk: Column) -> Column:
    """The chunk as a number that is never null.

    A nullable join key would get a not-null filter on one side of the join
    only, and the two sides could no longer share one shuffle.
    """
    return F.coalesce(chunk.cast("bigint"), F.lit(-(1 << 62)))


def _wrapped(events: DataFrame, *names: str) -> DataFrame:
    """Keys as structs of one field: never null themselves, so that joins keep rows with null keys."""
    return events.withColumns({n: F.struct(F.col(n).alias("key")) for n in names})


def _chunk_rows(events: DataFrame, chunk: Column) -> DataFrame:
    """Per-event values counted from the start of the event's chunk."""
    upto = (
        Window.partitionBy("workspace", "chunk")
        .orderBy("ts", "seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    is_scan = F.col("kind") == "scan"
    base = events.withColumn("chunk", _chunk_key(chunk))
    with_fixes = base.withColumn("rel_fixed", F.count_if(F.col("kind") == "fix").over(upto))
    at_scan = F.when(is_scan, F.struct(F.col("rel_fixed").alias("fixed"), F.col("n_open").cast("bigint").alias("n")))
    return with_fixes.withColumns(
        {
            "rel_scan": F.last(at_scan, ignorenulls=True).over(upto),
            "rel_found": F.max(F.when(is_scan, F.col("rel_fixed") + F.col("n_open"))).over(upto),
        }
    )


def chunk_summaries(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """One row per workspace and chunk: its fixes, its last scan, its peak of fixed + open."""
    events, chunk = _ranged(events, chunk)
    return _summarise(_chunk_rows(events, chunk))


def _summarise(rows: DataFrame) -> DataFrame:
    order = F.struct("ts", "seq")
    return rows.groupBy("workspace", "chunk").agg(
        F.max("rel_fixed").alias("fixes"),
        F.max_by("rel_scan", order).alias("scan"),
        F.max("rel_found").alias("peak"),
    )


def _carry(chunks: DataFrame) -> DataFrame:
    """State of a workspace before each chunk."""
    before = Window.partitionBy("workspace").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    fixed = chunks.withColumn("fixed_before", F.coalesce(F.sum("fixes").over(before), F.lit(0)))
    scan = F.when(
        F.col("scan").isNotNull(),
        F.struct((F.col("fixed_before") + F.col("scan.fixed")).alias("fixed"), F.col("scan.n").alias("n")),
    )
    return fixed.select(
        "workspace",
        "chunk",
        "fixed_before",
        F.last(scan, ignorenulls=True).over(before).alias("scan_before"),
        F.max(F.col("fixed_before") + F.col("peak")).over(before).alias("found_before"),
    )


def _resolve(fixed: Column, scan: Column, peak: Column) -> dict[str, Column]:
    zero = F.lit(0).cast("bigint")
    remaining = F.coalesce(scan["n"], zero) - (fixed - F.coalesce(scan["fixed"], zero))
    return {
        "found": F.coalesce(peak, zero).cast("bigint"),
        "fixed": fixed.cast("bigint"),
        "open": F.greatest(zero, remaining).cast("bigint"),
    }


def running_stats(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Each event with ``found, fixed, open`` as they stand after it."""
    columns = events.columns
    events, chunk = _ranged(events, chunk)
    rows = _chunk_rows(_wrapped(events, "workspace"), chunk)
    carried = rows.join(_carry(_summarise(rows)), ["workspace", "chunk"])
    here = F.when(
        F.col("rel_scan").isNotNull(),
        F.struct((F.col("fixed_before") + F.col("rel_scan.fixed")).alias("fixed"), F.col("rel_scan.n").alias("n")),
    )
    values = _resolve(
        F.col("fixed_before") + F.col("rel_fixed"),
        F.coalesce(here, F.col("scan_before")),
        F.greatest("found_before", F.col("fixed_before") + F.col("rel_found")),
    )
    own = [F.col("workspace.key").alias(c) if c == "workspace" else F.col(c) for c in columns]
    return carried.select(*own, *[c.alias(n) for n, c in values.items()])


def latest_stats(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """``workspace, found, fixed, open`` after the last event."""
    return fold_chunks(chunk_summaries(events, chunk))


def fold_chunks(chunks: DataFrame) -> DataFrame:
    """Combine chunk summaries, in chunk order, into each workspace's end state."""
    before = Window.partitionBy("workspace").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunks.withColumn("fixed_before", F.coalesce(F.sum("fixes").over(before), F.lit(0)))
    scan = F.when(
        F.col("scan").isNotNull(),
        F.struct((F.col("fixed_before") + F.col("scan.fixed")).alias("fixed"), F.col("scan.n").alias("n")),
    )
    ended = placed.groupBy("workspace").agg(
        F.sum("fixes").alias("fixed"),
        F.max_by(scan, F.when(F.col("scan").isNotNull(), F.col("chunk"))).alias("scan"),
        F.max(F.col("fixed_before") + F.col("peak")).alias("peak"),
    )
    values = _resolve(F.col("fixed"), F.col("scan"), F.col("peak"))
    return ended.select("workspace", *[c.alias(n) for n, c in values.items()])


def audit_events(events: DataFrame) -> DataFrame:
    """Events that leave an audit row: fixes, and scans with findings."""
    return events.filter((F.col("kind") == "fix") | ((F.col("kind") == "scan") & (F.col("n_open") > 0)))


def audit_trail(events: DataFrame, keep: int = AUDIT_ROWS) -> DataFrame:
    """Newest audit rows per workspace, ``audit_rank`` 1 being the newest.

    Scans without findings leave no row. ``row_number() <= keep`` runs as a
    group limit before the shuffle as well as after it.
    """
    is_fix = F.col("kind") == "fix"
    n = F.col("n_open")
    noun = F.when(n == 1, F.lit(" open finding")).otherwise(F.lit(" open findings"))
    name = F.coalesce(F.nullif(base_name(F.col("path")), F.lit("")), F.lit("source file"))
    newest = Window.partitionBy("workspace").orderBy(F.desc("ts"), F.desc("seq"))
    return (
        audit_events(events)
        .withColumn("audit_rank", F.row_number().over(newest))
        .filter(F.col("audit_rank") <= keep)
        .select(
            "workspace",
            "audit_rank",
            "ts",
            "seq",
            F.when(is_fix, F.lit("remediation")).otherwise(F.lit("scan")).alias("action"),
            F.when(is_fix, F.col("provider")).alias("provider"),
            F.when(is_fix, F.col("severity")).alias("severity"),
            F.when(is_fix, F.concat(F.lit("Moved "), "secret_type", F.lit(" out of "), name))
            .otherwise(F.concat(n.cast("string"), noun, F.lit(" after scan")))
            .alias("summary"),
        )
    )


def current_documents(document_events: DataFrame) -> DataFrame:
    """Newest state of each (workspace, path); closed documents are gone."""
    rest = [c for c in document_events.columns if c not in ("workspace", "path")]
    newest = document_events.groupBy("workspace", "path").agg(
        F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("last")
    )
    return newest.filter(F.col("last.kind") != "close").select(
        "workspace", "path", *[F.col("last")[c].alias(c) for c in rest]
    )


def current_findings(document_events: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of each open document's newest scan.

    ``findings`` carries ``workspace, path, seq`` of the scan that saw them.
    """
    newest = current_documents(document_events).select("workspace", "path", "seq")
    return findings.join(newest, ["workspace", "path", "seq"], "left_semi")


def workspace_scans(document_events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Turn per-document scans and closes into workspace scan events.

    Each event's ``n_open`` is the total over all documents as they stand after
    it: the running sum of every document's change against its previous count.
    Both the previous count and the running sum are carried between chunks.
    """
    document_events, chunk = _ranged(document_events, chunk)
    count = F.when(F.col("kind") == "close", F.lit(0)).otherwise(F.col("n_open")).cast("bigint")
    base = _wrapped(document_events, "workspace", "path").withColumns({"chunk": _chunk_key(chunk), "count": count})
    order = F.struct("ts", "seq")
    document = ["workspace", "path"]

    in_chunk = Window.partitionBy(*document, "chunk").orderBy("ts", "seq")
    ends = base.groupBy(*document, "chunk").agg(F.max_by("count", order).alias("last_count"))
    earlier = Window.partitionBy(*document).orderBy("chunk")
    ends = ends.select(*document, "chunk", F.lag("last_count", 1, 0).over(earlier).alias("count_before"))
    changed = (
        base.withColumn("previous", F.lag("count").over(in_chunk))
        .join(ends, [*document, "chunk"])
        .withColumn("delta", F.col("count") - F.coalesce("previous", "count_before"))
    )

    upto = (
        Window.partitionBy("workspace", "chunk")
        .orderBy("ts", "seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy("workspace").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # Totals are taken from the windowed rows: both uses then share one shuffle.
    summed = changed.select("workspace", "chunk", "ts", "seq", F.sum("delta").over(upto).alias("rel_open"))
    totals = summed.groupBy("workspace", "chunk").agg(F.max_by("rel_open", order).alias("moved"))
    totals = totals.select("workspace", "chunk", F.coalesce(F.sum("moved").over(before), F.lit(0)).alias("open_before"))
    return summed.join(totals, ["workspace", "chunk"]).select(
        F.col("workspace.key").alias("workspace"),
        "ts",
        "seq",
        F.lit("scan").alias("kind"),
        (F.col("open_before") + F.col("rel_open")).cast("bigint").alias("n_open"),
    )
