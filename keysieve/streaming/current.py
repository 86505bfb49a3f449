"""Newest findings per file in Spark's own keyed state, which closed files leave."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keysieve.catalog import Catalog, default_catalog
from keysieve.functions.paths import is_confined, is_supported
from keysieve.functions.text import redact
from keysieve.operators.detect import annotate_spans

_LEAST = -(1 << 63)
_NARROW = "workspace string, path string, at bigint, seq bigint, is_open boolean, findings string"
# Where a file stands, and nothing of what was found in it.
_STATE = "at bigint, seq bigint, is_open boolean"


def _last_of_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One event per file and Arrow batch: a file that is saved all the time does not move all its saves."""
    for batch in batches:
        yield batch.sort_values(["at", "seq"], kind="stable").drop_duplicates(["workspace", "path"], keep="last")


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        # Closed, and whatever is older than its close comes too late to be read.
        state.remove()
        return
    known = state.get if state.exists else None
    newest = None
    for batch in batches:
        row = batch.sort_values(["at", "seq"], kind="stable").iloc[-1]
        position = (int(row["at"]), int(row["seq"]))
        if (known is None or position > tuple(known[:2])) and (newest is None or position > newest[0]):
            newest = position, bool(row["is_open"]), row["findings"]
    if newest is not None:
        known = (*newest[0], newest[1])
        state.update(known)
        (at, seq), is_open, findings = newest
        yield pd.DataFrame(
            {"workspace": [key[0]], "path": [key[1]], "at": [at], "seq": [seq], "is_open": [is_open], "findings": [findings]}
        )
    if known is not None and not known[2]:
        state.setTimeoutTimestamp(max(known[0] // 1000, state.getCurrentWatermarkMs() + 1))


def current_findings(saves: DataFrame, delay: str, catalog: Catalog | None = None) -> DataFrame:
    """Changed files of each micro-batch, for update mode: ``workspace, path, ts, seq, is_open, findings``.

    ``findings`` are structs of rule, place and redacted value, empty for a
    closed file. The newest (ts, seq) of a file wins; a null ts counts
    as the beginning of 1970, a null seq as the smallest. Events may be late by ``delay``: a closed file stays in
    the state for so long, then leaves it, and events older than that are not
    read. :class:`CurrentSnapshots` takes events of any age and keeps closed
    files for good.
    """
    path = F.col("path")
    usable = saves.filter(is_confined(path) & is_supported(path))
    is_open = F.coalesce(F.col("kind") != "close", F.lit(True))
    opened = usable.withColumns({"is_open": is_open, "text": F.when(is_open, F.coalesce("text", F.lit(""))).otherwise(F.lit(""))})

    def shown(span):
        kept = {n: span.getField(n) for n in ("rule_order", "start", "end")} | {"redacted": redact(span.getField("value"))}
        return F.struct(*[c.alias(n) for n, c in kept.items()])

    spans = annotate_spans(opened, catalog or default_catalog())
    narrow = spans.select(
        "workspace", "path", F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("at"), F.coalesce(F.col("seq").cast("bigint"), F.lit(_LEAST)).alias("seq"),
        "is_open", F.to_json(F.transform("spans", shown)).alias("findings"),
    )
    events = narrow.mapInPandas(_last_of_each, _NARROW).withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", delay)
    followed = events.groupBy("workspace", "path").applyInPandasWithState(
        _follow, _NARROW, _STATE, "update", GroupStateTimeout.EventTimeTimeout
    )
    return followed.select(
        "workspace", "path", F.timestamp_micros("at").alias("ts"), F.nullif("seq", F.lit(_LEAST)).alias("seq"), "is_open",
        F.from_json("findings", "array<struct<rule_order: int, start: int, end: int, redacted: string>>").alias("findings"),
    )
