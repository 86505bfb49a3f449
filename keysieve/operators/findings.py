"""Published shapes of a finding, and the lookup of a finding at a cursor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.catalog import Catalog, default_catalog
from keysieve.functions.text import base_name
from keysieve.operators.detect import annotate_spans, describe, with_candidates


def snapshots(located: DataFrame, keys: Sequence[str] = ("repo",), catalog: Catalog | None = None) -> DataFrame:
    """Redacted finding rows; the secret value itself is left out."""
    return describe(located, catalog).select(
        *keys,
        "provider",
        "severity",
        "secret_type",
        base_name(F.col("path")).alias("file_name"),
        F.col("path").alias("file_path"),
        "line",
        "character",
        "message",
        "explanation",
        "env_var",
    )


def diagnostics(located: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Editor level and code per finding."""
    described = describe(located, catalog)
    level = (
        F.when(F.col("severity") == "critical", F.lit("Error"))
        .when(F.col("severity") == "high", F.lit("Warning"))
        .otherwise(F.lit("Information"))
    )
    return described.select(
        *[c for c in located.columns if c != "value"],
        "message",
        level.alias("level"),
        F.concat(F.lit("hardcoded-"), "provider", F.lit("-secret")).alias("code"),
    )


def finding_at(
    files: DataFrame,
    selections: DataFrame,
    keys: Sequence[str] = ("repo", "path"),
    catalog: Catalog | None = None,
) -> DataFrame:
    """First finding that touches each selection, else the file's first finding.

    Spans stay packed in one array per file, which the file's own size bounds,
    so the join is a plain equi-join and never emits selection-finding pairs.
    ``touches`` tells a hit from the fallback; both are null without findings.
    """
    catalog = catalog or default_catalog()
    packed = annotate_spans(with_candidates(files, catalog), catalog).select(*keys, "spans")
    joined = selections.join(packed, list(keys), "left")
    hit = F.get(
        F.filter(
            "spans",
            lambda s: (s.getField("start") <= F.col("sel_end")) & (s.getField("end") >= F.col("sel_start")),
        ),
        F.lit(0),
    )
    picked = joined.select(*selections.columns, hit.alias("hit"), F.get("spans", F.lit(0)).alias("first"))
    chosen = F.coalesce("hit", "first")
    return picked.select(
        *selections.columns,
        F.when(F.col("first").isNotNull(), F.col("hit").isNotNull()).alias("touches"),
        chosen["rule_order"].alias("rule_order"),
        chosen["start"].alias("start"),
        chosen["end"].alias("end"),
    )


def stored_finding_at(
    findings: DataFrame, selections: DataFrame, keys: Sequence[str] = ("repo", "path"), bin_size: int = 4096
) -> DataFrame:
    """:func:`finding_at` from a table of findings (``ordinal, rule_order, start, end``), without any text.

    Ranges are cut into bins of positions, so that a file with very many
    findings or selections spreads over its bins. Of the findings that meet a
    selection in a bin the first is kept before bins are brought together:
    selections meet findings of their own bins only, and each gives one answer.
    """
    bins = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / bin_size), F.floor(F.greatest(low, high) / bin_size))).alias("__bin")
    answer = F.struct("ordinal", "rule_order", "start", "end")
    asked = selections.select(*keys, "sel_start", "sel_end").distinct()
    spans = findings.select(*keys, answer.alias("hit"), bins("start", "end"))
    met = asked.select("*", bins("sel_start", "sel_end")).join(spans, [*keys, "__bin"])
    touching = met.filter((F.col("hit.start") <= F.col("sel_end")) & (F.col("hit.end") >= F.col("sel_start")))
    hits = touching.groupBy(*keys, "sel_start", "sel_end").agg(F.min("hit").alias("hit"))
    first = findings.groupBy(*keys).agg(F.min(answer).alias("first"))
    picked = selections.join(hits, [*keys, "sel_start", "sel_end"], "left").join(first, list(keys), "left")
    chosen = F.coalesce("hit", "first")
    return picked.select(
        *selections.columns,
        F.when(F.col("first").isNotNull(), F.col("hit").isNotNull()).alias("touches"),
        chosen["rule_order"].alias("rule_order"),
        chosen["start"].alias("start"),
        chosen["end"].alias("end"),
    )


def first_findings(located: DataFrame, by: Sequence[str] = ("repo",)) -> DataFrame:
    """Each group's first finding in (path, start) order."""
    rest = [c for c in located.columns if c not in by]
    return (
        located.groupBy(*by)
        .agg(F.min_by(F.struct(*rest), F.struct("path", "start")).alias("first"))
        .select(*by, *[F.col("first")[c].alias(c) for c in rest])
    )
