"""Counters over scans. One pass over the files, one small shuffle of partial sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.catalog import PROVIDERS, SEVERITIES, Catalog, default_catalog
from keysieve.operators.detect import annotate_places, annotate_spans, describe


def score(open_findings: Column) -> Column:
    """Fixed formula: 20 points off per open finding, never below zero."""
    return F.greatest(F.lit(0), F.lit(100) - F.lit(20) * open_findings).cast("bigint")


def for_every_scan(stats: DataFrame, scans: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """``stats`` with a row for each of ``scans``, also for those in which no file was scanned."""
    if scans is None:
        return stats
    counters = [c for c in stats.columns if c not in (*by, "score")]
    joined = scans.select(*by).distinct().join(stats, list(by), "left")
    return joined.fillna(0, counters).fillna(100, ["score"])


def scan_stats(files: DataFrame, by: Sequence[str] = ("repo",), catalog: Catalog | None = None, scans: DataFrame | None = None) -> DataFrame:
    """``open, scanned, score`` per scan. Files without text count as scanned.

    ``scans`` names all scans; one without files gets 0, 0 and 100.
    """
    return for_every_scan(
        annotate_spans(files, catalog)
        .groupBy(*by)
        .agg(F.sum(F.size("spans")).cast("bigint").alias("open"), F.count(F.lit(1)).alias("scanned"))
        .select(*by, "open", "scanned", score(F.col("open")).alias("score")),
        scans,
        by,
    )


def scan_summary(files: DataFrame, by: Sequence[str] = ("repo",), catalog: Catalog | None = None, scans: DataFrame | None = None) -> DataFrame:
    """``scan_stats`` plus zero-filled counts per severity and provider, as wide columns."""
    catalog = catalog or default_catalog()
    rows = annotate_spans(files, catalog).select(*by, F.posexplode_outer("spans").alias("ordinal", "span"))
    order = F.col("span.rule_order")
    tagged = rows.select(
        *by,
        "ordinal",
        catalog.attribute("severity", order).alias("severity"),
        catalog.attribute("provider", order).alias("provider"),
    )
    # A file's findings share one file: count it at its first (or missing) finding.
    return for_every_scan(
        tagged.groupBy(*by)
        .agg(
            F.count("ordinal").alias("open"),
            F.count_if(F.coalesce(F.col("ordinal"), F.lit(0)) == 0).alias("scanned"),
            *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES],
            *[F.count_if(F.col("provider") == p).alias(p) for p in PROVIDERS],
        )
        .withColumn("score", score(F.col("open"))),
        scans,
        by,
    )


def finding_cube(described: DataFrame) -> DataFrame:
    """Findings per repository, per provider and severity, and in all: one pass over described findings.

    ``all`` stands for a column that a row does not divide by, and ``grouped_by``
    names those it does; null stays the key of findings without a value.
    """
    names = ("repo", "provider", "severity")
    flags = [F.grouping(n).alias(f"__{n}") for n in names]
    cube = described.groupingSets([["repo"], ["provider", "severity"], []], *names).agg(F.count(F.lit(1)).alias("findings"), *flags)
    shown = [F.when(F.col(f"__{n}") == 1, F.lit("all")).otherwise(F.col(n)).alias(n) for n in names]
    by = F.concat_ws(",", *[F.when(F.col(f"__{n}") == 0, F.lit(n)) for n in names])
    return cube.select(*shown, by.alias("grouped_by"), "findings")


def _unpivot(summary: DataFrame, by: Sequence[str], names: Sequence[str], label: str) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(n).alias(label), F.col(n).alias("findings")) for n in names])
    return summary.select(*by, F.inline(entries))


def by_severity(summary: DataFrame, by: Sequence[str] = ("repo",)) -> DataFrame:
    """Three rows per scan, zeros included."""
    return _unpivot(summary, by, SEVERITIES, "severity")


def by_provider(summary: DataFrame, by: Sequence[str] = ("repo",)) -> DataFrame:
    """Eight rows per scan, zeros included."""
    return _unpivot(summary, by, PROVIDERS, "provider")


NOTHING_OPEN = "Nothing is open, so there is no finding to show."


def insight_report(
    files: DataFrame, history: DataFrame, by: Sequence[str] = ("repo",), catalog: Catalog | None = None, scans: DataFrame | None = None
) -> DataFrame:
    """Counters of the latest scan beside the history's totals and the first finding.

    ``history`` has one row per group with ``found`` and ``fixed``. ``scans``
    names groups (columns ``by``) that have a report even without files.
    """
    catalog = catalog or default_catalog()
    placed = annotate_places(annotate_spans(files, catalog))
    first = F.get("spans", F.lit(0))
    place = F.get("places", F.lit(0))
    counted = (
        placed.select(
            *by,
            F.size("spans").alias("n"),
            F.when(
                F.size("spans") > 0,
                F.struct(
                    "path",
                    place["line"].alias("line"),
                    place["character"].alias("character"),
                    first["rule_order"].alias("rule_order"),
                    first["value"].alias("value"),
                ),
            ).alias("first"),
        )
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("scanned"),
            F.sum("n").cast("bigint").alias("open"),
            F.min_by("first", F.col("first.path")).alias("first"),
        )
        .select(*by, "scanned", "open", "first.*")
    )
    described = describe(counted, catalog)
    if scans is not None:
        described = scans.select(*by).distinct().join(described, list(by), "left").fillna(0, ["scanned", "open"])
    none = F.lit("none")
    return described.join(history, list(by), "left").select(
        *by,
        "scanned",
        "open",
        F.coalesce("found", F.lit(0)).cast("bigint").alias("found"),
        F.coalesce("fixed", F.lit(0)).cast("bigint").alias("fixed"),
        score(F.col("open")).alias("score"),
        F.coalesce("message", F.lit(NOTHING_OPEN)).alias("first_issue"),
        F.coalesce(
            F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("character").cast("string")), none
        ).alias("first_location"),
        F.coalesce(F.concat("secret_type", F.lit(" ("), "severity", F.lit(")")), none).alias("first_type"),
    )


def dashboard(summary: DataFrame, history: DataFrame, by: Sequence[str] = ("repo",)) -> DataFrame:
    """One row per group: totals plus severity and provider counts as maps."""

    def as_map(names: Sequence[str]) -> Column:
        return F.create_map(*[item for n in names for item in (F.lit(n), F.col(n))])

    return summary.join(history, list(by), "left").select(
        *by,
        "score",
        F.coalesce("found", F.lit(0)).cast("bigint").alias("found"),
        F.coalesce("fixed", F.lit(0)).cast("bigint").alias("fixed"),
        "open",
        as_map(SEVERITIES).alias("by_severity"),
        as_map(PROVIDERS).alias("by_provider"),
    )
