"""Scan a list of targets against a table of file texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.catalog import Catalog, default_catalog
from keysieve.operators.detect import annotate_places, annotate_spans
from keysieve.operators.summary import score

def scan_manifest(
    targets: DataFrame,
    files: DataFrame,
    keys: Sequence[str] = ("repo", "path"),
    catalog: Catalog | None = None,
    prefilter: bool = False,
) -> DataFrame:
    """Every target with ``readable`` (its text exists), ``spans`` and ``places``.

    Every text is searched where it lies, and only the narrow spans travel to
    the targets. ``prefilter``: keep only the targets' texts first, by a semi
    join that Spark plans from the sizes it knows; right where the targets are
    few and the texts of others many.
    """
    catalog = catalog or default_catalog()
    keys = list(keys)
    texts = files.select(*keys, "text")
    if prefilter:
        texts = texts.join(targets.select(*keys), keys, "left_semi")
    placed = annotate_places(annotate_spans(texts, catalog))
    narrow = placed.select(*keys, F.col("text").isNotNull().alias("readable"), "spans", "places")
    joined = targets.join(narrow, keys, "left")
    return joined.withColumns(
        {
            "readable": F.coalesce("readable", F.lit(False)),
            "spans": F.coalesce("spans", F.array()),
            "places": F.coalesce("places", F.array()),
        }
    )


def manifest_findings(manifest: DataFrame) -> DataFrame:
    """One row per finding of a manifest."""
    kept = [c for c in manifest.columns if c not in ("readable", "spans", "places")]
    rows = manifest.select(*kept, F.posexplode(F.arrays_zip("spans", "places")).alias("ordinal", "item"))
    span, place = F.col("item.spans"), F.col("item.places")
    return rows.select(
        *kept,
        "ordinal",
        *[span[name].alias(name) for name in ("rule_order", "start", "end", "value")],
        place["line"].alias("line"),
        place["character"].alias("character"),
    )


def manifest_stats(manifest: DataFrame, by: Sequence[str] = ("repo",)) -> DataFrame:
    """``open, scanned, score``; unreadable targets count as scanned."""
    return (
        manifest.groupBy(*by)
        .agg(F.sum(F.size("spans")).cast("bigint").alias("open"), F.count(F.lit(1)).alias("scanned"))
        .withColumn("score", score(F.col("open")))
    )
