"""Snapshot documents ``{updatedAt, open, findings[]}`` and the snapshot tables.

A document holds one file's findings, which the file bounds. A workspace's
snapshot is the set of its documents, or, as tables, one row per finding plus
one totals row per workspace: a busy workspace never has to fit in one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.catalog import Catalog, default_catalog
from keysieve.functions.json import is_list_at, number_at, text_at
from keysieve.functions.text import base_name, redact
from keysieve.operators.detect import annotate_places, annotate_spans, explanation, message, with_candidates

FINDING_FIELDS = (
    "provider string, severity string, secretType string, fileName string, filePath string, "
    "line int, character int, message string, explanation string, envVarName string"
)


def snapshot_documents(
    files: DataFrame, updated_at: str, keys: Sequence[str] = ("repo", "path"), catalog: Catalog | None = None, empty: bool = False
) -> DataFrame:
    """One JSON document per file with findings; with ``empty`` one per file. Map-only: no shuffle."""
    catalog = catalog or default_catalog()
    placed = annotate_places(annotate_spans(files if empty else with_candidates(files, catalog), catalog))

    def finding(item):
        span, place = item.getField("spans"), item.getField("places")
        order = span.getField("rule_order")
        return F.struct(
            catalog.attribute("provider", order).alias("provider"),
            catalog.attribute("severity", order).alias("severity"),
            catalog.attribute("secret_type", order).alias("secretType"),
            base_name(F.col("path")).alias("fileName"),
            F.col("path").alias("filePath"),
            place.getField("line").alias("line"),
            place.getField("character").alias("character"),
            message(catalog, order).alias("message"),
            explanation(catalog, order, redact(span.getField("value"))).alias("explanation"),
            catalog.attribute("env_var", order).alias("envVarName"),
        )

    document = F.to_json(
        F.struct(
            F.lit(updated_at).alias("updatedAt"),
            F.size("spans").alias("open"),
            F.transform(F.arrays_zip("spans", "places"), finding).alias("findings"),
        )
    )
    if empty:
        return placed.select(*keys, document.alias("document"))
    # Exploding zero or one document, not filtering: a filter would be pushed
    # below the projections and find the spans a second time.
    return placed.select(*keys, F.explode(F.when(F.size("spans") > 0, F.array(document))).alias("document"))


def parse_snapshots(documents: DataFrame) -> DataFrame:
    """Add ``updated_at, open, findings`` to rows with a ``document`` text.

    Missing or malformed documents read as no findings. ``open`` is any finite
    number, whole or not, and falls back to the number of findings; an
    ``updatedAt`` that is a number other than zero reads as its digits.
    """
    typed = F.from_json("document", f"struct<findings:array<struct<{_typed(FINDING_FIELDS)}>>>")["findings"]
    rows = documents.withColumns({"__parsed": F.try_parse_json("document"), "__typed": typed})
    parsed = F.col("__parsed")
    read = rows.withColumns(
        {
            "updated_at": F.coalesce(F.nullif(text_at(parsed, "updatedAt"), F.lit("")), _number_text(parsed, "updatedAt")),
            "__open": number_at(parsed, "open").cast("double"),
            "findings": F.coalesce(F.when(is_list_at(parsed, "findings"), F.col("__typed")), F.array()),
        }
    )
    return read.select(
        *documents.columns,
        "updated_at",
        F.coalesce("__open", F.size("findings").cast("double")).alias("open"),
        "findings",
    )


def _number_text(parsed: Column, name: str) -> Column:
    return F.when(number_at(parsed, name) != 0, F.try_variant_get(parsed, f"$.{name}", "string"))


def _typed(ddl: str) -> str:
    return ", ".join(":".join(field.split()) for field in ddl.split(", "))


def snapshot_findings(parsed: DataFrame, keys: Sequence[str] = ("repo", "path")) -> DataFrame:
    """One row per finding of parsed snapshots."""
    return parsed.select(*keys, F.inline("findings"))


def write_snapshot(findings: DataFrame, path: str, updated_at: str, by: str = "repo", scans: DataFrame | None = None) -> None:
    """Write snapshot tables as JSON lines: ``findings`` rows and one ``totals`` row per workspace.

    ``scans`` names all workspaces (column ``by``); those without findings get
    a row with ``open`` 0. Plain secret values (column ``value``) are left out.
    """
    findings = findings.drop("value")
    findings.write.mode("overwrite").json(f"{path}/findings")
    saved = findings.sparkSession.read.schema(findings.schema).json(f"{path}/findings")
    totals = saved.groupBy(by).agg(F.count(F.lit(1)).alias("open"))
    if scans is not None:
        totals = scans.select(by).distinct().join(totals, by, "left").fillna(0, ["open"])
    totals.withColumn("updated_at", F.lit(updated_at)).write.mode("overwrite").json(f"{path}/totals")


def read_snapshot(spark: SparkSession, path: str, schema, by: str = "repo") -> tuple[DataFrame, DataFrame]:
    """``(findings, totals)`` of a snapshot written by :func:`write_snapshot` with the same ``by``."""
    totals = spark.read.schema(f"`{by}` string, open bigint, updated_at string").json(f"{path}/totals")
    return spark.read.schema(schema).json(f"{path}/findings"), totals
