"""Reading loosely shaped JSON through VARIANT, keeping JSON types apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _field(parsed: Column, name: str) -> Column:
    return F.try_variant_get(parsed, f"$.{name}", "variant")


def _is_number(value: Column) -> Column:
    return F.rlike(_kind(value), F.lit(r"^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"))


def with_object(rows: DataFrame, content: str, name: str) -> DataFrame:
    """Add ``name``: the whole text as JSON, else the stretch from its first ``{`` to its last ``}``.

    Null when neither parses, or when the value is null, false, zero or "".
    Each stage is a column of its own, so no text is parsed twice.
    """
    kept = rows.columns
    stretch = F.nullif(F.regexp_extract(F.col(content), r"(?s)\{.*\}", 0), F.lit(""))
    whole = rows.select(*kept, F.try_parse_json(content).alias("__whole"))
    parsed = whole.select(
        *kept,
        F.when(F.col("__whole").isNotNull(), F.col("__whole")).otherwise(F.try_parse_json(stretch)).alias("__json"),
    )
    value = F.col("__json")
    plain = F.try_variant_get(value, "$", "string")
    kind = _kind(value)
    empty = (
        (kind == "VOID")
        | ((kind == "BOOLEAN") & (plain == "false"))
        | ((kind == "STRING") & (plain == ""))
        | (_is_number(value) & (F.try_variant_get(value, "$", "double") == 0))
    )
    return parsed.select(*kept, F.when(~F.coalesce(empty, F.lit(False)), value).alias(name))


def text_at(parsed: Column, name: str) -> Column:
    """The field when it is a JSON string."""
    value = _field(parsed, name)
    return F.when(_kind(value) == "STRING", F.try_variant_get(parsed, f"$.{name}", "string"))


def texts_at(parsed: Column, name: str) -> Column:
    """The field's string items when it is a JSON array; other items are dropped."""
    items = F.try_variant_get(parsed, f"$.{name}", "array<variant>")
    strings = F.filter(items, lambda item: _kind(item) == "STRING")
    return F.transform(strings, lambda item: F.try_variant_get(item, "$", "string"))


def number_at(parsed: Column, name: str) -> Column:
    """The field when it is a JSON number."""
    return F.when(_is_number(_field(parsed, name)), F.try_variant_get(parsed, f"$.{name}", "double"))


def is_list_at(parsed: Column, name: str) -> Column:
    return F.coalesce(F.startswith(_kind(_field(parsed, name)), F.lit("ARRAY")), F.lit(False))
