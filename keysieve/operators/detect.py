"""Credential span detection as Catalyst expressions: map-only, no shuffle, no UDF.

``files`` is any DataFrame with a ``text`` column; the other columns travel along.

Spark has no function that returns match offsets, so a rule's matches and the
text between them are taken separately (``regexp_extract_all`` and ``split`` on
one pattern) and their lengths summed: offset of match i = lengths of gaps 0..i
plus lengths of matches 0..i-1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.catalog import Catalog, Rule, default_catalog
from keysieve.functions.reuse import built_once
from keysieve.functions.text import cut, fold_emit, let, redact, units

SPAN = "struct<start:int,end:int,rule_order:int,value:string>"
_WORK = "__ks_"


def _spans_of(order: Column, rows: Column) -> Column:
    """Spans of one rule, ascending and disjoint, from its (gap, hit, value) rows."""

    def step(state: dict[str, Column], row: Column) -> tuple[dict[str, Column], Column]:
        hit, value = row.getField("hit"), row.getField("value")
        at = state["pos"] + F.length(row.getField("gap"))
        # The value is looked up inside the match, so a value that repeats the
        # key's name is reported at the key.
        start = at + F.instr(hit, value) - 1
        span = F.struct(
            start.alias("start"),
            (start + F.length(value)).alias("end"),
            order.alias("rule_order"),
            value.alias("value"),
        )
        # A group that took no part in the match, or took nothing, is no finding.
        return {"pos": at + F.length(hit)}, F.when(F.length(value) > 0, F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return fold_emit(rows, {"pos": F.lit(0)}, step, SPAN)


def _yield_to(accepted: Column, order: Column, spans: Column) -> Column:
    """Add one rule's spans to the accepted ones, dropping those that overlap.

    Both inputs are ascending and disjoint, so a single sweep in start order
    suffices: a candidate is held until the next accepted span shows whether
    it starts inside the candidate.
    """
    nothing = F.lit(None).cast(SPAN)

    def keep(*items: Column) -> Column:
        return F.filter(F.array(*items), lambda item: item.isNotNull())

    def step(state: dict[str, Column], item: Column) -> tuple[dict[str, Column], Column]:
        reach, held = state["reach"], state["held"]
        candidate = item.getField("rule_order") == order
        survivor = F.when(candidate | (held.getField("end") <= item.getField("start")), held)
        after = {
            "reach": F.when(candidate, reach).otherwise(item.getField("end")),
            "held": F.when(candidate & (item.getField("start") >= reach), item),
        }
        return after, keep(survivor, F.when(~candidate, item))

    def sweep(both: Column) -> Column:
        start = {"reach": F.lit(0), "held": nothing}
        return fold_emit(both, start, step, SPAN, leftover=lambda state: keep(state["held"]))

    return let(F.sort_array(F.concat(accepted, spans)), sweep)


@built_once
def _candidate(catalog: Catalog) -> Column:
    return catalog.may_match(F.col("text"))


def with_candidates(files: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Only files in which some rule may match; the rest leave right after the scan."""
    return files.filter(_candidate(catalog or default_catalog()))


@built_once
def _span_steps(catalog: Catalog) -> tuple[tuple[Column, ...], ...]:
    """Columns to add in each step of :func:`annotate_spans`."""
    numbered = list(enumerate(catalog.rules, start=1))
    text = F.col("text")

    candidate = F.coalesce(catalog.may_match(text), F.lit(False)).alias(f"{_WORK}may")
    found = tuple(
        F.when(F.col(f"{_WORK}may") & rule.may_match(text), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).alias(f"{_WORK}m{i}")
        for i, rule in numbered
    )
    # The same matcher over the whole text: a value keeps its context, such as lookarounds.
    values = tuple(
        F.when(F.size(f"{_WORK}m{i}") > 0, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.value_group))).alias(f"{_WORK}v{i}")
        for i, rule in numbered
    )
    split = tuple(
        F.when(F.size(f"{_WORK}m{i}") > 0, F.split(text, rule.pattern, -1)).alias(f"{_WORK}g{i}")
        for i, rule in numbered
    )

    def rows_of(i: int, rule: Rule) -> Column:
        gaps, hits = F.col(f"{_WORK}g{i}"), F.col(f"{_WORK}m{i}")
        zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.col(f"{_WORK}v{i}").alias("value"))
        return F.when(gaps.isNotNull(), F.slice(zipped, F.lit(1), F.size(hits)))

    matched = F.filter(
        F.array(*[F.struct(F.lit(i).alias("rule"), rows_of(i, r).alias("rows")) for i, r in numbered]),
        lambda entry: entry.getField("rows").isNotNull(),
    )
    per_rule = F.transform(
        f"{_WORK}rows",
        lambda entry: F.struct(
            entry.getField("rule").alias("rule"),
            _spans_of(entry.getField("rule"), entry.getField("rows")).alias("spans"),
        ),
    )

    # Leading disjoint rules cannot collide: merge them in one go. Every later
    # rule gives way to all spans accepted before it.
    head = 0
    while head < len(numbered) and numbered[head][1].disjoint:
        head += 1

    def of_rules(condition) -> Column:
        return F.filter(f"{_WORK}spans", lambda entry: condition(entry.getField("rule")))

    merged = F.sort_array(
        F.flatten(F.transform(of_rules(lambda r: r <= max(head, 1)), lambda e: e.getField("spans")))
    )
    rest = of_rules(lambda r: r > max(head, 1))
    resolved = F.aggregate(
        F.col(f"{_WORK}rest"),
        F.col(f"{_WORK}merged"),
        lambda accepted, entry: _yield_to(accepted, entry.getField("rule"), entry.getField("spans")),
    )
    return (
        (candidate,),
        found,
        (*[F.col(f"{_WORK}m{i}") for i, _ in numbered], *values, *split),
        (matched.alias(f"{_WORK}rows"),),
        (per_rule.alias(f"{_WORK}spans"),),
        (merged.alias(f"{_WORK}merged"), rest.alias(f"{_WORK}rest")),
        (resolved.alias("spans"),),
    )


def annotate_spans(files: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Add ``spans``: accepted spans of each text in start order (empty, never null).

    Offsets are half-open and count code points. Keeps every input row.
    """
    # One select per step: an expression used several times in the next step
    # stays a column there instead of being evaluated again.
    kept = files.columns
    for step in _span_steps(catalog or default_catalog()):
        files = files.select(*kept, *step)
    return files


_PLACE = "struct<line:int,character:int,offset:int>"


@built_once
def _place_steps(utf16: bool) -> tuple[Column, ...]:
    starts = F.transform("spans", lambda s: s.getField("start")).alias(f"{_WORK}o")
    pieces = cut(F.col("text"), F.col(f"{_WORK}o")).alias(f"{_WORK}p")
    measured = F.transform(
        f"{_WORK}p",
        lambda p: F.struct(
            (F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))).alias("breaks"),
            (F.contains(p, F.lit("\n")) | F.contains(p, F.lit("\r"))).alias("restarts"),
            units(F.substring_index(F.replace(p, F.lit("\r"), F.lit("\n")), "\n", -1), utf16).alias("tail"),
            units(p, utf16).alias("units"),
        ),
    ).alias(f"{_WORK}q")

    def step(state: dict[str, Column], piece: Column) -> tuple[dict[str, Column], Column]:
        line = state["line"] + piece.getField("breaks")
        tail = piece.getField("tail")
        column = F.when(piece.getField("restarts"), tail).otherwise(state["column"] + tail)
        offset = state["offset"] + piece.getField("units")
        place = F.struct(line.alias("line"), (column + 1).alias("character"), offset.alias("offset"))
        return {"line": line, "column": column, "offset": offset}, F.array(place)

    start = {"line": F.lit(1), "column": F.lit(0), "offset": F.lit(0)}
    places = F.coalesce(fold_emit(F.col(f"{_WORK}q"), start, step, _PLACE), F.array())
    return starts, pieces, measured, places.alias("places")


def annotate_places(files: DataFrame, utf16: bool = False) -> DataFrame:
    """Add ``places``, parallel to ``spans``: 1-based line and character of each start.

    A line ends at LF (with or without CR before it); a lone CR restarts the
    character count without starting a line. ``utf16`` counts characters and
    ``offset`` in UTF-16 units instead of code points.
    """
    kept = files.columns
    for step in _place_steps(utf16):
        files = files.select(*kept, step)
    return files


def detect(files: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """One row per finding: input columns without ``text``, plus
    ``ordinal, rule_order, start, end, value``."""
    catalog = catalog or default_catalog()
    kept = [c for c in files.columns if c != "text"]
    spans = annotate_spans(with_candidates(files, catalog), catalog)
    # Exploding an expression, not the bare column, keeps the optimizer from
    # repeating the whole span computation as a "size > 0" filter below.
    rows = spans.select(*kept, F.posexplode(F.arrays_zip("spans")).alias("ordinal", "item"))
    span = F.col("item.spans")
    return rows.select(
        *kept, "ordinal", *[span[name].alias(name) for name in ("rule_order", "start", "end", "value")]
    )


def detect_located(files: DataFrame, catalog: Catalog | None = None, utf16: bool = False) -> DataFrame:
    """Like :func:`detect`, plus ``line, character``; with ``utf16`` all
    offsets and characters count UTF-16 units."""
    catalog = catalog or default_catalog()
    kept = [c for c in files.columns if c != "text"]
    placed = annotate_places(annotate_spans(with_candidates(files, catalog), catalog), utf16)
    rows = placed.select(*kept, F.posexplode(F.arrays_zip("spans", "places")).alias("ordinal", "item"))
    span, place = F.col("item.spans"), F.col("item.places")
    start = place["offset"] if utf16 else span["start"]
    end = start + units(span["value"], True) if utf16 else span["end"]
    return rows.select(
        *kept,
        "ordinal",
        span["rule_order"].alias("rule_order"),
        start.alias("start"),
        end.alias("end"),
        span["value"].alias("value"),
        place["line"].alias("line"),
        place["character"].alias("character"),
    )


@built_once
def _descriptions(catalog: Catalog) -> tuple[Column, ...]:
    order = F.col("rule_order")
    env_var = catalog.attribute("env_var", order)
    hidden = redact(F.col("value"))
    return (
        catalog.attribute("provider", order).alias("provider"),
        catalog.attribute("secret_type", order).alias("secret_type"),
        catalog.attribute("severity", order).alias("severity"),
        env_var.alias("env_var"),
        hidden.alias("redacted"),
        message(catalog, order).alias("message"),
        explanation(catalog, order, hidden).alias("explanation"),
    )


def message(catalog: Catalog, order: Column) -> Column:
    variable = catalog.attribute("env_var", order)
    headline = catalog.attribute("headline", order)
    return F.concat(headline, F.lit(" Read it from process.env."), variable, F.lit(" before you commit."))


def explanation(catalog: Catalog, order: Column, redacted: Column) -> Column:
    return F.concat(catalog.attribute("risk", order), F.lit(" Detected value: "), redacted)


def describe(findings: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Add the rule's attributes and the redacted wording to detected rows."""
    return findings.select("*", *_descriptions(catalog or default_catalog()))
