"""Remediation: plans per finding and per repository, rewritten sources and config texts.

``config(repo, env_text, example_text, ignore_text)`` holds the three config
files of a repository; missing files read as empty text.

One repository may own a large share of all findings. What is gathered per
repository is one accepted value per variable, which the catalog bounds; the
findings themselves stay rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.catalog import Catalog, default_catalog
from keysieve.functions.text import cut, js_trim, lines, redact
from keysieve.operators.detect import annotate_spans, with_candidates
from keysieve.operators.skew import join_groups

# Config file names and the ignore entry.
ENV_FILE, EXAMPLE_FILE, IGNORE_FILE = ".env", ".env.example", ".gitignore"
IGNORE_ENTRY = ".env"


def config_texts(files: DataFrame, by: str = "repo") -> DataFrame:
    """Gather the three config files of each repository from a files table."""
    named = {"env_text": ENV_FILE, "example_text": EXAMPLE_FILE, "ignore_text": IGNORE_FILE}
    return (
        files.filter(F.col("path").isin(*named.values()))
        .groupBy(by)
        .agg(*[F.max(F.when(F.col("path") == path, F.col("text"))).alias(name) for name, path in named.items()])
    )


def append_line(text: Column, line: Column) -> Column:
    """Add a line unless some line already equals it after trimming."""
    present = F.exists(lines(text), lambda existing: js_trim(existing) == js_trim(line))
    joint = F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), F.lit("\n")).otherwise(F.lit(""))
    return F.when(present, text).otherwise(F.concat(text, joint, line, F.lit("\n")))


def has_conflict(env_text: Column, variable: Column, line: Column) -> Column:
    """Some line sets the variable to something else."""
    return F.exists(
        lines(env_text),
        lambda existing: F.startswith(existing, F.concat(variable, F.lit("=")))
        & (js_trim(existing) != js_trim(line)),
    )


def ignores_env(ignore_text: Column) -> Column:
    return F.exists(lines(ignore_text), lambda existing: js_trim(existing) == F.lit(IGNORE_ENTRY))


def _with_config(findings: DataFrame, config: DataFrame, by: str) -> DataFrame:
    names = ("env_text", "example_text", "ignore_text")
    joined = join_groups(findings, config, by, spread_on=("path", "start"))
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit("")) for n in names})


def _lines_of(catalog: Catalog) -> tuple[Column, Column]:
    variable = catalog.attribute("env_var", F.col("rule_order"))
    return variable, F.concat(variable, F.lit("="), F.col("value"))


def remediation_plans(
    findings: DataFrame, config: DataFrame, by: str = "repo", catalog: Catalog | None = None
) -> DataFrame:
    """Plan of each finding on its own, against the config files as they are."""
    variable, line = _lines_of(catalog or default_catalog())
    rows = _with_config(findings, config, by).withColumns({"variable": variable, "env_line": line})
    variable, line = F.col("variable"), F.col("env_line")
    replacement = F.concat(F.lit("process.env."), variable)
    ignored = ignores_env(F.col("ignore_text"))
    ensured = F.contains(append_line(F.col("env_text"), line), line)
    preview = F.concat_ws(
        "\n",
        F.concat(F.lit("Source: "), F.substring("value", 1, 4), F.lit("... becomes "), replacement),
        F.concat(
            F.lit(f"Update {ENV_FILE}: "),
            F.when(ensured, F.concat(F.lit("make sure "), variable, F.lit(" is set"))).otherwise(F.lit("no change")),
        ),
        F.lit(f"Update {EXAMPLE_FILE}: make sure the variable is listed"),
        F.concat(
            F.lit(f"Update {IGNORE_FILE}: "),
            F.when(ignored, F.lit("already protected")).otherwise(F.lit(f"add {IGNORE_ENTRY}")),
        ),
    )
    conflict = F.when(
        has_conflict(F.col("env_text"), variable, line),
        F.concat(F.lit(f"{ENV_FILE} already has an existing "), variable, F.lit(" with another value.")),
    )
    return rows.select(
        *findings.columns,
        replacement.alias("source_replacement"),
        "env_line",
        F.concat(variable, F.lit("=")).alias("example_line"),
        (~ignored).alias("will_add_ignore"),
        conflict.alias("conflict_reason"),
        preview.alias("preview"),
    )


def repo_plan(
    findings: DataFrame, config: DataFrame, by: str = "repo", catalog: Catalog | None = None
) -> DataFrame:
    """Plan all findings of a repository as if fixed one after the other.

    When the env file sets a variable, a finding is ``accepted`` exactly if its
    line agrees with it; otherwise the variable's first finding in (path,
    start) order decides and others must agree with that. Read twice:
    ``findings`` should be a written table.
    """
    variable, line = _lines_of(catalog or default_catalog())
    rows = findings.withColumns({"variable": variable, "env_line": line})
    first = rows.groupBy(by, "variable").agg(F.min_by("env_line", F.struct("path", "start")).alias("line"))
    # At most one entry per variable of the catalog.
    winners = first.groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.struct("variable", "line"))).alias("winners")
    )
    info = winners.join(config.select(by, "env_text"), by, "left")
    joined = join_groups(rows, info, by, spread_on=("path", "start")).withColumn("env_text", F.coalesce("env_text", F.lit("")))
    variable, line = F.col("variable"), F.col("env_line")
    is_set = F.exists(lines(F.col("env_text")), lambda e: F.startswith(e, F.concat(variable, F.lit("="))))
    agrees = js_trim(line) == js_trim(F.element_at("winners", variable))
    accepted = F.when(is_set, ~has_conflict(F.col("env_text"), variable, line)).otherwise(agrees)
    return joined.select(*findings.columns, "variable", "env_line", accepted.alias("accepted"))


def new_config_texts(plan: DataFrame, config: DataFrame, by: str = "repo") -> DataFrame:
    """Config texts after all accepted findings, for repositories that have any."""
    position = F.struct("path", "start")
    # Accepted lines of one variable agree, so the first stands for all.
    per_variable = (
        plan.filter("accepted")
        .groupBy(by, "variable")
        .agg(F.min(position).alias("at"), F.min_by("env_line", position).alias("line"))
    )
    wanted = per_variable.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", "variable", "line"))).alias("add"))
    rows = wanted.join(config, by, "left").withColumns(
        {n: F.coalesce(F.col(n), F.lit("")) for n in ("env_text", "example_text", "ignore_text")}
    )

    def appended(text: str, line) -> Column:
        return F.aggregate("add", F.col(text), lambda acc, item: append_line(acc, line(item)))

    return rows.select(
        by,
        appended("env_text", lambda item: item.getField("line")).alias("env_text"),
        appended("example_text", lambda item: F.concat(item.getField("variable"), F.lit("="))).alias("example_text"),
        F.when(ignores_env(F.col("ignore_text")), F.col("ignore_text"))
        .otherwise(append_line(F.col("ignore_text"), F.lit(IGNORE_ENTRY)))
        .alias("ignore_text"),
    )


def replace_spans(text: Column, cuts: Column, pieces: Column, replacements: Column) -> Column:
    """Text with every other piece replaced; ``cuts`` are start, end, start, end, ..."""
    kept_and_new = F.flatten(
        F.transform(
            replacements,
            lambda new, i: F.array(F.get(pieces, i * 2), new),
        )
    )
    tail = F.substring(text, F.element_at(cuts, -1) + 1, F.length(text))
    return F.concat(F.array_join(kept_and_new, ""), tail)


def rewrite_sources(
    files: DataFrame,
    plan: DataFrame,
    keys: Sequence[str] = ("repo", "path"),
    keep_quotes: bool = True,
    catalog: Catalog | None = None,
) -> DataFrame:
    """New text of every file with accepted findings: ``process.env`` in place of values.

    ``keep_quotes=False`` also removes the quotes around a value, so that the
    result is an expression and not a string. Only texts in which some rule
    matches take part in the join.
    """
    catalog = catalog or default_catalog()
    keys = list(keys)
    # One file's findings; the file itself bounds them.
    edits = (
        plan.filter("accepted")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "variable"))).alias("edits"))
    )
    hits = with_candidates(files, catalog).select(*keys, "text")
    rows = hits.join(edits, keys)
    if not keep_quotes:
        rows = rows.withColumn("edits", F.transform("edits", lambda e: _outside_quotes(F.col("text"), e)))
    rows = rows.withColumn(
        "cuts", F.flatten(F.transform("edits", lambda e: F.array(e.getField("start"), e.getField("end"))))
    )
    rows = rows.withColumns(
        {
            "pieces": cut(F.col("text"), F.col("cuts")),
            "new": F.transform("edits", lambda e: F.concat(F.lit("process.env."), e.getField("variable"))),
        }
    )
    new_text = replace_spans(F.col("text"), F.col("cuts"), F.col("pieces"), F.col("new"))
    return rows.select(*keys, new_text.alias("text"))


def redact_texts(files: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """``files`` with every found value masked in its ``text``. Map-only; keeps every row."""
    columns = files.columns
    found = annotate_spans(files, catalog)
    cuts = F.flatten(F.transform("spans", lambda s: F.array(s.getField("start"), s.getField("end"))))
    found = found.withColumns({"__cuts": cuts, "__new": F.transform("spans", lambda s: redact(s.getField("value")))})
    found = found.withColumn("__pieces", cut(F.col("text"), F.col("__cuts")))
    masked = replace_spans(F.col("text"), F.col("__cuts"), F.col("__pieces"), F.col("__new"))
    return found.withColumn("text", F.when(F.size("spans") > 0, masked).otherwise(F.col("text"))).select(*columns)


def _outside_quotes(text: Column, edit: Column) -> Column:
    start, end = edit.getField("start"), edit.getField("end")
    before, after = F.substring(text, start, F.lit(1)), F.substring(text, end + 1, F.lit(1))
    quoted = (start > 0) & (before == after) & before.isin('"', "'", "`")
    return F.struct(
        F.when(quoted, start - 1).otherwise(start).alias("start"),
        F.when(quoted, end + 1).otherwise(end).alias("end"),
        edit.getField("variable").alias("variable"),
    )
