"""Quality rules: a threshold table compiled into one projection of built-in expressions.

``measured`` adds word, symbol, line and stop-word counts of every whole text;
``compile_rules`` turns a table of ``Rule`` rows into one boolean column per
rule. No user function runs anywhere.

Defined cases
-------------
* A null text counts as a text without words: it fails the base rule.
* Null in any other column changes nothing; other columns pass through, and
  columns that already have one of the new names are replaced.
* A ratio over zero words or lines is 0.
* Repeated rows are judged one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysieve.llm.common import WHITE_CLASS, whole_text

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
EDGES = ".,;:!?\"'()"
LONG_WORD = 40

# Frequent words of the languages covered.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with be at by have from this or had not but were which their "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie "
    "de la le et les en des un du une que est pour qui dans par plus pas au sur ne se ce il sont avec aux ou "
    "el y los del las por con no una su para al lo como más pero sus le ya o este sí porque esta entre cuando"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document while ``low <= measure <= high``; an absent bound does not bind."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The verdict beside the base rule.
DEFAULT_RULES = (
    Rule("length", "n_words", low=50),
    Rule("word_length", "mean_word", low=2.5, high=12.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.05),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("long_words", "long_word_ratio", high=0.05),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _has_word(line: Column) -> Column:
    return F.length(F.translate(line, WHITE, "")) > 0


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that the text holds at least twice.

    The windows of one text are sorted, equal neighbours mark their places, and
    each place covers ``width`` words or as many as lie before the next place.
    """
    shifted = [words if k == 0 else F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - k, F.lit(0))) for k in range(width)]
    zipped = F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)])
    full = F.slice(zipped, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))

    def hashed(z: Column) -> Column:
        return F.xxhash64(*[z[f"w{k}"] for k in range(width)])

    def window(z: Column, i: Column) -> Column:
        return F.struct(hashed(z).alias("h"), F.concat_ws(" ", *[z[f"w{k}"] for k in range(width)]).alias("w"), i.alias("i"))

    def equals_next(s: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            return (F.get(s, i + 1)["h"] == x["h"]) & (F.get(s, i + 1)["w"] == x["w"])

        return F.transform(s, lambda x, i: F.coalesce(same(x, i), F.lit(False)))

    def places(s: Column) -> Column:
        def repeated(e: Column) -> Column:
            return F.transform(s, lambda x, i: F.when(F.get(e, i) | F.coalesce(F.get(e, i - 1), F.lit(False)), x["i"]))

        return F.sort_array(F.array_compact(_bound(equals_next(s), repeated)))

    def covered(p: Column) -> Column:
        spans = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x)

    def counted(z: Column) -> Column:
        # Without two equal hashes there is nothing to compare.
        distinct = F.size(F.array_distinct(F.transform(z, hashed))) == F.size(z)
        sorted_windows = F.sort_array(F.transform(z, window))
        return F.when(distinct, F.lit(0).cast("long")).otherwise(_bound(_bound(sorted_windows, places), covered))

    return _bound(full, counted)


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_long_words")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of ``COUNTS`` and the ratios that rules may name."""
    own = set(COUNTS) | {"mean_word", "symbol_ratio", "stop_ratio", "dup_line_ratio", "long_word_ratio"}
    docs = docs.select([c for c in docs.columns if c not in own])
    t = whole_text(text)
    bare = F.length(F.translate(t, WHITE, ""))
    words = F.array_remove(F.split(t, f"{WHITE_CLASS}+"), "")
    lines = F.filter(F.split(t, "\n"), _has_word)
    rest = [F.col(f"`{c}`") for c in docs.columns]
    parts = docs.select(*rest, words.alias("__words"), lines.alias("__lines"), bare.cast("long").alias("word_chars"),
                        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    w, l = F.col("__words"), F.col("__lines")
    counted = parts.select(
        *rest,
        "word_chars",
        "n_symbols",
        F.size(w).cast("long").alias("n_words"),
        F.size(l).cast("long").alias("n_lines"),
        (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(F.btrim(x, F.lit(EDGES))).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
        F.size(F.filter(w, lambda x: F.length(x) > LONG_WORD)).cast("long").alias("n_long_words"),
    )
    return counted.withColumns(
        {
            "mean_word": _share("word_chars", "n_words"),
            "symbol_ratio": _share("n_symbols", "n_words"),
            "stop_ratio": _share("n_stop_words", "n_words"),
            "dup_line_ratio": _share("n_dup_lines", "n_lines"),
            "long_word_ratio": _share("n_long_words", "n_words"),
        }
    )


def compile_rules(rules: Sequence[Rule]) -> dict[str, Column]:
    """One boolean column per rule: true where the measure is within bounds."""
    compiled = {}
    for rule in rules:
        checks = [F.col(rule.measure) >= F.lit(rule.low)] if rule.low is not None else []
        checks += [F.col(rule.measure) <= F.lit(rule.high)] if rule.high is not None else []
        passed = F.lit(True)
        for check in checks:
            passed = passed & check
        compiled[rule.name] = passed
    return compiled


def keep(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns.

    The filter also names a column of running numbers: without it, the optimizer
    would move the filter below the projection and measure every text again for
    each rule.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn("__row", F.struct(*columns)).withColumn("__text", F.col(text)).select("__row", "__text")
    judged = judge(marked, rules, "__text").select("__row", "kept", F.monotonically_increasing_id().alias("__once"))
    return judged.filter(F.col("kept") & (F.col("__once") >= 0)).select("__row.*")


def judge(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text: str = "text") -> DataFrame:
    """``measured`` plus ``base_failed``, ``failed_rules`` (names, in table order) and ``kept``."""
    table = measured(docs.drop("base_failed", "failed_rules", "kept"), text)
    failed = F.array_compact(F.array(*[F.when(~passed, F.lit(name)) for name, passed in compile_rules(rules).items()]))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return table.withColumns({"base_failed": base, "failed_rules": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )
