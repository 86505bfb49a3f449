"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. A ledger
in a folder that all machines share names the (blob, rule, version) triples that
were ever scanned, a row per blob and run, with the spans found. A run scans
only what the ledger lacks, appends it, and joins the ledger's findings back to
all paths.

Defined cases
-------------
* A null text is the empty text; so is a text without a match: no spans.
* Rows with null in other columns, repeated rows and equal texts keep one row
  each in the result. Extra columns pass through; columns with one of the names
  the result adds are replaced.
* Matches of one kind do not overlap; kinds may. Offsets are code points, ends
  exclusive. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm.common import whole_text


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    ``hints``: lower-case strings of which a text must hold one, in any case, to match at all.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The three base kinds.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12,
         ("password", "passwd", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
#: Kinds beside the base ones, listed after them.
MORE_RULES = (
    Rule("key_block", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("-----begin ",)),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", hints=("eyj",)),
    Rule("prefixed", 1, r"(?:gh[pousr]_|sk-|xox[abprs]-|AIza)[A-Za-z0-9_-]{20,}", hints=("gh", "sk-", "xox", "aiza")),
)
RULES = BASE_RULES + MORE_RULES

LEDGER = "blob string, rules array<string>, spans array<struct<rule:string,start:bigint,end:bigint>>"


def spans_of(rule: Rule, compiled: re.Pattern, text: str, lowered: str) -> list[tuple[int, int]]:
    if rule.hints and not any(h in lowered for h in rule.hints):
        return []
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scanner(rules: Sequence[Rule]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key = {r.key: (r, re.compile(r.pattern, re.ASCII)) for r in rules}
        span = pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        schema = pa.schema([("blob", pa.string()), ("rules", pa.list_(pa.string())), ("spans", pa.list_(span))])
        for batch in batches:
            found = []
            for text, todo in zip(batch.column("text"), batch.column("todo"), strict=True):
                text = text.as_py()
                lowered = text.lower()
                found.append([{"rule": k, "start": s, "end": e} for k in todo.as_py() for s, e in spans_of(*by_key[k], text, lowered)])
            yield pa.record_batch([batch.column("blob"), batch.column("todo"), pa.array(found, schema.field("spans").type)], schema=schema)

    return scan


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """All rows of a ledger; none where the folder does not exist yet."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def unseen(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "doc_id") -> DataFrame:
    """One row per blob that lacks rules in the ledger: ``blob``, ``text`` and the rule keys ``todo``.

    The blob's text comes from its first version; only narrow rows decide which
    that is, and only texts still to be scanned are kept.
    """
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    todo = (
        versions.groupBy("blob").agg(F.min(id_column).alias("__first")).join(seen, "blob", "left")
        .select("blob", "__first", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
        .filter(F.size("todo") > 0)
    )
    texts = versions.select(F.col(id_column).alias("__id"), F.col("blob").alias("__blob"), "text")
    picked = todo.join(texts, F.col("__first").eqNullSafe(F.col("__id")) & (F.col("blob") == F.col("__blob")))
    return picked.select("blob", "text", "todo")


def scan_new(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, id_column: str = "doc_id") -> None:
    """Scan what the ledger lacks and append it. ``versions`` needs ``blob``, ``text`` and the id column.

    Versions that repeat an id with the same text may be scanned twice within
    one run; the rows appended are then equal and are read as one.
    """
    spark = versions.sparkSession
    fresh = unseen(versions, ledger_rows(spark, ledger), rules, id_column).mapInArrow(_scanner(rules), LEDGER)
    fresh.write.mode("append").option("compression", "zstd").parquet(ledger)


def addressed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``blob``, the address of its text."""
    return docs.withColumn("blob", F.sha2(whole_text(text).cast("binary"), 256))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


ADDED = ("base_spans", "spans", "span_list")


def findings_of_blobs(ledger: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES) -> DataFrame:
    """One row per blob: counts ``n_<kind>``, ``span_list`` and the joined strings ``base_spans`` and ``spans``.

    Sorted by start, then by the rules' order.
    """
    order = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (r.key, n)])
    kind = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.kind)])
    # A blob has a row per run that scanned it, and equal rows if it was scanned twice.
    found = F.array_distinct(F.flatten(F.collect_list("spans")))
    per_blob = ledger.groupBy("blob").agg(found.alias("found"))
    current = F.filter("found", lambda s: s["rule"].isin([r.key for r in rules]))
    placed = F.transform(current, lambda s: F.struct(s["start"], order[s["rule"]].alias("place"), kind[s["rule"]].alias("kind"), s["end"]))
    per_blob = per_blob.select("blob", F.sort_array(placed).alias("span_list"))

    def count(kind_name: str) -> Column:
        return F.size(F.filter("span_list", lambda s: s["kind"] == kind_name)).cast("long")

    per_blob = per_blob.withColumns({f"n_{r.kind}": count(r.kind) for r in rules})
    in_base = F.filter("span_list", lambda s: s["place"] < len(base))
    return per_blob.withColumns({"base_spans": _joined(in_base), "spans": _joined(F.col("span_list"))})


def scan(docs: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Bring the ledger up to date for ``docs`` and join its findings to every row."""
    spark = docs.sparkSession
    added = {*ADDED, "blob", *(f"n_{r.kind}" for r in rules)}
    docs = addressed(docs.select([c for c in docs.columns if c not in added]), text)
    scan_new(docs.select(id_column, "blob", whole_text(text).alias("text")), ledger, rules, id_column)
    return docs.join(findings_of_blobs(ledger_rows(spark, ledger), rules), "blob", "left")


def redacted(scanned: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows of ``scan`` with every span of their text replaced by ``mark``; overlapping spans get one mark."""
    merged = F.aggregate(
        F.col("span_list"),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] < F.try_element_at(done, F.lit(-1))["end"]),
            F.concat(
                F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"),
                                 F.greatest(F.try_element_at(done, F.lit(-1))["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    t = F.col(text)

    def rest(m: Column) -> Column:
        kept = F.transform(m, lambda x, i: F.substring(t, (F.coalesce(F.get(m, i - 1)["end"], F.lit(0)) + 1).cast("int"),
                                                       (x["start"] - F.coalesce(F.get(m, i - 1)["end"], F.lit(0))).cast("int")))
        tail = F.substring(t, (F.try_element_at(m, F.lit(-1))["end"] + 1).cast("int"), F.length(t))
        return F.concat(F.array_join(kept, mark), F.lit(mark), tail)

    changed = F.get(F.transform(F.array(merged), rest), 0)
    return scanned.withColumn(text, F.when(F.size("span_list") > 0, changed).otherwise(t))
