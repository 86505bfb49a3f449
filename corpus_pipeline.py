"""The corpus pipeline: quality rules, near-duplicates, repeated strings, secrets, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``.

A document is a row. Stages join by its id and the SHA-256 of its text, so that
rows that repeat an id and rows without one stay; equal rows are near-duplicates
of each other. To the suffix-array stage rows with one id are one document, none
of whose rows is earlier than another, and a row without an id stays whole. A
null text fails the quality rules. Other columns than those of ``documents`` do
not pass the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm import neardup, packing, quality, secrets, suffix
from keysieve.llm.common import new_folder, settled, table, whole_text

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


KEY = ("__missing", "__id", "__address")


def _keyed(rows: DataFrame, address: Column) -> DataFrame:
    """``rows`` with columns that are never null for their id and the address of their text."""
    return rows.withColumns({"__missing": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0)), "__address": address})


def _address() -> Column:
    return F.unhex(F.sha2(whole_text().cast("binary"), 256))


def _with_text(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``docs`` with the texts that another table has for their ids and texts."""
    changed = _keyed(texts, F.col("address")).select(*KEY, F.col("kept").alias("text")).dropDuplicates([*KEY])
    found = _keyed(docs, _address()).drop("text", "n_chars").join(changed, [*KEY])
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and all rules of the table."""
    return quality.keep(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class, one without an id if no other is in it; null texts are classes of their own."""
    keepers = _keyed(neardup.keepers(docs.select("doc_id", "text")), F.col("address")).select(*KEY)
    # Rows with one id and one text are copies; the first of them met stays.
    distinct = _keyed(docs.filter("text is not null"), _address()).dropDuplicates([*KEY])
    return distinct.join(keepers, [*KEY]).select(*COLUMNS).unionByName(docs.filter("text is null").select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings that documents with smaller ids hold.

    Bytes of a character that was cut in two go with it.
    """
    kept = suffix.remove_repeats(docs.select("doc_id", "text"), as_text=True)
    return _with_text(docs, kept)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its secrets replaced by a mark."""
    found = secrets.scan(docs, new_folder(spark, "ledger"))
    return secrets.redacted(found).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    # Workers outlive the stage: what they remember adds to the memory of the stages of a next run.
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False, entries=300_000)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: No SQL: shingle similarity over all pairs and a tokenizer are out of its reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
