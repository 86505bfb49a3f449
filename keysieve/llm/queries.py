"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm import bpe, jaccard, lm, neardup, packing, periods, phrases, quality, search, secrets, suffix, urls, warc
from keysieve.llm.common import WHITE_CLASS, new_folder, table, whole_text

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.scores(docs)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs).select("doc_id", "class_id")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, new_folder(spark, "ledger"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans"
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(encoded, path).select(
        "doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied pages with a fetch time of the year 2024, which the table itself lacks."""
    seconds = F.lit(1704067200) + (F.col("page_id") * 7919) % 31536000
    return table(spark, sf_dir, "pages").withColumn("fetched_at", F.timestamp_seconds(seconds))


def list_events(pages: DataFrame) -> DataFrame:
    """Dated block and allow lists over the hosts, domains and sections that occur in ``pages``.

    Which of them are listed, and when, follows from a checksum of their names.
    """
    host = urls.host_of(F.col("url"))
    section = F.regexp_extract("url", "^[a-z]+://[^/?#]+/([a-z]+)/", 1)
    labels = F.split("host", "[.]")
    names = pages.select(host.alias("host"), section.alias("section")).distinct()
    named = names.select(F.explode(F.array(
        F.concat(F.lit("host:"), "host"),
        F.concat(F.lit("domain:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")),
        F.when(F.col("section") != "", F.concat(F.lit("prefix:"), "host", F.lit("/"), "section")),
    )).alias("key")).dropna().distinct()
    number = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 6), 16, 10).cast("long")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + 86400 * n)
    n = F.col("n")
    turns = F.array(
        F.when(n % 3 == 0, F.struct(F.lit("spam").alias("list"), F.lit("add").alias("action"), day(n % 180).alias("at"))),
        F.when((n % 3 == 0) & (n % 2 == 0), F.struct(F.lit("spam").alias("list"), F.lit("remove").alias("action"), day(n % 180 + 30 + n % 60).alias("at"))),
        F.when((n % 3 == 0) & (n % 4 == 0), F.struct(F.lit("spam").alias("list"), F.lit("add").alias("action"), day(n % 180 + 120).alias("at"))),
        F.when(n % 5 == 1, F.struct(F.lit("malware").alias("list"), F.lit("add").alias("action"), day(n % 330).alias("at"))),
        F.when(n % 7 == 2, F.struct(F.lit("allow").alias("list"), F.lit("add").alias("action"), day(n % 200).alias("at"))),
        F.when(n % 14 == 2, F.struct(F.lit("allow").alias("list"), F.lit("remove").alias("action"), day(n % 200 + 90).alias("at"))),
    )
    return named.withColumn("n", number).select("key", F.explode(F.array_compact(turns)).alias("t")).select("t.list", "key", "t.action", "t.at")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = captures(spark, sf_dir).select("page_id", "url", "fetched_at")
    return urls.filter_captures(pages, list_events(pages)).select("page_id", "url", "host", "n_active", "lists", "blocked")


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per page: how its metadata and its text record are linked to the response."""
    records = warc.derivatives(warc.responses(captures(spark, sf_dir)))
    return records.select(
        "type", "record_id", "refers_to", warc.header("WARC-Target-URI").alias("target_uri"), warc.header("WARC-Date").alias("warc_date"),
        warc.header("Content-Type").alias("content_type"), warc.header("WARC-Block-Digest").alias("block_digest"),
        F.octet_length("block").cast("long").alias("content_length"), F.decode("block", "UTF-8").alias("block"),
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def periodic_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail in each text whose id has a checksum that 10 divides."""
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(whole_text(), f"{WHITE_CLASS}+"), lambda w: w != "")
    known = docs.withColumns({"__g": F.floor(check / 10), "__words": F.when(check % 10 == 0, words)}).withColumn("__n", F.size("__words"))
    start = known.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")))
    period = 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - F.col("__a") - 1), lambda j: F.get("__words", (F.col("__a") + j % F.col("__p")).cast("int")))
    turned = F.concat(F.slice("__words", F.lit(1), F.col("__a").cast("int")), tail)
    text = F.when(F.col("__a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text"))
    return start.withColumn("__p", period).withColumn("text", text).select("doc_id", "text")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find_runs(periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = periods.longest_run()
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classified(table(spark, sf_dir, "documents").select("doc_id", "text"))


def registered() -> dict[str, Query]:
    ops = (op1_quality_rules, op2_lm_scores, op3_minhash_near_dedup, op4_secret_scans, op5_byte_bpe, op6_suffix_array_dedup, op7_url_filters, op8_warc_derivatives, op9_best_fit_packing, op10_exact_top_k,
           op11_phrase_collocations, op12_periodic_runs, op13_ngram_jaccard_join)
    return {f.__name__: f for f in ops}
