"""The registered corpus queries: against their SQL where there is one, and the pipeline end to end."""

import random
import zlib

import compare
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from keysieve.llm import oracle, queries

COLUMNS = {
    "op1_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op2_lm_scores": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op3_minhash_near_dedup": {"doc_id", "class_id"},
    "op4_secret_scans": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op5_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_suffix_array_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op9_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op10_exact_top_k": {"query_id", "rank", "vec_id", "score"},
    "op11_phrase_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
    "op12_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op13_ngram_jaccard_join": {"doc_id", "n_shingles", "component_id"},
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.registered()))
def test_rows_and_columns(spark, sf_dir, con, name):
    frame = queries.registered()[name](spark, sf_dir)
    assert COLUMNS.get(name, set()) <= set(frame.columns)
    got = compare.rows_of(frame)
    sql = oracle.statements().get(name)
    if sql is not None:
        names, expected = compare.expected_rows(con, sql)
        assert names == sorted(frame.columns) and got == expected
    if "doc_id" in frame.columns and "piece" not in frame.columns:
        assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_the_contract_registers_all():
    assert set(queries.registered()) | {"pipeline"} <= set(contract.queries())
    assert set(oracle.statements()) <= set(contract.oracle_sql())


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to", "in"]) if k % 3 == 0 else f"word{rng.randrange(10**5)}" for k in range(n)) + "."


def corpus():
    rng = random.Random(11)
    base, passage = words(rng, 150), words(rng, 70)
    edited = base.split()
    edited[70] = "changed"
    rows = [(1, base), (2, " ".join(edited)), (3, base), (4, None), (5, ""), (6, "too short"), (7, "### " * 80), (8, words(rng, 60) + " " + passage)]
    rows += [(9, words(rng, 60) + " " + passage), (10, words(rng, 80) + " token = 'abcdefghijklmnop123' " + words(rng, 5)), (11, words(rng, 6000))]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows], passage


def test_stages_take_effect(spark, tmp_path):
    rows, passage = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert result.columns == list(corpus_pipeline.COLUMNS)
        path = str(tmp_path / name.replace(" ", "-"))
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
    assert [r.doc_id for r in sorted(kept["quality rules"])] == [1, 2, 3, 8, 9, 10, 11]
    assert sorted(r.doc_id for r in kept["near-duplicates"]) == [1, 8, 9, 10, 11]
    clean = {r.doc_id: r for r in kept["suffix-array dedup"]}
    texts = {i: t for i, t, *_ in rows}
    assert clean[8].text == texts[8] and clean[9].n_chars == len(clean[9].text)
    # The passage goes, with the few characters before it that both texts happen to share.
    assert texts[9].startswith(clean[9].text) and 0 <= len(texts[9]) - len(passage) - len(clean[9].text) < 20
    safe = {r.doc_id: r.text for r in kept["secret scans"]}
    assert "[secret]" in safe[10] and "abcdefghijklmnop123" not in safe[10] and safe[1] == texts[1]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in kept["best-fit packing"]}
    expected = {}
    for i, text in safe.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            expected[i, k // 4096] = (len(part), zlib.crc32(part.tobytes()))
    assert found == expected


def test_rows_with_null_or_repeated_ids_stay(spark, tmp_path):
    rng = random.Random(5)
    texts = {n: words(rng, 80) for n in ("alone", "copied", "near", "one", "two", "later")}
    edited = texts["near"].split()
    edited[40] = "changed"
    ids = [(None, "alone"), (None, "copied"), (None, "copied"), (7, "one"), (7, "two"), (7, "two"), (8, "two"), (9, "later"), (None, "later")]
    rows = [(i, texts[n]) for i, n in ids] + [(None, texts["near"]), (None, " ".join(edited))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    kept = docs.collect()
    expected = [(None, "alone"), (None, "copied"), (7, "one"), (7, "two"), (9, "later")]
    found = [(r.doc_id, r.text) for r in kept]
    near = [f for f in found if f in {(None, texts["near"]), (None, " ".join(edited))}]
    assert len(near) == 1
    assert sorted(map(repr, found)) == sorted(map(repr, [(i, texts[n]) for i, n in expected] + near))
    for stage in (corpus_pipeline.suffix_dedup, corpus_pipeline.secret_scans):
        docs = stage(spark, docs, str(tmp_path))
        assert sorted(map(repr, docs.collect())) == sorted(map(repr, kept))
    pieces = corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path)).collect()
    assert sorted(repr(r.doc_id) for r in pieces) == sorted(repr(r.doc_id) for r in kept)


def test_stages_take_empty_tables(spark, sf_dir, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_run_writes_every_stage(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert rows and max(used.values()) <= 4096
