import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keysieve.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    (1, "Hello there, don't 'S you? \U0001f600 12345 ..."),
    (2, None),
    (3, ""),
    (4, "  lines\n\n and\ttabs \x1c \x85 x\xa0y"),
    (4, "  lines\n\n and\ttabs \x1c \x85 x\xa0y"),
    (5, "<|endoftext|> é é İ ΣΑΣ ﬃ ₂ ½ ź \x01 a \x01"),
    (6, "abc def, " * 40_000),
    (7, "x" * 5_000),
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.loaded(PATH)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_encoding_equals_the_library_and_comes_back(spark, library):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    encoded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    rows = bpe.decode(encoded, PATH).collect()
    assert len(rows) == len(TEXTS)
    texts = dict(TEXTS)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()


def test_random_pieces_appends_and_edits(vocabulary, library):
    rng = random.Random(4)
    tokens = list(vocabulary.ranks)
    for _ in range(300):
        data = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 30)))
        state = bpe.Prefixes(vocabulary, data[:7])
        state.append(data[7:])
        assert state.encoding() == vocabulary.merge(data)
        start = rng.randint(0, len(data))
        end = min(len(data), start + rng.randint(0, 9))
        new = b"".join(rng.choice(tokens) for _ in range(rng.randint(0, 2)))
        state.replace(start, end, new)
        assert state.data == data[:start] + new + data[end:]
        assert state.encoding() == vocabulary.merge(state.data)


def test_an_edit_works_out_few_prefixes(vocabulary):
    state = bpe.Prefixes(vocabulary, b"abcdefgh ijkl " * 500)
    assert state.replace(3000, 3001, b"z") < 400


def plain_pieces(text, capacity):
    ids = Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [1]
    return [(k, i, len(ids[i : i + capacity]), zlib.crc32(np.array(ids[i : i + capacity], "<u4").tobytes())) for k, i in enumerate(range(0, len(ids), capacity))]


def test_pieces_equal_the_library(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    rows = packing.packed(docs, WORDS, capacity=512).collect()
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == sorted((i, *p) for i, t in TEXTS for p in plain_pieces(t, 512))
    assert all(len(r.ids) == 4 * r.length for r in rows)
    check_sequences(rows, 512)


@pytest.mark.parametrize("entries", [1, 7, 1000])
def test_more_words_in_a_text_than_are_remembered(entries):
    encode, plain = packing.WordEncoder(WORDS, entries), Tokenizer.from_file(WORDS)
    texts = [" ".join(f"{s}{k:x}, word{chr(97 + k % 26)}" for k in range(40)) for s in ("id", "ź", "id")]
    # The second text has words of the first and words of its own.
    for some in (texts[:1], texts[1:], texts):
        assert encode(some) == [packing.pack_ids(plain.encode(t, add_special_tokens=False).ids) for t in some]
    assert len(encode.known) <= entries


def check_sequences(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_empty_table_packs_to_nothing(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


def plain_best_fit(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


def test_packing_needs_no_more_sequences_than_sequential_best_fit(spark):
    rng = random.Random(9)
    for sizes in ([rng.randint(1, 60) for _ in range(400)], [64] * 50 + [1] * 30, [rng.choice([20, 21, 43, 64]) for _ in range(200)]):
        table = spark.createDataFrame([(None if n % 7 == 0 else n, 0, 0, s) for n, s in enumerate(sizes)], "doc_id long, piece int, start long, length long")
        rows = packing.pack(table, capacity=64).collect()
        assert sorted(r.length for r in rows) == sorted(sizes)
        assert check_sequences(rows, 64) == plain_best_fit(sizes, 64)
