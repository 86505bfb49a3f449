"""Collocations, periodic runs and the Jaccard join against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysieve.llm import jaccard, periods, phrases, queries

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


# -- collocations ---------------------------------------------------------


def plain_collocations(rows, max_words, least, top):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    counts[lang, tuple(words[i : i + m])] += 1
    found = {key: n for key, n in counts.items() if len(key[1]) > 1 and n >= least}
    out = {}
    for (lang, phrase), a in found.items():
        cuts = [(1000000 * a * a // (counts[lang, phrase[:k]] * counts[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
        score, k = min(cuts)
        inside = any(
            len(longer) > len(phrase) and 100 * n >= 50 * a and other == lang
            and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer) - len(phrase) + 1))
            for (other, longer), n in found.items()
        )
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), counts[lang, phrase[:k]], counts[lang, phrase[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, total[lang], -score)
        for lang, rows in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1)
    )


def phrase_rows(n, seed):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "CITY", "of", "the", "é", "a\x1cb", "ÀB", "x" * 40]
    texts = [(rng.choice(["en", "fr", None, "und", "x y"]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  ", ","]) for _ in range(rng.randrange(60)))) for _ in range(n)]
    return [*texts, ("en", None), (None, ""), ("fr", " .,;\n"), *texts[:3], ("en", "new york city " * 3000)]


@pytest.mark.parametrize("max_words", [3, 5])
def test_collocations_equal_brute_force(spark, monkeypatch, max_words):
    rows = phrase_rows(60, max_words)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 700)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 500)
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "lang string, text string, n long, phrase string").repartition(3)
    got = [tuple(r) for r in phrases.collocations(docs, max_words=max_words, min_count=3, top=25).collect()]
    assert sorted(got) == plain_collocations(rows, max_words, 3, 25)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).isEmpty()
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", " ")], "lang string, text string")).isEmpty()


def test_scores_pass_64_bits(spark):
    a, l, r = 3 * 10**11, 7 * 10**11, 9 * 10**11 + 1
    sums = spark.createDataFrame(
        [("en", 0, [], 10**12), ("en", 1, ["x"], l), ("en", 1, ["y"], r), ("en", 2, ["x", "y"], a)], "lang string, size int, phrase array<string>, n long"
    )
    (row,) = phrases.scored(sums).collect()
    assert (row["a"], row["l"], row["r"], row["n"], row["score"]) == (a, l, r, 10**12, 10**6 * a * a // (l * r))


# -- periodic runs --------------------------------------------------------


def plain_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + (j == i)
    return sorted((s, e, q) for (s, e), q in out.items())


def random_words(rng):
    kind = rng.random()
    if kind < 0.3:
        letters = rng.choice([1, 2, 3])
        return [rng.randrange(letters) for _ in range(rng.randrange(250))]
    if kind < 0.6:
        out = []
        for _ in range(rng.randrange(1, 6)):
            period = [rng.randrange(rng.choice([2, 50])) for _ in range(rng.randrange(1, 40))]
            if rng.random() < 0.5:
                period = ([rng.randrange(2) for _ in range(rng.randrange(1, 5))] * 40)[: rng.randrange(8, 80)]
            out += (period * 6)[: rng.randrange(1, 5 * len(period))]
        return out
    if kind < 0.8:
        # Two regions of one small period that touch out of phase: squares without a synchronising position.
        root = [*range(rng.randrange(2, 5))]
        return (root * 40)[: rng.randrange(40, 90)] + (root * 40)[rng.randrange(4) :][: rng.randrange(40, 90)]
    u, v = [0], [1]
    for _ in range(rng.randrange(3, 9)):
        u, v = u + v, u if rng.random() < 0.7 else v
    return (u * rng.randrange(1, 4))[:300]


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        words = random_words(rng)
        codes = np.array([*words, 10**6], dtype=np.int64)
        assert [tuple(r) for r in periods.runs_of(codes, len(words)).tolist()] == plain_runs(words)


def test_equal_hashes_do_not_make_runs(monkeypatch):
    """With hashes that tell nothing apart the words still decide: what is reported is true."""
    monkeypatch.setattr(periods._Hashes, "at", lambda self, start, width: np.zeros(np.broadcast(start, width).shape, dtype=np.uint64))
    rng = random.Random(6)
    for _ in range(30):
        words = random_words(rng)
        got = {tuple(r) for r in periods.runs_of(np.array([*words, 10**6], dtype=np.int64), len(words)).tolist()}
        assert got <= set(plain_runs(words))


def collapsed(words, runs):
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_run_rows_of_special_texts(spark):
    texts = [None, "", " \n\t", "a " * 11, "a " * 12, "a b c d e f g h " * 2, "x\x1cy z " * 6, "é " * 30 + "b", "lone words only", "a b " * 40_000, "a " * 12]
    rows = [(None if i == 3 else i % 9, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_runs"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.find_runs(docs).collect())
    expected = []
    for i, text, _ in rows:
        words = words_of(text)
        runs = [(0, 80_000, 2)] if len(words) == 80_000 else plain_runs(words)
        kept = "a b" if len(words) == 80_000 else collapsed(words, runs)
        expected.append((i is None, i or 0, len(runs), [(s, e - s, q) for s, e, q in runs], kept))
    assert got == sorted(expected)
    assert periods.find_runs(docs.filter("doc_id > 99")).isEmpty()


def test_periodic_runs_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for doc_id, text in docs:
        words = words_of(text)
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
        codes = np.array([numbers[w] for w in words])
        runs = {}
        for q in range(1, n // 2 + 1):
            same = np.flatnonzero(np.diff(np.concatenate([[False], codes[:-q] == codes[q:], [False]]).astype(np.int8)))
            for s, e in zip(same[::2].tolist(), same[1::2].tolist(), strict=True):
                if e + q - s >= max(12, 2 * q):
                    runs.setdefault((s, e + q), q)
        runs = sorted((s, e, q) for (s, e), q in runs.items())
        best = min(((s - e, s, q, e - s) for s, e, q in runs), default=None)
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        expected.append((
            doc_id, len(runs), *((best[1], best[3], best[2], 1000 * best[3] // best[2]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
        ))
    frame = queries.op12_periodic_runs(spark, sf_dir)
    assert frame.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in frame.dtypes[1:6]} == {"bigint"}
    assert sorted(tuple(r) for r in frame.collect()) == sorted(expected)
    assert sum(e[1] > 0 for e in expected) > 5


# -- Jaccard join ---------------------------------------------------------


def plain_join(rows, percent=90):
    sets = []
    for _, text in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(text)]
        sets.append({tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and Fraction(len(x & sets[j]), len(x | sets[j])) * 100 >= percent:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        known = [k for k in (least.get(root(i)), doc_id) if k is not None]
        least[root(i)] = min(known, default=None)
    return [(doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows)]


def shown(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def edited(rng, words, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def join_rows(seed, groups):
    rng = random.Random(seed)
    texts = []
    passage = [f"shared{i}" for i in range(60)]
    for members, share in groups:
        base = [f"w{rng.randrange(10**5)}" for _ in range(rng.randrange(80, 160))]
        chain = base
        for m in range(members):
            texts.append(" ".join(edited(rng, base, share)))
            chain = edited(rng, chain, share)
            texts.append(" ".join(chain))
            if m % 3 == 0:
                texts.append(texts[-1].upper())
                texts.append(" ".join(passage + [f"w{rng.randrange(10**5)}" for _ in range(rng.randrange(3, 12))]))
    texts += [None, "", " \t", "one", "One", "one two", "one two three", "one one one one", "x y " * 300, "x y " * 299]
    rng.shuffle(texts)
    ids = [None if i % 17 == 5 else i // 2 if i % 11 == 3 else i for i in range(len(texts))]
    return list(zip(ids, texts, strict=True))


def test_join_equals_brute_force(spark):
    rows = join_rows(3, [(12, 0.01), (12, 0.02), (10, 0.03), (6, 0.004), (1, 0), (40, 0.012)])
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node long, region string").repartition(5)
    got = shown(tuple(r) for r in jaccard.classified(docs).collect())
    expected = shown(plain_join(rows))
    assert got == expected
    assert len({c for _, _, c in expected}) < len(rows) - 60


def test_join_needs_many_rounds(spark, monkeypatch):
    """With one key for all, texts that differ more than the threshold lets through all become pivots."""
    monkeypatch.setattr(jaccard, "part_keys", lambda shingles, percent, bounds: np.array([7], dtype=np.uint64))
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(50)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(40)}" for _ in range(10)])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(tuple(r) for r in jaccard.classified(docs).collect()) == shown(plain_join(rows))


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(2)
    bounds = jaccard.size_classes(5000, 90)
    met = 0
    for _ in range(4000):
        n = int(rng.integers(1, 400)) if rng.random() < 0.9 else int(rng.integers(400, 4000))
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        gone, new = (int(rng.integers(0, 1 + max(1, n // 18))) for _ in range(2))
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if both and 100 * both >= 90 * (len(x) + len(y) - both):
            met += 1
            assert set(jaccard.part_keys(x, 90, bounds).tolist()) & set(jaccard.part_keys(y, 90, bounds).tolist())
    assert met > 1000


def test_join_of_nothing(spark):
    assert jaccard.classified(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    rows = [(1, None), (2, ""), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(tuple(r) for r in jaccard.classified(docs).collect()) == shown([(1, 0, 1), (2, 0, 2), (None, 0, None)])


def test_texts_of_a_join_that_share_no_cell_do_not_move(spark, monkeypatch):
    marked, passed = jaccard.marked, []

    def counting(rows, keys, key):
        left = marked(rows, keys, key)
        passed.append((rows.count(), left.count()))
        return left

    monkeypatch.setattr(jaccard, "marked", counting)
    rows = [(n, " ".join(f"w{n}x{k}" for k in range(40))) for n in range(300)]
    rows += [(300 + n, " ".join(f"c{k}" for k in range(60 + n))) for n in range(3)]
    got = {r.doc_id: r.component_id for r in jaccard.classified(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: min(n, 300) for n in range(303)}
    assert passed[0][0] == 303 and 3 <= passed[0][1] < 100


def test_texts_that_can_be_linked_with_nobody_are_not_compared(spark, monkeypatch):
    overlaps, compared = jaccard._overlaps, []

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return overlaps(pairs, *rest)

    monkeypatch.setattr(jaccard, "_overlaps", counting)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    # Each has some tenth of its shingles for itself: two together have too many.
    rows = [(n, " ".join(w if k not in new else f"new{rng.randrange(10**9)}" for k, w in enumerate(base))) for n in range(120) for new in [set(rng.sample(range(150), 4))]]
    rows += [(200 + n, " ".join(base[:40] + [f"p{k}" for k in range(60)] + ["end"] * n)) for n in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(tuple(r) for r in jaccard.classified(docs).collect()) == shown(plain_join(rows))
    assert sum(compared) < 60


def test_close_texts_that_are_not_linked_are_not_compared(spark, monkeypatch):
    overlaps, compared = jaccard._overlaps, []

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return overlaps(pairs, *rest)

    monkeypatch.setattr(jaccard, "_overlaps", counting)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    # Edits that others make as well, at few places: all are close to the middle and share some with many.
    places = range(5, 150, 6)
    rows = [(n, " ".join(f"new{k}" if k in new else w for k, w in enumerate(base))) for n in range(100) for new in [set(rng.sample(places, 5 + n % 4))]]
    rows.append((100, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain_join(rows)
    assert shown(tuple(r) for r in jaccard.classified(docs).collect()) == shown(expected)
    assert len({c for _, _, c in expected}) > 40
    # Those with the middle and the first pivots; of the rest hardly more than are linked.
    assert compared[0] > 100 and sum(compared[1:]) < 100


def test_join_in_rounds_of_few_pivots(spark, monkeypatch):
    """Unrelated groups in one region, divided by pivots until hardly any member is left."""
    monkeypatch.setattr(jaccard, "part_keys", lambda shingles, percent, bounds: np.array([7], dtype=np.uint64))
    monkeypatch.setattr(jaccard, "_lone", lambda texts, width: texts.select("node", F.lit(0).alias("lone")))
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "FIRST", 2)
    rows = join_rows(8, [(6, 0.01), (5, 0.02), (4, 0.03), (8, 0.012), (1, 0), (1, 0)])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert shown(tuple(r) for r in jaccard.classified(docs).collect()) == shown(plain_join(rows))


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles(spark):
    rng = np.random.default_rng(5)
    pairs, differ = [], []
    for k in range(300):
        n = int(rng.integers(1, 700))
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        # Some sets are much larger: their sketch is folded more than once.
        new = int(rng.integers(0, 4 * n if k % 5 == 0 else 1 + n // 5))
        y = np.unique(np.concatenate([rng.permutation(x)[int(rng.integers(0, 1 + n // 10)):], rng.integers(0, 2**64, new, dtype=np.uint64)]))
        y = y if len(y) else x
        pairs.append((k, jaccard.sketch(x).tolist(), jaccard.sketch(y).tolist()))
        differ.append(len(np.setxor1d(x, y)))
    frame = spark.createDataFrame(pairs, "k long, a array<bigint>, b array<bigint>")
    got = {r.k: r.d for r in frame.select("k", jaccard._apart("a", "b").alias("d")).collect()}
    assert all(got[k] <= d and (d - got[k]) % 2 == 0 for k, d in enumerate(differ))
    assert sum(got[k] for k in got) > 0.5 * sum(differ)
    assert {r.d for r in frame.select(jaccard._apart("a", "a").alias("d")).collect()} == {0}


def test_parts_of_sets_are_dealt_once_and_rows_keep_theirs(spark, monkeypatch):
    settled, plans = jaccard.settled, []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df, name)

    monkeypatch.setattr(jaccard, "settled", seen)
    rows = [(n, " ".join(f"w{n // 2}x{k}" for k in range(40 + n % 2))) for n in range(20)] * 2
    got = {r.doc_id: r.component_id for r in jaccard.classified(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: n // 2 * 2 for n in range(20)}
    dealt = [p for p in plans if "explode(cells" in p]
    assert dealt and all(p.count("Generate explode(cells") == 1 for p in dealt)


def test_copies_do_not_make_a_cell(spark, monkeypatch):
    """Also where the marks let all rows pass, cells hold texts that differ."""
    monkeypatch.setattr(jaccard, "first_rows", lambda rows, nodes: rows)
    rows = [(n, " ".join(f"w{n % 4}x{k}" for k in range(40))) for n in range(40)] + [(50, " ".join(f"w1x{k}" for k in range(41)))]
    got = sorted((r.doc_id, r.component_id) for r in jaccard.classified(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [*((n, n % 4) for n in range(40)), (50, 1)]
