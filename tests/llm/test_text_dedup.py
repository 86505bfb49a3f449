import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysieve.llm import common, lm, neardup, suffix


def words(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def shingles(text):
    w = (text or "").encode().split()
    if len(w) < 5:
        return Counter([tuple(w)] if w else [])
    return Counter(zip(*[w[k:] for k in range(5)], strict=False))


def similarity(a, b):
    common = (a & b).total()
    union = a.total() + b.total() - common
    return common / union if union else 0.0


def plain_classes(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if a is not None and b is not None and (a == b or similarity(sets[i], sets[j]) >= 0.8):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted((key, least[find(i)]) for i, (key, _) in enumerate(rows))


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    base = words(rng, 200)
    rows = [(0, base), (1, base), (1, base), (2, None), (3, None), (4, ""), (5, ""), (6, "one two"), (7, "one two"), (8, " one  two ")]
    rows += [(10 + k, edited(rng, base, k % 9)) for k in range(60)]
    rows += [(100 + k, words(rng, 80)) for k in range(20)]
    rows += [(200, "a b c d e " * 400), (201, "a b c d e " * 330), (202, "a b c d e " * 300), (203, words(rng, 30_000))]
    return rows


def test_classes_equal_brute_force(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id long, text string").withColumn("keys", F.lit("clash"))
    rows = neardup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == plain_classes(copies)
    firsts = Counter(r.class_id for r in rows if r["first"])
    assert set(firsts.values()) == {1} and len(firsts) == len({r.class_id for r in rows})


def test_many_rounds_of_leaders(spark, monkeypatch):
    rng = random.Random(6)
    base = words(rng, 60, 10**6)
    rows = [(k, edited(rng, base, rng.randrange(6))) for k in range(150)]
    monkeypatch.setattr(neardup, "GROWTH", 2)
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 20)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == plain_classes(rows)


@pytest.mark.parametrize("table", [[], [(1, None)], [(1, "a b c d e f"), (2, "g h i j k l")]])
def test_tables_without_near_duplicates(spark, table):
    rows = neardup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == [(k, k) for k, _ in table]


def test_signatures_do_not_depend_on_their_batch():
    rng = random.Random(21)
    texts = [words(rng, rng.choice([5, 6, 8, 20, 60, 300]), size=rng.choice([3, 1000])).encode().split() for _ in range(400)]
    together = neardup.signatures(*neardup.shingle_weights(texts, neardup._WordHashes()), len(texts), 216)
    for i, text in enumerate(texts):
        alone = neardup.signatures(*neardup.shingle_weights([text], neardup._WordHashes()), 1, 216)
        assert np.array_equal(alone[0], together[i])


def test_signatures_agree_as_often_as_weights_do():
    rng = np.random.default_rng(3)
    a, b = (5, 3, 1, 0, 40), (2, 3, 1, 1, 33)
    shares = []
    for _ in range(80):
        ids = rng.integers(0, 2**63, len(a)).astype(np.uint64)
        items = [(k, i, w) for k, side in enumerate((a, b)) for i, w in zip(ids, side, strict=True) if w]
        text, shingle, weight = (np.array(x) for x in zip(*items, strict=True))
        s = neardup.signatures(text, shingle.astype(np.uint64), weight, 2, 256)
        shares.append((s[0] == s[1]).mean())
    expected = sum(map(min, a, b)) / sum(map(max, a, b))
    assert abs(np.mean(shares) - expected) < 0.02


def plain_removal(rows):
    seen, out = {}, []
    for key, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        for i in range(len(data) - 49):
            seen.setdefault(data[i : i + 50], key)
    for key, text in rows:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for i in range(len(data) - 49):
            if seen[data[i : i + 50]] < key:
                covered[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((key, len(data), sum(covered), spans, bytes(x for x, c in zip(data, covered, strict=True) if not c)))
    return sorted(out)


def passages():
    rng = random.Random(8)
    shared = [words(rng, 30, 10**4) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "short"), (3, shared[0]), (3, shared[0]), (4, "é" * 60), (5, "x" + "é" * 60), (6, "ab" * 200), (7, "ba" * 100)]
    for k in range(60):
        rows.append((10 + k, " ".join(x for _ in range(3) for x in (words(rng, 12, 10**5), rng.choice(shared)))))
    rows += [(90, words(rng, 3000)), (80, edited(rng, rows[-1][1], 5)), (95, rows[-1][1]), (-4, rows[-2][1][40:160])]
    return rows


@pytest.mark.parametrize("block_bytes", [8_000_000, 3_000])
def test_removal_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 10_000)
    monkeypatch.setattr(suffix, "PIECE", 2_000)
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    got = suffix.remove_repeats(docs).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == plain_removal(rows)


@pytest.mark.parametrize("seed", range(5))
def test_merge_places_every_window(seed):
    rng = np.random.default_rng(seed)
    common = bytes(rng.integers(97, 99, 60, dtype=np.uint8))
    parts = [bytes(rng.integers(97, 99, rng.integers(50, 90), dtype=np.uint8)) for _ in range(6)]
    # The last segments of both shards end with equal windows.
    parts = [*parts[:3], parts[3] + common, *parts[4:], common]
    lengths = np.array([len(p) for p in parts])
    shard = np.repeat([0, 0, 0, 0, 1, 1, 1], lengths)
    starts = np.cumsum(lengths) - lengths
    places, interval = suffix.merge_transforms(np.frombuffer(b"".join(parts), np.uint8), shard, starts, lengths - suffix.WINDOW + 1)
    whole = b"".join(parts)
    window = {int(s) + k: whole[s + k : s + k + suffix.WINDOW] for s, n in zip(starts, lengths) for k in range(n - suffix.WINDOW + 1)}
    assert sorted(places.tolist()) == sorted(window)
    groups = {}
    for place, number in zip(places.tolist(), interval.tolist()):
        groups.setdefault(number, set()).add(place)
    expected = {}
    for place, text in window.items():
        expected.setdefault(text, set()).add(place)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_rows_without_id_stay_whole_and_texts_stay_readable(spark):
    text = "ü" + "y" * 70
    rows = [(None, text), (1, text), (2, "é" + text[1:]), (3, "ü" * 80)]
    got = {r.doc_id: r.kept for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), as_text=True).collect()}
    # The tail that row 2 shares with row 1 goes; so does what repeats within row 3 only, which is nothing.
    assert got == {None: text, 1: text, 2: "é", 3: "ü" * 80}
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_scores(rows, backoff):
    tokens = [[*(t or "").encode().translate(lm._LOWER).split(), 0] for _, t in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0 for k, _ in rows]
    c, pairs = Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            c.update(t)
            pairs.update(zip([0, *t[:-1]], t, strict=True))
    total, distinct = c.total(), len(c)
    out = []
    for (key, _), t, h in zip(rows, tokens, held, strict=True):
        p = [(c[w] + 0.1) / (total + 0.1 * (distinct + 1)) for w in t]
        score = sum(math.log10((pairs[g, w] + backoff * q) / (c[g] + backoff)) for g, w, q in zip([0, *t[:-1]], t, p, strict=True))
        out.append((key, h, len(t), sum(c[w] > 0 for w in t), total, sum(map(math.log10, p)), score))
    return out


@pytest.mark.parametrize("block_tokens", [3_000_000, 200])
def test_scores_equal_a_plain_bigram_model(spark, monkeypatch, block_tokens):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block_tokens)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 2_000)
    rng = random.Random(2)
    rows = [(k, words(rng, rng.randrange(1, 60), 40) + " The ÉTÉ\x0bx") for k in range(60)] + [(None, "The x"), (61, None), (62, ""), (5, "W1 w1"), (5, "W1 w1")]
    got = lm.scores(spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    expected = sorted(plain_scores(rows, lm.BACKOFF), key=key)
    for g, e in zip(sorted(map(tuple, got), key=key), expected, strict=True):
        assert g[:5] == e[:5]
        assert g[5:] == pytest.approx(e[5:], abs=1e-8)


def test_probabilities_after_any_history_add_up(spark):
    rows = [(k, "a b a c") for k in (1, 2, 3)]
    held = {r.doc_id: r.score for r in lm.scores(spark.createDataFrame([*rows, (4, "a"), (5, "b"), (6, "c"), (7, "")], "doc_id long, text string"), held=F.col("doc_id") > 3).collect()}
    # One word and the end, for every word, the end at once, and an unknown word.
    total = sum(c for c in (15,))
    p_end = lambda w: (3 * (w == "c") + lm.BACKOFF * (3 + 0.1) / (total + 0.5)) / ({"a": 6, "b": 3, "c": 3}[w] + lm.BACKOFF)
    first = sum(10 ** held[k] / p_end(w) for k, w in ((4, "a"), (5, "b"), (6, "c")))
    unknown = lm.BACKOFF * 0.1 / (total + 0.5) / (3 + lm.BACKOFF)
    assert first + 10 ** held[7] + unknown == pytest.approx(1)


def test_empty_tables_have_no_scores(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_texts_of_two_classes_share_a_cell():
    rng = random.Random(31)
    apart = 0
    for _ in range(3000):
        base = rng.sample(range(10**9), rng.randrange(8, 60))
        fresh = iter(range(2 * 10**9, 3 * 10**9))
        spare = [next(fresh) for _ in range(8)]

        def near(k):
            own = [x for x in base if rng.random() > k] + [x for x in spare if rng.random() < k]
            return np.array(sorted(set(own)) or [1], dtype=np.int64)

        leader, x, y = near(0.05), near(rng.random() / 3), near(rng.random() / 3)
        alike = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in ((x, y), (x, leader), (y, leader))]
        if alike[0] >= 0.8 and min(alike[1:]) < 0.8:
            apart += 1
            assert np.intersect1d(neardup.difference_keys(x, leader, 7, 0.8), neardup.difference_keys(y, leader, 7, 0.8)).size
    assert apart > 50


def test_comparisons_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    counted = []
    verify = neardup._verify

    def counting(pairs, *rest):
        counted.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(neardup, "_verify", counting)
    totals = []
    for size in (150, 300):
        rng = random.Random(8)
        base = words(rng, 150, 10**6)
        rows = [(k, edited(rng, base, rng.randrange(10))) for k in range(size)]
        counted.clear()
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.class_id) for r in got) == plain_classes(rows)
        totals.append(sum(counted))
    # All pairs would be four times as many.
    assert totals[1] <= 2.5 * totals[0], totals


def test_texts_that_meet_no_other_do_not_move(spark):
    rows = spark.range(0, 5000, 1, 4).select("id", F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("address"))
    keys = rows.filter("id % 10 = 3").union(spark.createDataFrame([(-1, None)], rows.schema))
    left = common.marked(rows.union(spark.createDataFrame([(-2, None)], rows.schema)), keys, "address")
    assert left.columns == ["id", "address"]
    assert left.join(keys.select("address"), "address").count() == 500
    assert left.count() < 1000


def test_a_text_is_sent_once_to_be_compared_with_all_its_leaders(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", 3)
    sets = {n: list(range(n % 4, 40 + n)) for n in range(30)}
    items = spark.createDataFrame(list(sets.items()), "node long, items array<long>")
    pairs = [(a, b) for a in (0, 1, 2) for b in range(3, 30)]
    compare, sent = neardup._compare, spark.sparkContext.accumulator(0)

    def counting(threshold):
        run = compare(threshold)

        def told(table):
            sent.add(sum(v is not None and n > 2 for n, v in zip(table["node"].to_pylist(), table["items"].to_pylist(), strict=True)))
            return run(table)

        return told

    monkeypatch.setattr(neardup, "_compare", counting)
    got = neardup._verify(spark.createDataFrame([(*p, False) for p in pairs], "a long, b long, keyed boolean"), items, 10, 0.8).collect()
    want = {(a, b): len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) for a, b in pairs}
    assert sorted((r.a, r.b) for r in got) == sorted(pairs)
    assert all(abs(r.sim - want[r.a, r.b]) < 1e-9 for r in got)
    assert sent.value == 27


def test_one_pass_of_components_divides_nothing_that_is_not_linked(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 30) if k % 10 != 9], "a long, b long")
    part, whole = ({r.node: r.label for r in neardup.components(edges, p).collect()} for p in (1, None))
    assert whole == {n: n // 10 * 10 for n in range(30)}
    assert all(whole[part[n]] == whole[n] for n in whole)
    assert {r.node: r.label for r in neardup._merged(neardup.components(edges, 1), edges).collect()} == whole


def test_band_keys_are_dealt_once_and_texts_move_once(spark, monkeypatch):
    settled, plans = neardup.settled, {}

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return settled(df, name)

    monkeypatch.setattr(neardup, "settled", seen)
    rows = [(n, " ".join(f"w{n // 2}x{k}" for k in range(60 + n % 2))) for n in range(20)] * 2
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: n // 2 * 2 for n in range(20)}
    dealt = [p for p in plans.values() if "explode(keys" in p and "[bucket" in p and "similarities" not in p and "size" in p]
    assert dealt and dealt[0].count("Generate explode(keys") == 1
    # One exchange by address for the texts and one for the candidates at most.
    assert "Exchange hashpartitioning(node" not in plans["candidate-items"]


def test_copies_of_a_text_do_not_make_a_bucket(spark, monkeypatch):
    """Also where the marks let all rows pass, buckets hold texts that differ."""
    monkeypatch.setattr(neardup, "first_rows", lambda rows, nodes: rows)
    rows = [(n, " ".join(f"w{n % 4}x{k}" for k in range(40))) for n in range(40)] + [(50, " ".join(f"w1x{k}" for k in range(41)))]
    got = sorted((r.doc_id, r.class_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [*((n, n % 4) for n in range(40)), (50, 1)]
