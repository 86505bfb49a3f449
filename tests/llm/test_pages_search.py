import datetime as dt
import datetime
import html.parser
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysieve.llm import search, urls, warc
from keysieve.llm.common import new_folder


def at(day):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)


EVENTS = [
    ("spam", "host:a.example.com", "add", at(10)), ("spam", "host:a.example.com", "add", at(12)), ("spam", "host:a.example.com", "remove", at(20)),
    ("spam", "host:a.example.com", "add", at(30)), ("spam", "host:a.example.com", "remove", at(30)),
    ("bad", "domain:example.com", "add", at(15)), ("bad", "domain:example.com", "add", at(15)), ("allow", "prefix:a.example.com/ok", "add", at(16)),
    ("bad", None, "add", at(1)), ("bad", "host:b.org", "hide", at(1)), ("bad", "host:b.org", "remove", at(1)),
]
CAPTURES = [
    (1, "http://A.example.com:80/x", at(9)), (2, "http://a.example.com/x", at(10)), (3, "https://u@a.example.com./ok/1?q", at(17)),
    (4, "http://a.example.com", at(20)), (5, "http://a.example.com", at(40)), (6, None, at(40)), (7, "not a url", at(40)), (8, "http://a.example.com", None),
    (9, "http://x.y.example.com/okay", at(15)), (9, "http://x.y.example.com/okay", at(15)), (10, "http://b.org/", at(5)), (11, "http://notexample.com/", at(40)),
]


def test_entries_hold_from_their_start_to_their_end(spark):
    events = spark.createDataFrame(EVENTS, "list string, key string, action string, at timestamp")
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_at timestamp").withColumn("blocked", F.lit("clash")).withColumn("key", F.lit(1))
    rows = sorted((r.page_id, r.lists, r.blocked) for r in urls.filter_captures(captures, events).collect())
    assert rows == [
        (1, "", False), (2, "spam", True), (3, "allow,bad,spam", False), (4, "bad", True), (5, "bad,spam", True), (6, "", False), (7, "", False),
        (8, "", False), (9, "bad", True), (9, "bad", True), (10, "", False), (11, "", False),
    ]


def test_empty_lists_and_captures(spark):
    events = spark.createDataFrame([], "list string, key string, action string, at timestamp")
    captures = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_at timestamp")
    assert urls.filter_captures(captures, events).filter("blocked").count() == 0
    assert urls.filter_captures(captures.limit(0), events).count() == 0


class Reader(html.parser.HTMLParser):
    """Text by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in ("p", "br", "div", "li", "h1", "title", "body", "article", "nav"):
            self.words.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        if tag in ("p", "div", "li", "h1", "title", "article", "nav"):
            self.words.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


PAGES = [
    (1, "http://a.b/c", at(0), '<html lang="fr"><head><title>T &amp; t</title><script>var t="</p>";</script></head><body><p>one<b>two</b><br>three &lt;x&gt;<!-- <p>no</p> --></body>'),
    (2, None, None, None),
    (3, "http://a.b/d\r\nX: y", at(1), ""),
    (4, "u", at(2), "<p>unclosed <a href='x>y'>link</a> 1 < 2 <script>gone"),
    (5, "u", at(3), "<p>" + "word " * 100_000),
    (5, "u", at(3), "<p>" + "word " * 100_000),
]


@pytest.fixture(scope="module")
def records(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, fetched_at timestamp, html string").withColumn("block", F.lit("clash"))
    return warc.responses(pages)


def test_texts_equal_the_standard_parser(spark):
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(50).collect():
        reader = Reader()
        reader.feed(row.html)
        assert warc.plain_text(row.html).split() == "".join(reader.words).split()


def test_derivatives_are_linked(records):
    sources = {r.record_id: r for r in records.collect()}
    found = warc.derivatives(records).collect()
    assert len(found) == 2 * len(PAGES)
    for r in found:
        headers = {h["name"]: h["value"] for h in r.headers}
        source = {h["name"]: h["value"] for h in sources[r.refers_to].headers}
        assert headers["WARC-Refers-To"] == r.refers_to and headers["WARC-Date"] == source["WARC-Date"]
        assert headers.get("WARC-Target-URI") == source.get("WARC-Target-URI")
        assert headers["Content-Length"] == str(len(r.block)) and headers["WARC-Block-Digest"] == warc.sha1_digest(bytes(r.block))
        if r.type == "metadata":
            fields = dict(line.split(": ", 1) for line in bytes(r.block).decode().split("\r\n") if line)
            assert fields["source-warc-payload-digest"] == source["WARC-Payload-Digest"]
    texts = [bytes(r.block).decode() for r in found if r.type == "conversion"]
    assert "T & t\nonetwo\nthree <x>" in texts and "unclosed link 1 < 2" in texts


def test_files_come_back(spark, records):
    both = records.unionByName(warc.derivatives(records))
    path = new_folder(spark, "warc-test")
    warc.write_warc(both, path)
    key = lambda r: (r.type, r.record_id, tuple((h["name"], h["value"]) for h in r.headers), bytes(r.block))
    assert sorted(map(key, warc.read_warc(spark, path).collect())) == sorted(map(key, both.collect()))


def test_no_records_of_no_pages(spark, records):
    assert warc.derivatives(records.filter("false")).count() == 0


def plain_top(rows, k):
    scaled = {}
    usable = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(usable):
        if q % 5:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for m, (i, b) in enumerate(usable) if m != n)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [16, 4096])
def test_search_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300, rows[5][1]), (300, rows[5][1]), (5, rows[7][1])]
    rows += [(400, None), (405, [1.0, None]), (410, [float("nan"), 1.0]), (415, [float("inf")]), (None, [1.0] * 8), (420, []), (425, [2.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = search.top_k(table, F.col("vec_id") % 5 == 0, k=5, block=block).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_top(rows, 5)


def test_large_components_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1e6, 1e6) for _ in range(6)]) for i in range(40)]
    got = search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, k=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_top(rows, 3)


def test_no_block_goes_through_the_driver(spark, capsys):
    rows = [(i, [float(i % 7), float(i % 11)]) for i in range(200)]
    search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0, block=16).explain()
    plan = capsys.readouterr().out
    # Blocks of queries are repeated for each part of the data: a join would let Spark gather all copies in the driver.
    assert "MapInArrow" in plan and "Broadcast" not in plan and "Join" not in plan


@pytest.mark.parametrize(("values", "spread"), [(1 << 22, 32), (64, 3), (1, 100)])
def test_cells_of_any_shape_equal_brute_force(spark, monkeypatch, values, spread):
    monkeypatch.setattr(search, "QUERY_VALUES", values)
    monkeypatch.setattr(search, "SPREAD", spread)
    rng = np.random.default_rng(2)
    # Scores in single and double precision and in whole numbers, for one query and in one cell.
    rows = [(int(i), (rng.normal(size=6) * size).tolist()) for i, size in enumerate(rng.choice([0.01, 1.0, 100.0, 1e6], 120))]
    # Equal rows in many blocks, ids against their order: ties go to the smaller id.
    rows += [(1000 - i, [1.0, -2.0, 3.0]) for i in range(90)] + [(2000 + i, [0.5]) for i in range(60)] + [(5, rows[7][1]), (1000, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search.top_k(table, F.col("vec_id") % 5 == 0, k=4, block=16).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_top(rows, 4)


@pytest.mark.parametrize("size", [1, 3, 4])
def test_lists_go_on_from_block_to_block(size):
    rng = np.random.default_rng(size)
    v = np.floor(10.0**size * rng.normal(size=(700, 5))).astype(np.int64)
    v[::3] = v[1] + rng.integers(0, 3, size=(234, 5))
    ids, rows = rng.permutation(700), np.arange(700)
    side = lambda at: {"v": v[at], "id": ids[at], "row": rows[at]}
    asks = side(rows[:90])
    best, tree = search.Best(90, 7), search.CoverTree(asks["v"], 8, 2)
    for start in range(0, 700, 50):
        data = side(rows[start : start + 50])
        search.dual_search(tree, search.CoverTree(data["v"]), asks, data, best)
    for a in range(90):
        others = sorted((-int(v[a] @ v[b]), int(ids[b])) for b in range(700) if b != a)[:7]
        assert list(zip((-best.score[a]).tolist(), best.id[a].tolist(), strict=True)) == others


@pytest.mark.parametrize(("leaf", "few"), [(32, 1), (8, 3), (256, 16)])
def test_every_point_is_in_one_leaf_within_reach(leaf, few):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-99, 99, size=(300, 4)), np.full((200, 4), 7), rng.integers(-3, 3, size=(300, 4))])
    tree = search.CoverTree(x, leaf, few)
    assert sorted(np.concatenate([m for m in tree.members if m is not None]).tolist()) == list(range(800))
    for centre, radius, below, children in zip(tree.centres, tree.radii, tree.below, tree.children, strict=True):
        assert np.sqrt(((x[below] - x[centre]) ** 2).sum(1)).max() <= radius + 1e-6
        assert not children or sorted(np.concatenate([tree.below[c] for c in children]).tolist()) == sorted(below.tolist())


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])]])
def test_nothing_to_find(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert search.top_k(table, F.col("vec_id") % 5 == 0).count() == 0


def test_dates_are_utc_in_any_session_zone(spark):
    seconds = [1704082638, 0, -1, 1711846800, 1711843200, 4102444799, None]
    pages = spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "page_id long, s long").selectExpr(
        "page_id", "'http://a.org/' AS url", "'<p>x' AS html", "timestamp_seconds(s) AS fetched_at"
    )
    expected = [dt.datetime.fromtimestamp(s or 0, dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ") for s in seconds]
    for zone in ("UTC", "America/New_York", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            records = warc.responses(pages).select(warc.header("WARC-Date").alias("d"), warc.header("WARC-Target-URI").alias("u"))
            assert sorted(r.d for r in records.collect()) == sorted(expected)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
