import datetime as dt
import random
import shutil

from pyspark.sql import functions as F
from test_history import SCHEMA, fold

from keysieve.operators.detect import annotate_spans
from keysieve.sources.snapshots import parse_snapshots
from keysieve.streaming import saves as live


def _write(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def test_running_stats_over_batches_and_restart(spark, tmp_path):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    events = [
        (rng.choice("abc"), start + dt.timedelta(minutes=13 * i), i, *(("fix", None) if rng.random() < 0.5 else ("scan", rng.randint(0, 6))))
        for i in range(300)
    ]
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "ckpt")
    stats = live.RunningStats(spark, str(tmp_path / "state"))
    last = -1
    # Each part is a run of its own: the query starts again from its checkpoint.
    for part in range(3):
        _write(spark, events[part * 100 : part * 100 + 100], SCHEMA, folder, f"part={part}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/part=*")
        query = stats.start(stream, checkpoint)
        query.awaitTermination()
        last = query.lastProgress["batchId"] if query.lastProgress else last
        state, _ = fold(events[: part * 100 + 100])
        versions = sorted(p.name for p in (tmp_path / "state").iterdir())
        newest = int(versions[-1].split("=")[1])
        got = {r.workspace: (r.found, r.fixed, r.open) for r in stats.state(newest).collect()}
        assert got == state
    # A repeated batch reads the same earlier version and writes the same state.
    before = sorted(map(tuple, stats.state(newest).collect()))
    stats.update(spark.createDataFrame(events[200:], SCHEMA), newest)
    assert sorted(map(tuple, stats.state(newest).collect())) == before


def _saves(rng, n):
    start = dt.datetime(2024, 1, 1)
    out = []
    for seq in range(n):
        kind = "close" if rng.random() < 0.2 else "save"
        text = None if kind == "close" else "".join(f"k = 'sk-{rng.randint(0, 9):020d}'\n" for _ in range(rng.randint(0, 3)))
        path = rng.choice(["a.ts", "b/c.py", "notes.md", "../x.ts"])
        out.append((rng.choice("uv"), path, start + dt.timedelta(minutes=rng.randint(0, 500)), seq, kind, text))
    return out


def test_current_spans_keep_the_newest_save(spark, tmp_path):
    saves = _saves(random.Random(2), 120)
    folder = str(tmp_path / "in")
    for part in range(3):
        _write(spark, saves[part * 40 : part * 40 + 40], live.SAVE_SCHEMA, folder, f"part={part}")
    stream = live.read_saves(spark, f"{folder}/part=*", maxFilesPerTrigger=1)
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r.workspace, r.path] = (r.seq, r.is_open, len(r.spans))

    query = live.current_spans(stream).writeStream.outputMode("update").foreachBatch(keep)
    query.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    expected = {}
    for ws, path, _, seq, kind, text in sorted(saves, key=lambda s: (s[2], s[3])):
        if path in ("a.ts", "b/c.py"):
            expected[ws, path] = (seq, kind == "save", (text or "").count("sk-"))
    assert seen == expected


def test_published_findings_equal_a_batch_scan(spark, tmp_path):
    saves = _saves(random.Random(4), 60)
    folder = str(tmp_path / "in")
    for part in range(2):
        _write(spark, saves[part * 30 : part * 30 + 30], live.SAVE_SCHEMA, folder, f"part={part}")
    findings = live.scan_saves(live.read_saves(spark, f"{folder}/part=*", maxFilesPerTrigger=1))
    query = live.publish_snapshots(findings, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination()
    got = spark.read.json(str(tmp_path / "out" / "batch=*"))
    assert "value" not in got.columns
    usable = [s for s in saves if s[4] == "save" and s[1] in ("a.ts", "b/c.py")]
    batch = annotate_spans(spark.createDataFrame(usable, live.SAVE_SCHEMA)).selectExpr("sum(size(spans)) AS n").collect()[0].n
    assert got.count() == batch > 0


def test_running_stats_of_events_in_any_order(spark, tmp_path):
    rng = random.Random(12)
    start = dt.datetime(2024, 1, 1)
    events = [
        (rng.choice(["a", "b", None]), start + dt.timedelta(minutes=rng.randint(0, 400)), i, *(("fix", None) if rng.random() < 0.5 else ("scan", rng.randint(0, 6))))
        for i in range(240)
    ]
    dealt = rng.sample(events, len(events))
    stats = live.RunningStats(spark, str(tmp_path / "state"))
    for batch in range(4):
        # The last batch also brings again what the first has brought.
        rows = dealt[batch * 60 : batch * 60 + 60] + (dealt[:20] if batch == 3 else [])
        stats.update(spark.createDataFrame(rows, SCHEMA), batch)
        known = sorted(dealt[: batch * 60 + 60], key=lambda e: (e[1], e[2]))
        expected, _ = fold(known)
        assert {r.workspace: (r.found, r.fixed, r.open) for r in stats.state(batch).collect()} == expected
    # A batch that runs again after later ones leaves their state as it is.
    stats.update(spark.createDataFrame(dealt[60:120], SCHEMA), 1)
    assert {r.workspace: (r.found, r.fixed, r.open) for r in stats.state(3).collect()} == expected


def test_published_documents_follow_every_batch(spark, tmp_path):
    saves = _saves(random.Random(7), 100)
    folder = str(tmp_path / "state")
    state = live.CurrentSnapshots(spark, folder, lambda batch: f"batch {batch}", fold_every=2)
    for batch in range(5):
        state.update(spark.createDataFrame(saves[batch * 20 : batch * 20 + 20], live.SAVE_SCHEMA), batch)
        expected = {}
        for ws, path, _, seq, kind, text in sorted(saves[: batch * 20 + 20], key=lambda s: (s[2], s[3])):
            if path in ("a.ts", "b/c.py"):
                expected[ws, path] = (seq, (text or "").count("sk-")) if kind == "save" else None
        parsed = parse_snapshots(state.documents()).collect()
        assert {(r.workspace, r.path): (r.seq, r.open) for r in parsed} == {k: v for k, v in expected.items() if v}
        assert all(len(r.findings) == r.open and r.updated_at.startswith("batch ") for r in parsed)
        totals = {}
        for (ws, _), value in expected.items():
            totals[ws] = (totals.get(ws, (0, 0))[0] + (value[1] if value else 0), totals.get(ws, (0, 0))[1] + bool(value))
        assert {r.workspace: (r.open, r.documents) for r in state.totals().collect()} == totals
    # What a batch has written without publishing it is not seen.
    before = sorted(map(tuple, state.documents().collect()))
    state._changes.write(state._changes.rows(0, 4).drop("version").withColumn("seq", F.lit(10**6)), 5)
    shutil.rmtree(tmp_path / "state" / "changes" / "published" / "version=000000000005")
    assert sorted(map(tuple, state.documents().collect())) == before
    stored = "".join(p.read_bytes().decode("latin-1") for p in (tmp_path / "state").rglob("*.parquet"))
    assert "sk-0000" not in stored


def test_saves_meet_the_newest_modified_set(spark, tmp_path):
    sets = live.ModifiedSets(spark, str(tmp_path / "sets"))
    text = "k = 'sk-" + "0" * 20 + "'"
    saves = spark.createDataFrame(
        [("u", p, dt.datetime(2024, 1, 1), i, "save", text) for i, p in enumerate(["a.ts", "b.ts", "../a.ts", "a.md"])] + [("v", "a.ts", None, 9, "save", text)], live.SAVE_SCHEMA
    )
    assert sets.members(saves).isEmpty()
    changed = "repo string, status string, path string, old_path string"
    assert sets.replace(spark.createDataFrame([("u", " M", "a.ts", None), ("u", " M", "a.md", None), ("u", "??", "../a.ts", None)], changed)) == 0
    assert [r.seq for r in sets.members(saves).collect()] == [0]
    assert sets.replace(spark.createDataFrame([("u", "R ", "b.ts", "a.ts")], changed)) == 1
    assert [r.seq for r in sets.members(saves).collect()] == [1]
