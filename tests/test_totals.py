import datetime as dt
import random
import shutil

from pyspark.sql import functions as F
from test_streaming import _saves

from keysieve.operators.history import audit_trail
from keysieve.sources.versions import MergedTable
from keysieve.streaming import current as keyed
from keysieve.streaming import saves as live
from keysieve.streaming import totals as kept

START = dt.datetime(2024, 1, 1)
AUDIT = "workspace string, ts timestamp, seq bigint, kind string, n_open bigint, provider string, severity string, secret_type string, path string"


def _recounted(saves):
    """Totals by going through all files again."""
    newest = {}
    for ws, path, _, seq, kind, text in sorted(saves, key=lambda s: (s[2], s[3])):
        if path in ("a.ts", "b/c.py"):
            newest[ws, path] = None if kind == "close" else text.count("sk-")
    out = {}
    for (ws, _), n in newest.items():
        documents, found = out.get(ws, (0, 0))
        out[ws] = (documents + (n is not None), found + (n or 0))
    return {ws: (d, n, max(0, 100 - 20 * n), n, n) for ws, (d, n) in out.items()}


def test_totals_equal_a_recount_after_every_batch(spark, tmp_path):
    saves = _saves(random.Random(21), 100)
    # Null names are files like others, and repeated saves change nothing.
    saves += [(None, "a.ts", START, 900, "save", "k = 'sk-" + "1" * 20 + "'"), *saves[:10]]
    random.Random(3).shuffle(saves)
    state = kept.RunningTotals(spark, str(tmp_path / "state"), fold_every=2)
    columns = ("documents", "open", "score", "critical", "openai")

    def totals():
        return {r.workspace: tuple(r[c] for c in columns) for r in state.totals().collect()}

    for batch in range(5):
        state.update(spark.createDataFrame(saves[batch * 22 : batch * 22 + 22], live.SAVE_SCHEMA), batch)
        assert totals() == _recounted(saves[: batch * 22 + 22])
    # A batch that runs again after later ones and after a fold leaves all as it is.
    before = totals()
    for batch in (4, 3):
        state.update(spark.createDataFrame(saves[batch * 22 : batch * 22 + 22], live.SAVE_SCHEMA), batch)
    assert totals() == before
    state.update(spark.createDataFrame([], live.SAVE_SCHEMA), 5)
    assert totals() == before
    stored = "".join(p.read_bytes().decode("latin-1") for p in (tmp_path / "state").rglob("*.parquet"))
    assert "sk-0" not in stored and "sk-1" not in stored


def test_closed_workspaces_keep_a_row_of_zeros(spark, tmp_path):
    state = kept.RunningTotals(spark, str(tmp_path / "state"))
    text = "k = 'sk-" + "1" * 20 + "'"
    state.update(spark.createDataFrame([("u", "a.ts", START, 1, "save", text)], live.SAVE_SCHEMA), 0)
    state.update(spark.createDataFrame([("u", "a.ts", START, 2, "close", None)], live.SAVE_SCHEMA), 1)
    row = state.totals().collect()[0]
    assert (row.documents, row.open, row.score, row.openai) == (0, 0, 100, 0)
    # A save from before the close comes late.
    state.update(spark.createDataFrame([("u", "a.ts", START, 0, "save", text)], live.SAVE_SCHEMA), 2)
    assert state.totals().collect() == [row]


def test_audit_rows_after_any_split(spark, tmp_path):
    rng = random.Random(5)
    events = [
        (
            rng.choice(["a", "b", None]), START + dt.timedelta(minutes=rng.randint(0, 40)), i,
            *(("fix", None) if rng.random() < 0.5 else ("scan", rng.randint(0, 2))), "aws", "high", "key", "src/f.ts",
        )
        for i in range(150)
    ]
    rng.shuffle(events)
    state = kept.RunningAudit(spark, str(tmp_path / "state"), keep=7, fold_every=3)
    for batch in range(5):
        rows = events[batch * 30 : batch * 30 + 30] + events[:10]
        state.update(spark.createDataFrame(rows, AUDIT), batch)
        whole = audit_trail(spark.createDataFrame(events[: batch * 30 + 30], AUDIT), 7)
        assert sorted(map(str, state.trail().collect())) == sorted(map(str, whole.collect()))
    state.update(spark.createDataFrame(events[60:90], AUDIT), 2)
    whole = audit_trail(spark.createDataFrame(events, AUDIT), 7)
    assert sorted(map(str, state.trail().collect())) == sorted(map(str, whole.collect()))


def test_merged_table_folds(spark, tmp_path):
    table = MergedTable(spark, str(tmp_path / "t"), "k int, n bigint", lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), 2)
    assert table.before(0).isEmpty()
    for batch in range(5):
        table.write(spark.createDataFrame([(1, 1), (batch, 10)], "k int, n bigint"), batch)
    assert {r.k: r.n for r in table.state().collect()} == {0: 10, 1: 15, 2: 10, 3: 10, 4: 10}
    assert {r.k: r.n for r in table.before(3).collect()} == {0: 10, 1: 13, 2: 10}
    # After the fold of batch 3, earlier changes are not needed.
    before = sorted(map(tuple, table.state().collect()))
    for batch in range(4):
        shutil.rmtree(tmp_path / "t" / "changes" / "rows" / f"version={batch:012d}")
    assert sorted(map(tuple, table.state().collect())) == before


def test_keyed_state_loses_closed_files(spark, tmp_path):
    text = "k = 'sk-" + "1" * 20 + "'"

    def at(minute):
        return START + dt.timedelta(minutes=minute)

    batches = [
        [("u", f"f{i}.ts", at(i), i, "save", text) for i in range(6)] + [(None, "n.ts", at(1), 50, "save", text)],
        # Four files are closed; a save from before its file's close comes after it.
        [("u", f"f{i}.ts", at(10 + i), 10 + i, "close", None) for i in range(4)],
        [("u", "f0.ts", at(9), 9, "save", text), ("u", "f5.ts", at(300), 20, "save", "")],
        # The watermark has passed the closes, so their state goes.
        [("u", "f5.ts", at(301), 21, "save", text + "\n" + text)],
        [("u", "f5.ts", at(302), 22, "save", text)],
    ]
    folder = str(tmp_path / "in")
    seen, sizes = {}, []

    def keep(batch, _):
        for r in batch.collect():
            assert all(f.redacted == "sk-1...11" for f in r.findings)
            seen[r.workspace, r.path] = (r.seq, r.is_open, len(r.findings))

    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, live.SAVE_SCHEMA).coalesce(1).write.parquet(f"{folder}/part={number}")
        stream = live.read_saves(spark, f"{folder}/part=*")
        writer = keyed.current_findings(stream, "30 minutes").writeStream.outputMode("update").foreachBatch(keep)
        query = writer.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert seen == {
        ("u", "f0.ts"): (10, False, 0), ("u", "f1.ts"): (11, False, 0), ("u", "f2.ts"): (12, False, 0), ("u", "f3.ts"): (13, False, 0),
        ("u", "f4.ts"): (4, True, 1), ("u", "f5.ts"): (22, True, 1), (None, "n.ts"): (50, True, 1),
    }
    assert sizes[1] == 7 and sizes[-1] == 3
