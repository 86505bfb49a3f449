import datetime as dt
import random

from pyspark.sql import functions as F

from keysieve.operators import history as hist

SCHEMA = "workspace string, ts timestamp, seq bigint, kind string, n_open bigint"


def _events(rng, n, workspaces=("a", "b", "c")):
    start = dt.datetime(2024, 3, 1)
    out = []
    for seq in range(n):
        fix = rng.random() < 0.5
        ts = start + dt.timedelta(minutes=rng.randint(0, 60 * 60))
        out.append((rng.choice(workspaces), ts, seq, "fix" if fix else "scan", None if fix else rng.randint(0, 9)))
    return out


def fold(events):
    """Sequential reading of the counters."""
    state, steps = {}, {}
    for ws, _, seq, kind, n in sorted(events, key=lambda e: (e[1], e[2])):
        found, fixed, opened = state.get(ws, (0, 0, 0))
        if kind == "scan":
            found, opened = max(found, fixed + n), n
        else:
            fixed, opened = fixed + 1, max(0, opened - 1)
        state[ws] = steps[seq] = (found, fixed, opened)
    return state, steps


def test_running_stats_equal_the_fold(spark):
    events = _events(random.Random(3), 2000)
    df = spark.createDataFrame(events, SCHEMA)
    state, steps = fold(events)
    for chunk in (None, F.dayofmonth("ts"), F.lit(0), (F.unix_timestamp("ts") / 60).cast("bigint")):
        got = {r.seq: (r.found, r.fixed, r.open) for r in hist.running_stats(df, chunk).collect()}
        assert got == steps
        assert {r.workspace: (r.found, r.fixed, r.open) for r in hist.latest_stats(df, chunk).collect()} == state


def test_no_window_over_events_spans_a_workspace(spark):
    df = spark.createDataFrame(_events(random.Random(1), 10), SCHEMA)
    plan = hist.running_stats(df)._jdf.queryExecution().optimizedPlan().toString()
    over_events = [line for line in plan.splitlines() if "Window [" in line and "rel_" in line.rsplit(" AS ", 1)[-1]]
    assert over_events and all("chunk" in line for line in over_events)


def test_events_are_shuffled_once(spark, sf_dir, tmp_path):
    df = spark.createDataFrame(_events(random.Random(1), 10), SCHEMA)
    df.write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = hist.running_stats(events)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("ReusedExchange") == 1


def test_workspace_scans(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for seq in range(800):
        close = rng.random() < 0.2
        ts = start + dt.timedelta(minutes=rng.randint(0, 3000))
        rows.append((rng.choice("ab"), rng.choice("xyz"), ts, seq, "close" if close else "scan", None if close else rng.randint(0, 4)))
    documents, expected = {}, {}
    for ws, path, _, seq, kind, n in sorted(rows, key=lambda r: (r[2], r[3])):
        documents[ws, path] = n or 0
        expected[seq] = sum(v for (w, _), v in documents.items() if w == ws)
    df = spark.createDataFrame(rows, "workspace string, path string, ts timestamp, seq bigint, kind string, n_open int")
    assert {r.seq: r.n_open for r in hist.workspace_scans(df).collect()} == expected
    open_now = {(r.workspace, r.path) for r in hist.current_documents(df).collect()}
    last = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        last[r[0], r[1]] = r[4]
    assert open_now == {k for k, kind in last.items() if kind == "scan"}


def test_audit_trail(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("w", at, i, "scan", i % 3, None, None, None, None) for i in range(60)]
    rows.append(("w", at, 99, "fix", None, "aws", "high", "AWS access key ID", "a\\b/c.ts"))
    df = spark.createDataFrame(rows, SCHEMA + ", provider string, severity string, secret_type string, path string")
    got = hist.audit_trail(df).orderBy("audit_rank").collect()
    assert len(got) == 20 and got[0].action == "remediation" and got[0].provider == "aws"
    assert got[0].summary == "Moved AWS access key ID out of c.ts"
    assert [r.seq for r in got[1:4]] == [59, 58, 56]
    assert got[1].summary == "2 open findings after scan" and got[2].summary == "1 open finding after scan"
    plan = hist.audit_trail(df)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 20, Partial" in plan


def test_null_keys_keep_their_events(spark):
    ts = [f"2024-01-01 0{h}:00:00" for h in range(3)]
    events = spark.createDataFrame([(None, ts[0], 1, "scan", 2), ("w", ts[0], 2, "scan", 1), (None, ts[1], 3, "fix", None)],
                                   "workspace string, ts string, seq long, kind string, n_open long").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = sorted((r.workspace or "", r.found, r.fixed, r.open) for r in hist.running_stats(events).collect())
    assert rows == [("", 2, 0, 2), ("", 2, 1, 1), ("w", 1, 0, 1)]
    documents = events.filter("kind = 'scan'").withColumn("path", F.lit(None).cast("string"))
    assert sorted((r.workspace or "", r.n_open) for r in hist.workspace_scans(documents).collect()) == [("", 2), ("w", 1)]


def test_a_burst_spreads_over_all_tasks(spark):
    rng = random.Random(31)
    now = dt.datetime(2024, 5, 5)
    events = [("w", now, i, *(("fix", None) if rng.random() < 0.5 else ("scan", rng.randint(0, 6)))) for i in range(2000)]
    table = spark.createDataFrame(rng.sample(events, len(events)), SCHEMA).repartition(4)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with_coalescing_off = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged, chunk = hist._ranged(table, None)
        sizes = [r["count"] for r in ranged.groupBy(chunk.alias("chunk")).count().collect()]
        assert len(sizes) == partitions and max(sizes) < 2 * len(events) / partitions
        state, steps = fold(events)
        got = {r.seq: (r.found, r.fixed, r.open) for r in hist.running_stats(table).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_coalescing_off)
    assert got == steps
    assert {r.workspace: (r.found, r.fixed, r.open) for r in hist.latest_stats(table).collect()} == state
