from keysieve.operators import targets as tgt
from keysieve.operators.scan import manifest_findings, manifest_stats, scan_manifest

CHANGES = "repo string, committed_at int, commit_id string, pos int, status string, path string, old_path string"
TREE = "repo string, head_id string, pos int, path string, type string"


def _changes(spark, *rows):
    return spark.createDataFrame([(*r, None) if len(r) == 6 else r for r in rows], CHANGES)


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_modes_and_sha(spark):
    changes = _changes(
        spark,
        *[("many", 9, "tip", i, "M", f"a{i:02}.py") for i in range(9)],
        ("few", 2, "new", 1, "M", "x.py"), ("few", 1, "old", 1, "M", "y.py"), ("few", 1, "old", 2, "A", "x.py"),
        ("same", 5, "s1", 1, "M", "t1.py"),
        ("docs", 5, "d1", 1, "M", "readme.md"),
        ("bare", 5, "b1", 1, "M", "z.py"),
    )
    tree = spark.createDataFrame(
        [("few", "head-few", i, p, "blob") for i, p in enumerate(["y.py", "t.ts", "n.md", "u.ts"])]
        + [("same", "head-same", 0, "t1.py", "blob"), ("docs", "head-docs", 0, "d.py", "blob")]
        + [("none", "head-none", 0, "q.py", "blob"), ("none", "head-none", 1, "dir.py", "tree")]
        + [("many", "head-many", 0, "zz.py", "blob"), ("bare", "head-bare", 0, "only.md", "blob")],
        TREE,
    )
    got = tgt.repo_targets(changes, tree)
    assert _rows(got.filter("repo <> 'many'"), "repo", "position", "path", "status", "mode", "sha") == [
        ("bare", 1, "z.py", "COMMIT", "recent-commits", "head-bare"),
        ("docs", 1, "d.py", "TREE", "workspace-sample", "head-docs"),
        ("few", 1, "x.py", "COMMIT", "recent+sample", "head-few"),
        ("few", 2, "y.py", "COMMIT", "recent+sample", "head-few"),
        ("few", 3, "t.ts", "COMMIT", "recent+sample", "head-few"),
        ("few", 4, "u.ts", "COMMIT", "recent+sample", "head-few"),
        ("none", 1, "q.py", "TREE", "workspace-sample", "head-none"),
        ("same", 1, "t1.py", "COMMIT", "recent-commits", "head-same"),
    ]
    many = got.filter("repo = 'many'").collect()
    assert len(many) == 9 and {(r["mode"], r["sha"]) for r in many} == {("recent-commits", "tip")}


def test_limits(spark):
    rows = [("r", 1000 - c, f"c{c:03}", p, "M", f"f{c:03}-{p:02}.py") for c in range(30) for p in range(8)]
    got = tgt.recent_commit_targets(_changes(spark, *rows)).orderBy("position").collect()
    assert len(got) == 100 and got[0].path == "f000-00.py" and got[99].path == "f012-03.py"
    wide = tgt.recent_commit_targets(_changes(spark, *rows), cap=1000).collect()
    assert len(wide) == 160


def test_local_fallback(spark):
    modified = spark.createDataFrame(
        [("a", "R ", " src\\m.py ", "old\\m.go"), ("b", "M ", "notes.txt", None)],
        "repo string, status string, path string, old_path string",
    )
    changes = _changes(
        spark, ("a", 1, "c", 1, "M", "c.py"), ("b", 0, "c0", 1, "A", "early.py"), ("b", 1, "c", 1, "D", "gone.py"), ("b", 1, "c", 2, "R100", "kept.py"),
        ("c", 2, "c2", 1, "D", "gone.py"), ("c", 1, "c1", 1, "M", "older.py"),
    )
    tree = spark.createDataFrame(
        [("c", "h", i, p, "blob") for i, p in enumerate(["web/x.js", "b.js", "a/node_modules/z.js", "a.js", "r.md"])], TREE
    )
    got = _rows(tgt.local_targets(modified, changes, tree), "repo", "path", "status", "mode")
    assert got == [
        ("a", "src/m.py", "R", "modified"), ("b", "kept.py", "COMMIT", "latest-commit"),
        ("c", "a.js", "TREE", "workspace-sample"), ("c", "b.js", "TREE", "workspace-sample"),
    ]
    second = tgt.normalise_changes(modified, "second")
    assert _rows(second, "repo", "path", "status") == [("a", "old/m.go", "R")]


def test_caps_run_before_the_shuffle(spark):
    changes = _changes(spark, ("r", 1, "c", 1, "M", "a.py"))
    plan = tgt.recent_commit_targets(changes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4 and "row_number(), 100, Partial" in plan


def test_manifest_routes_agree(spark):
    targets = spark.createDataFrame(
        [("r", "a.py", "M"), ("r", "gone.py", "D"), ("s", "b.py", "A")], "repo string, path string, status string"
    )
    files = spark.createDataFrame(
        [("r", "a.py", 'x\nk = "sk-' + "a" * 20 + '"'), ("s", "b.py", ""), ("s", "unlisted.py", "password='12345678'")],
        "repo string, path string, text string",
    )
    for prefilter in (False, True):
        manifest = scan_manifest(targets, files, prefilter=prefilter)
        assert _rows(manifest, "path", "readable") == [("a.py", True), ("b.py", True), ("gone.py", False)]
        assert _rows(manifest_findings(manifest), "path", "status", "line", "character") == [("a.py", "M", 2, 6)]
        assert _rows(manifest_stats(manifest), "repo", "open", "scanned", "score") == [("r", 1, 2, 80), ("s", 0, 1, 100)]


def test_manifest_reads_the_targets_once_and_in_many_tasks(spark):
    targets = spark.createDataFrame([("r", "a.py")], "repo string, path string")
    files = spark.createDataFrame([("r", "a.py", "x")], "repo string, path string, text string")
    plan = scan_manifest(targets, files)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and plan.count("Scan ExistingRDD") == 2


def test_an_only_commit_has_no_latest_files(spark):
    changes = _changes(spark, ("r", 1, "c", 1, "M", "a.py"), ("s", 1, "c", 1, "M", "b.py"), ("s", 2, "d", 1, "M", "c.py"))
    assert _rows(tgt.latest_commit_targets(changes), "repo", "path") == [("s", "c.py")]
