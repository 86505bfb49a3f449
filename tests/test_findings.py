from pyspark.sql import functions as F

from keysieve import detect, detect_located
from keysieve.operators import findings as fnd
from keysieve.operators import summary as summ

KEY = "sk-" + "a" * 20


def _files(spark):
    rows = [("r", "src\\x\\a.js", f"a = '{KEY}';\nb = '{KEY}'"), ("r", "b.js", ""), ("s", "c.js", None), ("s", "d.js", "pwd='12345678'")]
    return spark.createDataFrame(rows, "repo string, path string, text string")


def test_snapshots_hide_the_value(spark):
    rows = fnd.snapshots(detect_located(_files(spark)))
    assert "value" not in rows.columns
    assert {(r.repo, r.file_name, r.line, r.character) for r in rows.collect()} == {
        ("r", "a.js", 1, 6), ("r", "a.js", 2, 6), ("s", "d.js", 1, 6),
    }


def test_diagnostics(spark):
    rows = fnd.diagnostics(detect_located(_files(spark))).collect()
    assert {(r.level, r.code) for r in rows} == {("Error", "hardcoded-openai-secret"), ("Information", "hardcoded-generic-secret")}


def test_lookup_touches_both_ends(spark):
    cursors = [(4, 4, True, 5), (5, 5, True, 5), (28, 28, True, 5), (29, 29, False, 5), (28, 60, True, 5), (30, 60, True, 36)]
    selections = spark.createDataFrame(
        [("r", "src\\x\\a.js", s, e) for s, e, _, _ in cursors] + [("r", "b.js", 0, 1)],
        "repo string, path string, sel_start int, sel_end int",
    )
    got = {(r.path, r.sel_start, r.sel_end): (r.touches, r.start) for r in fnd.finding_at(_files(spark), selections).collect()}
    expected = {("src\\x\\a.js", s, e): (t and s >= 5 or s == 30, start) for s, e, t, start in cursors}
    assert got == expected | {("b.js", 0, 1): (None, None)}


def test_first_findings(spark):
    rows = fnd.first_findings(detect_located(_files(spark))).collect()
    assert {(r.repo, r.path, r.line) for r in rows} == {("r", "src\\x\\a.js", 1), ("s", "d.js", 1)}


def test_summary_fills_zeros(spark):
    summary = summ.scan_summary(_files(spark))
    got = {r.repo: (r.open, r.scanned, r.score, r.critical, r.medium, r.high, r.openai, r.generic, r.aws) for r in summary.collect()}
    assert got == {"r": (2, 2, 60, 2, 0, 0, 2, 0, 0), "s": (1, 2, 80, 0, 1, 0, 0, 1, 0)}
    assert summ.by_severity(summary).count() == 6 and summ.by_provider(summary).count() == 16
    stats = {r.repo: (r.open, r.scanned, r.score) for r in summ.scan_stats(_files(spark)).collect()}
    assert stats == {"r": (2, 2, 60), "s": (1, 2, 80)}


def test_score_never_falls_below_zero(spark):
    assert [r[0] for r in spark.range(4, 8).select(summ.score(F.col("id"))).collect()] == [20, 0, 0, 0]


def test_spans_are_found_once(spark, sf_dir):
    """No filter repeats the span computation, and the scan reads two columns."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plan = detect_located(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 20
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


def test_cube_keeps_null_keys_apart_from_totals(spark):
    rows = [("a", "aws", "high"), (None, "aws", "high"), ("all", None, None)]
    got = {tuple(r) for r in summ.finding_cube(spark.createDataFrame(rows, "repo string, provider string, severity string")).collect()}
    assert got == {
        ("a", "all", "all", "repo", 1), (None, "all", "all", "repo", 1), ("all", "all", "all", "repo", 1),
        ("all", "aws", "high", "provider,severity", 2), ("all", None, None, "provider,severity", 1), ("all", "all", "all", "", 3),
    }


def test_insight_report_of_scans_without_files_or_findings(spark):
    files = spark.createDataFrame([("x", "b.ts", "let k = 1"), ("y", "a.ts", "t = 'ghp_" + "a1" * 18 + "'")], "repo string, path string, text string")
    history = spark.createDataFrame([("y", 4, 3)], "repo string, found long, fixed long")
    scans = spark.createDataFrame([("x",), ("y",), ("z",), ("z",)], "repo string")
    x, y, z = summ.insight_report(files, history, scans=scans).orderBy("repo").collect()
    assert (x.scanned, x.open, x.first_issue, x.first_location) == (1, 0, summ.NOTHING_OPEN, "none")
    assert (y.scanned, y.open, y.found, y.fixed, y.first_location) == (1, 1, 4, 3, "a.ts:1:6") and "GITHUB" in y.first_issue
    assert (z.scanned, z.open, z.score, z.first_issue) == (0, 0, 100, summ.NOTHING_OPEN)


def test_lookup_in_stored_findings_equals_detection(spark):
    text = "a = '" + KEY + "'; " * 40 + "\n" + "x" * 300 + "\nb = '" + KEY + "'\n" + "pwd = '" + "p" * 700 + "'"
    files = spark.createDataFrame([("r", "a.js", text), ("r", "b.js", "nothing"), (None, "a.js", text)], "repo string, path string, text string")
    cursors = [(a, b) for a in (0, 5, 28, 29, 200, 460, 900, 5000) for b in (a, a + 3, a + 600)]
    rows = [(r, p, i, a, b) for r, p in (("r", "a.js"), ("r", "b.js"), ("q", "a.js"), (None, "a.js")) for i, (a, b) in enumerate(cursors)]
    selections = spark.createDataFrame(rows, "repo string, path string, sel int, sel_start int, sel_end int")
    found = detect(files).select("repo", "path", "ordinal", "rule_order", "start", "end")
    known = selections.filter("repo is not null")
    expected = sorted(map(str, fnd.finding_at(files, known).collect()))
    for size in (7, 128, 4096):
        got = fnd.stored_finding_at(found, known, bin_size=size)
        assert sorted(map(str, got.collect())) == expected
    assert fnd.stored_finding_at(found, selections).count() == len(rows)
