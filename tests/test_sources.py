import base64
import json

import pytest

from keysieve.sources import files as src
from keysieve.sources import folder as fld
from keysieve.sources import shared
from keysieve.sources import snapshots as snap
from keysieve.sources.shared import shared_folder, written


def test_directory_and_manifest(spark, tmp_path):
    root = tmp_path / "repo+1 %41"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a b.py").write_bytes(b"ok \xff\n")
    (root / ".env").write_text("A=1")
    rows = {r.path: r.text for r in src.load_directory(spark, str(root)).collect()}
    assert rows == {"src/a b.py": "ok �\n"}
    manifest = spark.createDataFrame(
        [("r", p, str(root / p)) for p in (".env", "src/a b.py", "gone.py")], "repo string, path string, location string"
    )
    got = {r.path: r.text for r in src.load_manifest(manifest).collect()}
    assert got == {".env": "A=1", "src/a b.py": "ok �\n", "gone.py": None}


def test_decode(spark):
    body = base64.encodebytes("héllo wörld, a longer line that wraps over the limit of 76 characters, twice".encode()).decode()
    rows = [("a", "base64", body), ("b", "base64", "aMOpIQ"), ("c", "base64", "a-_/!aMO"), ("d", "none", "x"), ("e", "base64", ""), ("f", None, "x")]
    good, bad = src.decode_contents(spark.createDataFrame(rows, "id string, encoding string, content string"))
    got = {r.id: r.text for r in good.collect()}
    assert got["a"].startswith("héllo wörld") and got["b"] == "hé!" and set(got) == {"a", "b", "c"}
    assert sorted(r.id for r in bad.collect()) == ["d", "e", "f"]


def test_snapshot_documents(spark):
    files = spark.createDataFrame(
        [("r", "src/a.js", "\nconst k = 'sk-" + "a" * 20 + "'"), ("r", "b.js", "")], "repo string, path string, text string"
    )
    documents = snap.snapshot_documents(files, "2024-01-01T00:00:00.000Z")
    row = documents.collect()[0]
    content = json.loads(row.document)
    assert content["open"] == 1 and content["updatedAt"] == "2024-01-01T00:00:00.000Z"
    finding = content["findings"][0]
    assert (finding["fileName"], finding["line"], finding["character"]) == ("a.js", 2, 12)
    assert "sk-aaaaaaa" not in row.document
    back = snap.snapshot_findings(snap.parse_snapshots(documents)).collect()[0]
    assert (back.provider, back.envVarName) == ("openai", "OPENAI_API_KEY")


def test_parse_fallbacks(spark):
    texts = [None, "", "{", "[]", '{"open": 7}', '{"findings": [{"line": 3}], "open": "2", "updatedAt": ""}', '{"findings": 4, "updatedAt": "t"}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, document string")
    got = [(r.updated_at, r.open, len(r.findings)) for r in snap.parse_snapshots(rows).orderBy("id").collect()]
    assert got == [(None, 0, 0)] * 4 + [(None, 7, 0), (None, 1, 1), ("t", 0, 0)]


def test_snapshot_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "repo string, line int")
    snap.write_snapshot(rows, str(tmp_path / "s"), "now")
    findings, totals = snap.read_snapshot(spark, str(tmp_path / "s"), rows.schema)
    assert sorted((r.repo, r.open, r.updated_at) for r in totals.collect()) == [("a", 2, "now"), ("b", 1, "now")]
    assert findings.count() == 3


def test_shared_folder_comes_from_the_session(spark):
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    again = written(spark.range(5), "numbers")
    assert again.count() == 5 and folder in again.inputFiles()[0]


def test_own_folder_where_the_setting_is_missing(spark, monkeypatch):
    monkeypatch.setattr(shared, "_named_folder", lambda session: None)
    assert shared_folder(spark) == shared_folder(spark)
    assert written(spark.range(3), "numbers").count() == 3


def test_unreadable_places_keep_their_row(spark, tmp_path, monkeypatch):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "x.py").write_text("k = 1")
    manifest = spark.createDataFrame([("r", "d", str(tmp_path)), ("r", "n", None), ("r", "x", f"file://{tmp_path}/deep/er/x.py")],
                                     "repo string, path string, location string")
    got = {r.path: (r.text, r.reason is None) for r in src.load_manifest(manifest).collect()}
    assert got == {"d": (None, False), "n": (None, False), "x": ("k = 1", True)}


def test_relative_roots(spark, tmp_path):
    import os

    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "x.py").write_text("k = 1")
    for root in (os.path.relpath(tmp_path), f"{tmp_path}/./deep/..", f"file://{tmp_path}/"):
        assert [r.path for r in src.load_directory(spark, root).collect()] == ["deep/er/x.py"], root


def test_a_cluster_needs_a_shared_folder():
    import types

    import pytest

    session = types.SimpleNamespace(
        conf=types.SimpleNamespace(get=lambda *_: None),
        sparkContext=types.SimpleNamespace(getConf=dict, master="spark://host:7077", applicationId="app-x"),
    )
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_snapshot_tables_by_another_key(spark, tmp_path):
    findings = spark.createDataFrame([("w1", "a.py", "hidden")], "workspace string, path string, value string")
    scans = spark.createDataFrame([("w1",), ("w2",)], "workspace string")
    snap.write_snapshot(findings, str(tmp_path / "s"), "now", by="workspace", scans=scans)
    rows, totals = snap.read_snapshot(spark, str(tmp_path / "s"), "workspace string, path string, value string", by="workspace")
    assert [tuple(r) for r in rows.collect()] == [("w1", "a.py", None)]
    assert sorted((r.workspace, r.open, r.updated_at) for r in totals.collect()) == [("w1", 1, "now"), ("w2", 0, "now")]


def test_snapshot_numbers_stay_as_they_are(spark):
    texts = ['{"open": 2.7, "updatedAt": 1700000000000}', '{"open": "3", "updatedAt": 0, "findings": [{"line": 1}]}', '{"open": 0, "updatedAt": "", "findings": [{"line": 1}]}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, document string")
    got = [(r.open, r.updated_at, len(r.findings)) for r in snap.parse_snapshots(rows).orderBy("id").collect()]
    assert got == [(2.7, "1700000000000", 0), (1.0, None, 1), (0.0, None, 1)]


def test_folder_source(spark, tmp_path):
    root = tmp_path / "in %41"
    rows = [(".env", "A=1"), ("src/_x.py", "\u00e9\U0001f600\r\n"), ("a/b c.ts", ""), ("none.md", None), ("a/big.js", "x" * 300_000)]
    assert fld.write_folder(spark.createDataFrame(rows, "path string, text string"), str(root)) == 5
    (root / "bad.ts").write_bytes(b"a\xffb")
    fld.register_folders(spark)
    for limit in (1, 100_000, 1 << 30):
        found = spark.read.format("source_files").option("taskBytes", limit).load(str(root))
        got = {r.path: (r.size, r.text, r.reason) for r in found.collect()}
        assert got == {p: (len((t or "").encode()), t or "", None) for p, t in rows} | {"bad.ts": (3, "a\ufffdb", None)}
    one_each = spark.read.format("source_files").option("taskBytes", 1).load(str(root))
    assert one_each.rdd.getNumPartitions() == 6
    (tmp_path / "empty").mkdir()
    assert spark.read.format("source_files").load(str(tmp_path / "empty")).isEmpty()


def test_files_are_grouped_by_bytes():
    files = [("a", 10), ("b", 10**9), ("c", 20), ("d", 0)]
    groups = [[n for n, _ in g.files] for g in fld.grouped(files, 10**6)]
    assert sorted(groups) == [["a", "c", "d"], ["b"]]
    # Empty files cost something too.
    assert len(fld.grouped([(str(i), 0) for i in range(100)], 10 * fld.OPEN_BYTES)) == 10


def test_a_file_that_is_gone_keeps_its_row(tmp_path):
    reader = fld._FolderReader(str(tmp_path), 1 << 20)
    (tmp_path / "x").write_text("1")
    (group,) = reader.partitions()
    (tmp_path / "x").unlink()
    (batch,) = reader.read(group)
    assert batch.to_pylist() == [{"path": "x", "size": 1, "text": None, "reason": "FileNotFoundError"}]
    with pytest.raises(ValueError):
        fld.SourceFiles({}).reader(None)
