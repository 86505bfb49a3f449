from pyspark.sql import functions as F

from keysieve.functions import paths


def _column(spark, values, build):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(build(F.col("v"))).collect()]


def test_supported(spark):
    values = ["src/app.py", "infra/main.tf", "config/.env", "readme.md", "A.JSX", "a.py\n", "py", "x.env.example", "a.yml"]
    assert _column(spark, values, paths.is_supported) == [True, True, True, False, True, False, False, False, True]


def test_skipped_segments(spark):
    values = ["node_modules/a.js", "src/web/a.js", "a/out", "webapp/a.js", "outer/a.js", ".git/config", "a.git/x"]
    assert _column(spark, values, paths.is_skipped) == [True, True, True, False, False, True, False]


def test_confined(spark):
    values = ["a.py", "", "../a.py", "/a.py", "..a/b.py", "a/../b.py"]
    assert _column(spark, values, paths.is_confined) == [True, False, False, False, True, True]


def test_repo_references(spark):
    values = {
        "https://github.com/owner/repo": ("owner", "repo"),
        "http://GITHUB.com/o/n.git": ("o", "n"),
        "https://github.com/o/n.git/": ("o", "n"),
        "git@github.com:o/n.git": ("o", "n"),
        " o/n ": ("o", "n"),
        "git@gitlab.com:o/n": ("git@gitlab.com:o", "n"),
        "https://example.org/o/n": None,
        "o": None,
        "": None,
        None: None,
    }
    got = _column(spark, list(values), paths.repo_owner_and_name)
    assert [tuple(g) if g else None for g in got] == list(values.values())


def test_clone_slug(spark):
    values = ["https://github.com/o/n.git", "git@github.com:o/n", "n", "https://h/a b/c?d", "/"]
    assert _column(spark, values, paths.clone_slug) == ["o-n", "git_github.com_o-n", "n", "a_b-c_d", "repo"]


def test_editor_language(spark):
    values = ["a.ts", "a.TSX", "b.cjs", "b.jsx", "c.py", "Makefile"]
    expected = ["typescript", "typescriptreact", "javascript", "javascriptreact", None, None]
    assert _column(spark, values, paths.editor_language) == expected
