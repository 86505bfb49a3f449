import re

from keysieve.llm import phrases


def _rows(df):
    return sorted(tuple(r) for r in df.select("lang", "phrase", "a", "l", "r", "n", "score").collect())


def _sums(spark):
    rows = [("en", 0, [], 500), ("fr", 0, [], 40)]
    rows += [(lang, 1, [w], n) for lang, w, n in (("en", "the", 200), ("en", "a", 60), ("en", "cat", 50), ("en", "dog", 30), ("fr", "the", 10), ("fr", "cat", 12))]
    rows += [("en", 2, ["the", "cat"], 40), ("en", 2, ["the", "dog"], 20), ("en", 2, ["cat", "the"], 15), ("en", 2, ["a", "the"], 11), ("fr", 2, ["the", "cat"], 10)]
    rows += [("en", 3, ["a", "the", "cat"], 10), ("en", 3, ["the", "cat", "the"], 12)]
    return spark.createDataFrame(rows, "lang string, size int, phrase array<string>, n bigint")


def test_only_common_parts_are_repeated(spark, monkeypatch):
    sums = _sums(spark)
    count = {(r.lang, " ".join(r.phrase)): r.n for r in sums.collect()}
    expected = []
    for r in sums.filter("size > 1").collect():
        cuts = []
        for k in range(1, r.size):
            left, right = (count[r.lang, " ".join(p)] for p in (r.phrase[:k], r.phrase[k:]))
            cuts.append((1_000_000 * r.n**2 // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        expected.append((r.lang, " ".join(r.phrase), r.n, left, right, count[r.lang, ""], score))
    for least in (1, 50, 10**9):
        monkeypatch.setattr(phrases, "COMMON", least)
        assert _rows(phrases.scored(sums)) == sorted(expected)
    plan = phrases.scored(sums)._jdf.queryExecution().optimizedPlan().toString()
    # Whatever its count, only the languages' totals are repeated for all salts.
    assert len(re.findall(r"Generate explode\((?!sequence|CASE)", plan)) == 1
