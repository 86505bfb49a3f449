"""Expected rows of the corpus queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from keysieve.llm import quality, search, secrets


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def op1_quality_rules() -> str:
    bounds = []
    measures = {
        "n_words": "n_words",
        "mean_word": "(CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END)",
        "symbol_ratio": "(CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END)",
        "stop_ratio": "(CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END)",
        "dup_line_ratio": "(CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END)",
        "long_word_ratio": "(CASE WHEN n_words > 0 THEN n_long / n_words ELSE 0 END)",
    }
    for rule in quality.DEFAULT_RULES:
        bounds += [f"{measures[rule.measure]} >= {rule.low}"] if rule.low is not None else []
        bounds += [f"{measures[rule.measure]} <= {rule.high}"] if rule.high is not None else []
    edges = quality.EDGES.replace("'", "''")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             len(list_filter(ws, lambda x: lower(trim(x, '{edges}')) IN ({_quoted(sorted(set(quality.STOP_WORDS)))}))) AS n_stop,
             len(list_filter(ws, lambda x: length(x) > {quality.LONG_WORD})) AS n_long FROM w),
u AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM u),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
s AS (SELECT m.*, coalesce(p.n, 0) AS n_repeat_words FROM m LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(bounds)} AS kept
FROM b
"""


def op4_secret_scans() -> str:
    def any_case(word: str) -> str:
        return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)

    # The kinds, spelled without case flags.
    keyword = f"({any_case('password')}|{any_case('passwd')}|{any_case('secret')}|{any_case('token')}|{any_case('api')}_?{any_case('key')})"
    assign = keyword + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", assign, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    kinds += [(r.kind, r.pattern, r.group, r.least) for r in secrets.MORE_RULES]
    parts, hits = [], []
    for n, (kind, pattern, group, least) in enumerate(kinds):
        p = pattern.replace("'", "''")
        parts.append(
            f"k{n} AS (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS gs, "
            f"string_split_regex(t, '{p}') AS seps FROM d)"
        )
        hits.append(
            f"SELECT doc_id, {n} AS place, '{kind}' AS kind, length(array_to_string(seps[1:i], '')) + length(array_to_string(ms[1:i - 1], '')) AS s, "
            f"length(ms[i]) AS n, length(gs[i]) AS g, {least} AS least FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM k{n} WHERE len(ms) > 0)"
        )
    shown = "kind || ':' || s || ':' || (s + n)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(parts)},
h AS ({" UNION ALL ".join(hits)}),
f AS (SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
             coalesce(string_agg({shown}, ',' ORDER BY s, place) FILTER (place < 3), '') AS base,
             string_agg({shown}, ',' ORDER BY s, place) AS spans FROM h WHERE g >= least GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)
"""


def op7_url_filters() -> str:
    host = r"nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '[.]+$', ''), '')"
    day = "to_timestamp(1704067200 + 86400 * ({}))::TIMESTAMP".format
    turns = [
        ("spam", "add", "n % 3 = 0", "n % 180"), ("spam", "remove", "n % 3 = 0 AND n % 2 = 0", "n % 180 + 30 + n % 60"),
        ("spam", "add", "n % 3 = 0 AND n % 4 = 0", "n % 180 + 120"), ("malware", "add", "n % 5 = 1", "n % 330"),
        ("allow", "add", "n % 7 = 2", "n % 200"), ("allow", "remove", "n % 14 = 2", "n % 200 + 90"),
    ]
    events = " UNION ".join(f"SELECT '{l}' AS list, key, '{a}' AS action, {day(d)} AS ts FROM n WHERE {c}" for l, a, c, d in turns)
    return rf"""
WITH p AS (SELECT page_id, url, {host} AS host, regexp_extract(url, '^[a-z]+://[^/?#]+/([a-z]+)/', 1) AS section,
                  to_timestamp(1704067200 + (page_id * 7919) % 31536000)::TIMESTAMP AS ts,
                  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS steps FROM pages),
k AS (SELECT DISTINCT key FROM (
    SELECT 'host:' || host AS key FROM p
    UNION ALL SELECT 'domain:' || array_to_string(string_split(host, '.')[-2:], '.') FROM p
    UNION ALL SELECT 'prefix:' || host || '/' || section FROM p WHERE section <> '') WHERE key IS NOT NULL),
n AS (SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS BIGINT) AS n FROM k),
e AS ({events}),
q AS (SELECT page_id, ts, 'host:' || host AS key FROM p WHERE host IS NOT NULL
      UNION ALL SELECT page_id, ts, 'domain:' || array_to_string(string_split(host, '.')[i:], '.')
        FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS i FROM p WHERE host IS NOT NULL)
      UNION ALL SELECT page_id, ts, 'prefix:' || host || '/' || array_to_string(steps[1:i], '/')
        FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM p WHERE host IS NOT NULL)),
m AS (SELECT q.page_id, e.list, e.key, arg_max(e.action, e.ts) AS state FROM q JOIN e ON q.key = e.key AND e.ts <= q.ts GROUP BY ALL),
v AS (SELECT page_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists, bool_or(list = 'allow') AS allowed
      FROM m WHERE state = 'add' GROUP BY page_id)
SELECT p.page_id, p.url, p.host, CAST(coalesce(v.n, 0) AS BIGINT) AS n_active, coalesce(v.lists, '') AS lists, v.n IS NOT NULL AND NOT coalesce(v.allowed, false) AS blocked
FROM p LEFT JOIN v USING (page_id)
"""


def op10_exact_top_k() -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({search.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op11_phrase_collocations() -> str:
    # Cutting signs, lengths, least count, share and number of rows of the task.
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM d),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f
      FROM g, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(ws) GROUP BY ALL),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:k.k], ' ')
             JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, a FROM c, (SELECT unnest([1, 2]) AS i) WHERE m = 3) GROUP BY ALL),
o AS (SELECT b.*, t.n FROM b JOIN t USING (lang) LEFT JOIN x USING (lang, phrase) WHERE x.longer IS NULL OR 100 * x.longer < 50 * b.a),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o)
SELECT * FROM r WHERE rank <= 2000
"""


def op13_ngram_jaccard_join() -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS shingle
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
z AS (SELECT s.doc_id, s.shingle, n.n FROM s JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS shared FROM z a JOIN z b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
      WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * shared >= 90 * (an + bn - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM c GROUP BY a)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM m LEFT JOIN n USING (doc_id)
"""


def statements() -> dict[str, str]:
    return {f.__name__: f() for f in (op1_quality_rules, op4_secret_scans, op7_url_filters, op10_exact_top_k, op11_phrase_collocations, op13_ngram_jaccard_join)}
