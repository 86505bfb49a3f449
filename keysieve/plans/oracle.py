"""Expected results of the registered queries, as DuckDB SQL.

Written from the operators' definitions and not from the Spark plans: spans
come from DuckDB's own regex engine, overlap is a plain anti join, history is
one window per workspace.
"""

from __future__ import annotations

from keysieve.catalog import PROVIDERS, SEVERITIES, default_catalog
from keysieve.functions.paths import EXTENSION_LANGUAGE, SUPPORTED_EXTENSIONS
from keysieve.operators import triage as tri
from keysieve.plans.corpus import duck_ctes

LF, CR = "chr(10)", "chr(13)"
_CLASS_SPACE = (
    r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*"
)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _quoted(body: str) -> str:
    return "|".join(f"{q}(?:{body}){q}" for q in "\"'`")


def _named(names: str, body: str) -> str:
    return f"(?i)\\b(?:{names})\\b{_CLASS_SPACE}[:=]{_CLASS_SPACE}(?:{_quoted(body)})"


# The rules' patterns, as far as DuckDB can spell them. DuckDB
# regexes have neither back references nor lookaround: one alternative per
# quote, and the "not sk-ant-" condition is applied to the value.
_PATTERNS = (
    _quoted("sk-ant-[A-Za-z0-9_-]{16,}"),
    _quoted("sk-[A-Za-z0-9_-]{20,}"),
    _quoted("(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{20,}"),
    _quoted("(?:AKIA|ASIA)[0-9A-Z]{16}"),
    _named("aws_secret_access_key|secret_access_key", "[A-Za-z0-9/+=]{40}"),
    _quoted("(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    _quoted("xox[baprs]-[A-Za-z0-9-]{10,}"),
    _quoted("AIza[0-9A-Za-z_-]{35}"),
    "-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    _named("password|passwd|pwd|secret", r"[^\x22\x27\x60\r\n]{8,}"),
)
_SUPPORTED = f"regexp_matches(path, '(?i)\\.(?:{'|'.join(SUPPORTED_EXTENSIONS)})\\z')"

_RULES = "rules(rule_order, provider, secret_type, severity, env_var, headline, risk) AS (VALUES " + ", ".join(
    f"({i}, {text(r.provider)}, {text(r.secret_type)}, {text(r.severity)}, {text(r.env_var)}, {text(r.headline)}, {text(r.risk)})"
    for i, r in enumerate(default_catalog().rules, start=1)
) + ")"


def _matches() -> str:
    parts = [
        f"SELECT repo, path, doc_id, {i} AS rule_order, regexp_extract_all(text, {text(rx)}) AS m, "
        f"string_split_regex(text, {text(rx)}) AS g FROM files WHERE regexp_matches(text, {text(rx)})"
        for i, rx in enumerate(_PATTERNS, start=1)
    ]
    return " UNION ALL ".join(parts)


def _ctes(*names: str) -> list[str]:
    return [f"{k} AS ({v})" for k, v in duck_ctes(*names).items()]


_DETECTION = [
    f"files AS (SELECT * FROM planted WHERE {_SUPPORTED})",
    f"matched AS ({_matches()})",
    "numbered AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM matched)",
    """valued AS (SELECT repo, path, doc_id, rule_order, m[i] AS hit,
        CASE WHEN rule_order = 9 THEN m[i] ELSE regexp_extract(m[i], '([^\\x22\\x27\\x60]*)[\\x22\\x27\\x60]$', 1) END AS value,
        coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
          + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS ofs
      FROM numbered)""",
    """spans AS (SELECT repo, path, doc_id, rule_order, value, CAST(ofs + position(value IN hit) - 1 AS INT) AS s,
        CAST(ofs + position(value IN hit) - 1 + length(value) AS INT) AS e
      FROM valued WHERE NOT (rule_order = 2 AND starts_with(value, 'sk-ant-')))""",
    """kept AS (SELECT * FROM spans a WHERE rule_order < 10 OR NOT EXISTS (SELECT 1 FROM spans b
        WHERE b.repo = a.repo AND b.path = a.path AND b.rule_order < 10 AND b.s < a.e AND b.e > a.s))""",
    """found AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo, path ORDER BY s) - 1 AS INT) AS ordinal FROM kept)""",
]
_LOCATED = [
    """located AS (SELECT f.*, CAST(1 + length(pre) - length(replace(pre, chr(10), '')) AS INT) AS line,
        CAST(length(regexp_extract(pre, '([^\\r\\n]*)$', 1)) + 1 AS INT) AS "character"
      FROM (SELECT found.*, substring(files.text, 1, found.s) AS pre FROM found JOIN files USING (repo, path)) f)""",
]
_DESCRIBED = [
    _RULES,
    """described AS (SELECT l.*, provider, secret_type, severity, env_var,
        headline || ' Read it from process.env.' || env_var || ' before you commit.' AS message,
        risk || ' Detected value: ' || CASE WHEN starts_with(value, '-----BEGIN') THEN '-----BEGIN ***-----'
          WHEN length(value) <= 6 THEN substring(value, 1, 1) || '***'
          ELSE substring(value, 1, 4) || '...' || right(value, 2) END AS explanation
      FROM located l JOIN rules USING (rule_order))""",
]


def _with(ctes: list[str], query: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + query


def _found(query: str, *more: str) -> str:
    return _with([*_ctes("planted"), *_DETECTION, *more], query)


def _located(query: str, *more: str) -> str:
    return _with([*_ctes("planted"), *_DETECTION, *_LOCATED, *_DESCRIBED, *more], query)


def _derived(names: tuple[str, ...], query: str, *more: str) -> str:
    return _with([*_ctes(*names), *more], query)


_COUNTED = """counted AS (SELECT files.repo, count(*) AS scanned,
    coalesce(sum(n), 0) AS open FROM files LEFT JOIN (SELECT repo, path, count(*) AS n FROM found GROUP BY 1, 2) f
    USING (repo, path) GROUP BY 1)"""
_SCORE = "CAST(greatest(0, 100 - 20 * open) AS BIGINT)"


def _zero_filled(label: str, names: tuple[str, ...]) -> str:
    values = ", ".join(f"({text(n)})" for n in names)
    return _found(
        f"""SELECT r.repo, k.{label}, count(f.repo) AS findings FROM (SELECT DISTINCT repo FROM files) r
        CROSS JOIN (VALUES {values}) k({label})
        LEFT JOIN (SELECT repo, {label} FROM found JOIN rules USING (rule_order)) f ON f.repo = r.repo AND f.{label} = k.{label}
        GROUP BY 1, 2""",
        _RULES,
    )


def _targets(commits: int, cap: int, below: int) -> list[str]:
    supported = _SUPPORTED
    return [
        *_ctes("changes", "tree"),
        f"""ranked AS (SELECT *, dense_rank() OVER (PARTITION BY repo ORDER BY committed_at DESC, commit_id DESC) AS r FROM changes)""",
        f"""firsts AS (SELECT repo, path, r, pos FROM ranked WHERE r <= {commits} AND {supported}
            QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY r, pos) = 1)""",
        f"""recent AS (SELECT repo, path, CAST(row_number() OVER (PARTITION BY repo ORDER BY r, pos, path) AS INT) AS position
            FROM firsts QUALIFY position <= {cap})""",
        "tips AS (SELECT DISTINCT repo, commit_id AS sha FROM ranked WHERE r = 1)",
        f"""sample AS (SELECT repo, path, CAST(row_number() OVER (PARTITION BY repo ORDER BY pos, path) AS INT) AS position, head_id AS sha
            FROM tree WHERE type = 'blob' AND path <> '' AND {supported} QUALIFY position <= {cap})""",
        "counts AS (SELECT repo, count(*) AS n FROM recent GROUP BY 1)",
        f"""pool AS (SELECT repo, path, position, 0 AS src FROM recent UNION ALL
            SELECT repo, path, position, 1 FROM sample WHERE coalesce((SELECT n FROM counts WHERE counts.repo = sample.repo), 0) < {below}
              AND NOT EXISTS (SELECT 1 FROM recent WHERE recent.repo = sample.repo AND recent.path = sample.path))""",
        f"""topped AS (SELECT repo, path, CAST(row_number() OVER (PARTITION BY repo ORDER BY src, position) AS INT) AS position
            FROM pool QUALIFY row_number() OVER (PARTITION BY repo ORDER BY src, position) <= {cap})""",
        f"""modes AS (SELECT repo, coalesce(c.n, 0) AS n, CASE WHEN coalesce(c.n, 0) = 0 THEN 'workspace-sample'
            WHEN t.total > c.n THEN 'recent+sample' ELSE 'recent-commits' END AS mode
            FROM (SELECT repo, count(*) AS total FROM topped GROUP BY 1) t LEFT JOIN counts c USING (repo))""",
        f"""chosen AS (SELECT t.repo, t.path, t.position, CASE WHEN mode = 'workspace-sample' THEN 'TREE' ELSE 'COMMIT' END AS status, mode,
            CASE WHEN n < {below} THEN coalesce(h.head_id, tips.sha) ELSE tips.sha END AS sha
            FROM topped t JOIN modes USING (repo) LEFT JOIN tips USING (repo)
            LEFT JOIN (SELECT DISTINCT repo, head_id FROM tree) h USING (repo))""",
    ]


_CLEAN_MODIFIED = f"""cleaned AS (SELECT repo, rename, trim(status) AS status, trim(replace(p, chr(92), '/')) AS path FROM (
    SELECT repo, 'new' AS rename, status, path AS p FROM modified UNION ALL
    SELECT repo, 'second', status, CASE WHEN regexp_matches(status, '[RC]') THEN coalesce(old_path, path) ELSE path END FROM modified) u)"""
_KEPT_MODIFIED = f"kept_modified AS (SELECT * FROM cleaned WHERE path <> '' AND {_SUPPORTED})"


def _running(source: str, columns: str) -> str:
    """found / fixed / open with one window per workspace."""
    over = "OVER (PARTITION BY workspace ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"
    return f"""fixes AS (SELECT *, count(*) FILTER (kind = 'fix') {over} AS fixed FROM {source}),
      lasts AS (SELECT *, last_value(CASE WHEN kind = 'scan' THEN n_open END IGNORE NULLS) {over} AS n_last,
        last_value(CASE WHEN kind = 'scan' THEN fixed END IGNORE NULLS) {over} AS fixed_at,
        max(CASE WHEN kind = 'scan' THEN fixed + n_open END) {over} AS peak FROM fixes),
      running AS (SELECT {columns}, ts, CAST(coalesce(peak, 0) AS BIGINT) AS found, CAST(fixed AS BIGINT) AS fixed,
        CAST(greatest(0, coalesce(n_last, 0) - (fixed - coalesce(fixed_at, 0))) AS BIGINT) AS open FROM lasts)"""


_LATEST = "SELECT workspace, found, fixed, open FROM running QUALIFY row_number() OVER (PARTITION BY workspace ORDER BY ts DESC, seq DESC) = 1"

_NEWEST_DOCUMENT = """newest AS (SELECT * FROM (SELECT * FROM document_events
    QUALIFY row_number() OVER (PARTITION BY workspace, path ORDER BY ts DESC, seq DESC) = 1) n WHERE kind <> 'close')"""

_REPO_HISTORY = [
    *_ctes("history"),
    "repo_events AS (SELECT * REPLACE ('src' || (workspace % 20) || '-en' AS workspace) FROM history)",
    _running("repo_events", "workspace, seq"),
    f"repo_history AS ({_LATEST})",
]

_HOLES = """gaps AS (SELECT repo, doc_id, ordinal, secret_type, env_var, "character",
    CASE WHEN doc_id % 5 = 1 THEN '' ELSE message END AS message, CASE WHEN doc_id % 5 = 2 THEN NULL ELSE explanation END AS explanation,
    CASE WHEN doc_id % 5 = 3 THEN 0 ELSE line END AS line,
    CASE WHEN doc_id % 5 = 1 THEN NULL ELSE regexp_extract(path, '[^/]*$') END AS file_name,
    CASE WHEN doc_id % 5 = 4 THEN 'LOW' ELSE severity END AS severity, CASE WHEN doc_id % 5 = 3 THEN NULL ELSE provider END AS provider,
    CASE WHEN doc_id % 5 = 2 THEN '' ELSE path END AS file_path FROM described)"""


def _cards(source: str, demo: bool, name: str = "cards") -> str:
    """Triage cards of a finding-snapshot relation, as flat columns; empty text and 0 count as missing."""
    known = tri.DEMO_PROVIDERS if demo else tuple(tri.PROVIDER_CONTEXT)
    technique = " ".join(f"WHEN {text(p)} THEN {text(tri.PROVIDER_CONTEXT[p][0])}" for p in known)
    reach = " ".join(f"WHEN {text(p)} THEN {text(tri.PROVIDER_CONTEXT[p][1])}" for p in known)
    scan = "local" if demo else "web"
    name_of = "'source file'" if demo else "regexp_extract(coalesce(nullif(file_path, ''), 'source file'), '[^/]*$')"
    path_of = "coalesce(nullif(file_path, ''), nullif(file_name, ''), 'unknown')" if demo else "coalesce(nullif(file_path, ''), nm)"
    fix = " (editor)" if demo else " (or a secret store)"
    return f"""{name} AS (SELECT *, coalesce(nullif(message, ''), st || ' in a source text') AS issue_found,
        loc AS location, 'remove: ' || st AS intent,
        '{scan} scan: rule ''' || st || ''' in ' || nm || '; allows ' || reach AS reasoning,
        technique AS mitre_tactic, nm || ':' || ln || ' ' || st AS summary,
        coalesce(nullif(explanation, ''), 'allows ' || reach) AS impact,
        CASE WHEN lower(severity) IN ('critical', 'high') THEN 'High' WHEN lower(severity) = 'medium' THEN 'Medium' WHEN lower(severity) = 'low' THEN 'Low' ELSE 'High' END AS card_severity,
        94 AS confidence, 88 AS fluency_score,
        'file=' || loc || '|provider=' || coalesce(nullif(provider, ''), 'unknown') || '|severity=' || coalesce(nullif(severity, ''), 'unknown') || '|secretType=' || st || '|detector={scan}-scan' AS context_used,
        'verify ' || nm || ':' || ln || '|set process.env.' || coalesce(nullif(env_var, ''), 'SECRET') || '{fix}|rotate' AS next_actions
      FROM (SELECT *, {path_of} || ':' || ln || ':' || coalesce(CAST(nullif("character", 0) AS VARCHAR), '?') AS loc FROM (
        SELECT *, coalesce(nullif(file_name, ''), {name_of}) AS nm, coalesce(nullif(secret_type, ''), 'secret') AS st,
          coalesce(CAST(nullif(line, 0) AS VARCHAR), '?') AS ln,
          CASE lower(provider) {technique} ELSE {text(tri.DEFAULT_CONTEXT[0])} END AS technique,
          CASE lower(provider) {reach} ELSE {text(tri.DEFAULT_CONTEXT[1])} END AS reach
        FROM {source}) a) b)"""


_CARD_COLUMNS = (
    "issue_found, location, intent, reasoning, mitre_tactic, summary, impact, card_severity AS severity, confidence, "
    "fluency_score, context_used, next_actions"
)


def _text_field(name: str) -> str:
    return f"CASE WHEN json_type(j, '$.{name}') = 'VARCHAR' THEN trim(json_extract_string(j, '$.{name}')) ELSE '' END"


def _list_field(name: str, limit: int) -> str:
    items = f"""CASE WHEN json_type(j, '$.{name}') = 'ARRAY' THEN array_to_string(list_slice(list_transform(list_filter(
        CAST(json_extract(j, '$.{name}[*]') AS JSON[]), lambda v: json_type(v) = 'VARCHAR' AND trim(json_extract_string(v, '$')) <> ''),
        lambda v: json_extract_string(v, '$')), 1, {limit}), '|') ELSE '' END"""
    return items


def _score_field(name: str, default: int) -> str:
    number = f"CAST(json_extract_string(j, '$.{name}') AS DOUBLE)"
    return (
        f"CAST(CASE WHEN json_type(j, '$.{name}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') "
        f"THEN greatest(0, least(100, floor({number} + 0.5))) ELSE {default} END AS INT)"
    )


_ANSWERED = f"""answered AS (SELECT doc_id, ordinal, {_text_field('issue_found')} AS a_issue, {_text_field('location')} AS a_location,
    {_text_field('intent')} AS a_intent, {_text_field('reasoning')} AS a_reasoning, {_text_field('mitre_tactic')} AS a_mitre,
    {_text_field('summary')} AS a_summary, {_text_field('impact')} AS a_impact,
    CASE WHEN json_extract_string(j, '$.severity') IN ('Low', 'Medium', 'High') THEN json_extract_string(j, '$.severity') ELSE 'Medium' END AS a_severity,
    {_score_field('confidence', 50)} AS a_confidence, {_score_field('fluency_score', 80)} AS a_fluency,
    {_list_field('context_used', 5)} AS a_context, {_list_field('next_actions', 3)} AS a_actions
  FROM (SELECT doc_id, ordinal, CAST(CASE WHEN json_valid(content) THEN content
      WHEN json_valid(regexp_extract(content, '(?s)\\{{.*\\}}')) THEN regexp_extract(content, '(?s)\\{{.*\\}}') END AS JSON) AS j
    FROM answers WHERE content <> '') x WHERE j IS NOT NULL)"""

_FIXED_ALERT = {
    "issue_found": "alert without finding",
    "location": "unknown",
    "intent": "triage: text only",
    "reasoning": "No finding is linked to this alert; its text is all there is.",
    "mitre_tactic": tri.UNSECURED,
    "impact": "not known",
    "card_severity": "High",
    "context_used": "source=insights-summary|detector=unavailable",
    "next_actions": "rescan|link a finding|triage again",
}

_CONFIG = """config AS (SELECT repo, coalesce(max(text) FILTER (path = '.env'), '') AS env_text,
    coalesce(max(text) FILTER (path = '.env.example'), '') AS example_text,
    coalesce(max(text) FILTER (path = '.gitignore'), '') AS ignore_text FROM config_files GROUP BY 1)"""
_SPLIT = "string_split_regex({0}, '\\r?\\n')"
_ENV_LINES = f"env_lines AS (SELECT repo, unnest({_SPLIT.format('env_text')}) AS l FROM config)"
_WANTED = """wanted AS (SELECT f.*, env_var AS variable, env_var || '=' || value AS env_line FROM found f JOIN rules USING (rule_order))"""
_CONFLICTS = """judged AS (SELECT w.*, coalesce(bool_or(starts_with(l, variable || '=') AND trim(l) <> trim(env_line)), false) AS conflict,
    coalesce(bool_or(starts_with(l, variable || '=')), false) AS is_set, coalesce(bool_or(trim(l) = trim(env_line)), false) AS present
  FROM wanted w LEFT JOIN env_lines e ON e.repo = w.repo GROUP BY ALL)"""
_PLANNED = """planned AS (SELECT j.*, CASE WHEN is_set THEN NOT conflict ELSE trim(env_line) = trim(first_line) END AS accepted FROM (
    SELECT *, first_value(env_line) OVER (PARTITION BY repo, variable ORDER BY path, s) AS first_line FROM judged) j)"""
_REMEDIATION = [*_ctes("config_files"), _RULES, _CONFIG, _ENV_LINES, _WANTED, _CONFLICTS, _PLANNED]


def _appended(column: str, additions: str) -> str:
    """Existing text, a line break if it lacks one, then the added lines."""
    return (
        f"CASE WHEN {additions} IS NULL THEN {column} ELSE {column} || CASE WHEN {column} <> '' AND right({column}, 1) <> chr(10) "
        f"THEN chr(10) ELSE '' END || {additions} || chr(10) END"
    )


def _rewritten(start: str, end: str) -> str:
    return _found(
        f"""SELECT repo, path, string_agg(substring(text, previous + 1, s2 - previous) || 'process.env.' || variable, '' ORDER BY s2)
            || any_value(substring(text, last_end + 1)) AS text
          FROM (SELECT *, coalesce(lag(e2) OVER (PARTITION BY repo, path ORDER BY s2), 0) AS previous,
              max(e2) OVER (PARTITION BY repo, path) AS last_end
            FROM (SELECT p.repo, p.path, p.variable, f.text, {start} AS s2, {end} AS e2
              FROM planned p JOIN files f USING (repo, path) WHERE accepted) a) b GROUP BY repo, path""",
        *_REMEDIATION,
    )


_QUOTED_SPAN = (
    "p.s > 0 AND substring(f.text, p.s, 1) IN (chr(34), chr(39), chr(96)) AND substring(f.text, p.s, 1) = substring(f.text, p.e + 1, 1)"
)


def statements() -> dict[str, str]:
    out: dict[str, str] = {}
    languages = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in EXTENSION_LANGUAGE.items())
    language = f"CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)\\z', 1)) {languages} ELSE '' END"
    out["supported_paths"] = _derived(
        ("paths",),
        f"""SELECT doc_id, {_SUPPORTED} AS supported,
            regexp_matches(path, '(^|/)(node_modules|\\.git|out|web)(/|\\z)') AS skipped,
            {language} AS language, {language} <> '' AS in_editor FROM paths""",
    )
    out["detect_spans"] = _found('SELECT repo, path, ordinal, rule_order, s AS "start", e AS "end", value FROM found')
    out["detect_by_rule"] = _found(
        "SELECT provider, secret_type, severity, env_var, count(*) AS findings FROM found JOIN rules USING (rule_order) GROUP BY 1, 2, 3, 4",
        _RULES,
    )
    out["overlap_suppression"] = _found(
        """SELECT repo, path, s AS "start", e AS "end", value FROM spans a WHERE rule_order = 10 AND EXISTS (SELECT 1 FROM spans b
            WHERE b.repo = a.repo AND b.path = a.path AND b.rule_order < 10 AND b.s < a.e AND b.e > a.s)"""
    )
    out["finding_positions"] = _located('SELECT repo, path, ordinal, line, "character" FROM located')
    out["redacted_findings"] = _located(
        """SELECT repo, provider, severity, secret_type, regexp_extract(path, '[^/]*$') AS file_name, path AS file_path, line,
            "character", message, explanation, env_var FROM described"""
    )
    out["diagnostics"] = _located(
        """SELECT repo, path, s AS "start", e AS "end", CASE severity WHEN 'critical' THEN 'Error' WHEN 'high' THEN 'Warning'
            ELSE 'Information' END AS level, 'hardcoded-' || provider || '-secret' AS code, message FROM described"""
    )
    out["range_lookup"] = _derived(
        ("planted", "selections"),
        """SELECT s.repo, s.path, sel, min(ordinal) FILTER (hit) IS NOT NULL AS touches,
            coalesce(arg_min(rule_order, ordinal) FILTER (hit), arg_min(rule_order, ordinal), -1) AS rule_order,
            coalesce(arg_min(s0, ordinal) FILTER (hit), arg_min(s0, ordinal), -1) AS "start",
            coalesce(arg_min(e0, ordinal) FILTER (hit), arg_min(e0, ordinal), -1) AS "end"
          FROM (SELECT s.*, f.ordinal, f.rule_order, f.s AS s0, f.e AS e0, f.s <= s.sel_end AND f.e >= s.sel_start AS hit
            FROM selections s LEFT JOIN found f ON f.repo = s.repo AND f.path = s.path) s GROUP BY 1, 2, 3""",
        *_DETECTION,
    )
    out["first_finding"] = _located(
        """SELECT repo, path, s AS "start", rule_order, line, "character" FROM located
            QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, s) = 1"""
    )
    out["scan_summary"] = _found(f"SELECT repo, CAST(open AS BIGINT) AS open, scanned, {_SCORE} AS score FROM counted", _COUNTED)
    out["snapshot_roundtrip"] = _located(
        """SELECT repo, path, CAST(CASE WHEN whole THEN n ELSE 0 END AS BIGINT) AS open, CASE WHEN whole THEN '2024-01-01T00:00:00.000Z' ELSE '' END AS updated_at,
            CASE WHEN whole THEN provider ELSE '' END AS provider, CASE WHEN whole THEN CAST(line AS VARCHAR) ELSE '' END AS line,
            CASE WHEN whole THEN CAST("character" AS VARCHAR) ELSE '' END AS "character", CASE WHEN whole THEN env_var ELSE '' END AS "envVarName"
          FROM (SELECT *, doc_id % 5 <> 0 AS whole, count(*) OVER (PARTITION BY repo, path) AS n FROM described) d WHERE ordinal = 0"""
    )
    kind = "regexp_extract(path, '[^.]*$')"
    out["scan_stats_all"] = _found(
        f"""SELECT s.repo, s.kind, CAST(coalesce(open, 0) AS BIGINT) AS open, coalesce(scanned, 0) AS scanned, CAST(greatest(0, 100 - 20 * coalesce(open, 0)) AS BIGINT) AS score
          FROM (SELECT DISTINCT repo, {kind} AS kind FROM planted) s LEFT JOIN (
            SELECT repo, {kind} AS kind, count(*) AS scanned, sum(coalesce(n, 0)) AS open FROM files
            LEFT JOIN (SELECT repo, path, count(*) AS n FROM found GROUP BY 1, 2) f USING (repo, path) GROUP BY 1, 2) c USING (repo, kind)"""
    )
    out["finding_cube"] = _located(
        """SELECT coalesce(repo, 'all') AS repo, coalesce(provider, 'all') AS provider, coalesce(severity, 'all') AS severity,
              CASE WHEN grouping(repo) = 0 THEN 'repo' WHEN grouping(provider) = 0 THEN 'provider,severity' ELSE '' END AS grouped_by, count(*) AS findings
            FROM described GROUP BY GROUPING SETS ((repo), (provider, severity), ())"""
    )
    out["redacted_corpus"] = _located(
        """SELECT doc_id, md5(coalesce(head || substring(text, last + 1), text)) AS text_md5 FROM files LEFT JOIN (
            SELECT doc_id, max(e) AS last, string_agg(substring(text, prev + 1, s - prev) || shown, '' ORDER BY s) AS head FROM (
              SELECT d.doc_id, s, e, text, regexp_extract(explanation, 'Detected value: (.*)$', 1) AS shown,
                coalesce(lag(e) OVER (PARTITION BY d.doc_id ORDER BY s), 0) AS prev FROM described d JOIN files USING (repo, path)) x
            GROUP BY 1) y USING (doc_id)"""
    )
    any_rule = " OR ".join(f"regexp_matches(t, {text(rx)})" for rx in _PATTERNS)
    out["raw_text_scan"] = f"""SELECT repo, count(*) FILTER ({any_rule}) AS open, count(*) AS scanned,
        CAST(greatest(0, 100 - 20 * count(*) FILTER ({any_rule})) AS BIGINT) AS score
      FROM (SELECT 'documents' AS repo, text AS t FROM documents UNION ALL SELECT 'pages', html FROM pages
        UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark) u GROUP BY 1"""
    out["severity_zero_fill"] = _zero_filled("severity", SEVERITIES)
    out["provider_zero_fill"] = _zero_filled("provider", PROVIDERS)
    out["scanned_manifest"] = _derived(
        ("planted", "targets"),
        """SELECT t.repo, t.path, t.status, p.path IS NOT NULL AS readable, CAST(coalesce(n, 0) AS INT) AS findings
          FROM targets t LEFT JOIN planted p ON p.repo = t.repo AND p.path = t.path
          LEFT JOIN (SELECT repo, path, count(*) AS n FROM found GROUP BY 1, 2) f ON f.repo = t.repo AND f.path = t.path""",
        *_DETECTION,
    )
    out["manifest_stats"] = _derived(
        ("planted", "targets"),
        f"""SELECT repo, open, scanned, {_SCORE} AS score FROM (
          SELECT t.repo, CAST(coalesce(sum(n), 0) AS BIGINT) AS open, count(*) AS scanned FROM targets t
          LEFT JOIN (SELECT repo, path, count(*) AS n FROM found GROUP BY 1, 2) f ON f.repo = t.repo AND f.path = t.path
          GROUP BY 1) c""",
        *_DETECTION,
    )
    out["changes_normalised"] = _derived(
        ("modified",),
        'SELECT repo, rename, status, path, count(*) AS "rows" FROM kept_modified GROUP BY 1, 2, 3, 4',
        _CLEAN_MODIFIED, _KEPT_MODIFIED,
    )
    out["recent_commit_targets"] = _with(
        _targets(20, 100, 8), "SELECT recent.repo, path, position, sha FROM recent JOIN tips USING (repo)"
    )
    out["tree_sample_targets"] = _with(_targets(20, 100, 8), "SELECT repo, path, position, sha FROM sample")
    out["topup_targets"] = _with(_targets(20, 100, 8), "SELECT * FROM chosen")
    out["topup_targets_small_cap"] = _with(_targets(2, 6, 4), "SELECT * FROM chosen")
    out["target_fallback"] = _derived(
        ("modified", "changes", "tree"),
        """SELECT repo, path, status, mode, count(*) AS "rows" FROM options o
            WHERE rank = (SELECT min(rank) FROM options p WHERE p.repo = o.repo) GROUP BY 1, 2, 3, 4""",
        _CLEAN_MODIFIED, _KEPT_MODIFIED,
        "used AS (SELECT * FROM changes)",
        """tip AS (SELECT repo, commit_id FROM used QUALIFY row_number() OVER (PARTITION BY repo ORDER BY committed_at DESC, commit_id DESC) = 1
              AND min(commit_id) OVER (PARTITION BY repo) <> max(commit_id) OVER (PARTITION BY repo))""",
        f"""walk AS (SELECT repo, path FROM tree WHERE type = 'blob' AND {_SUPPORTED}
            AND NOT regexp_matches(path, '(^|/)(node_modules|\\.git|out|web)(/|\\z)')
            QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 100)""",
        f"""options AS (SELECT repo, path, status, 0 AS rank, 'modified' AS mode FROM kept_modified WHERE rename = 'new'
            UNION ALL SELECT u.repo, path, 'COMMIT', 1, 'latest-commit' FROM used u JOIN tip USING (repo, commit_id)
              WHERE status IN ('A', 'C', 'M', 'R') AND {_SUPPORTED}
            UNION ALL SELECT repo, path, 'TREE', 2, 'workspace-sample' FROM walk)""",
    )
    out["targeted_saves"] = _derived(
        ("modified", "saves"),
        f"""SELECT repo, path, save_id FROM saves s WHERE NOT starts_with(path, '../') AND NOT starts_with(path, '/') AND {_SUPPORTED}
            AND EXISTS (SELECT 1 FROM kept_modified k WHERE k.rename = 'new' AND k.repo = s.repo AND k.path = s.path)""",
        _CLEAN_MODIFIED, _KEPT_MODIFIED,
    )
    parsed = f"""parsed AS (SELECT trim(input, ' ' || {LF}) AS input, regexp_extract(v, '(?i)^(?:https?://github\\.com/|git@github\\.com:|)([^/]+)/([^/]+?)(?:\\.git)?/?$', 1) AS owner,
        regexp_replace(regexp_extract(v, '(?i)^(?:https?://github\\.com/|git@github\\.com:|)([^/]+)/([^/]+)/?$', 2), '(?i)\\.git$', '') AS name,
        regexp_matches(v, '(?i)^(?:https?://github\\.com/[^/]+/[^/]+/?|git@github\\.com:[^/]+/[^/]+|[^/]+/[^/]+)$') AS ok
      FROM (SELECT input, regexp_replace(trim(input, ' ' || {LF}), '(?i)\\.git$', '') AS v FROM repo_refs) r)"""
    out["repo_refs"] = _derived(
        ("repo_refs",),
        """SELECT owner, name, input, links, regexp_replace(CASE WHEN len(seg) > 1 THEN seg[-2] || '-' || seg[-1] ELSE seg[1] END,
              '[^A-Za-z0-9_.-]+', '_', 'g') AS slug
          FROM (SELECT *, list_filter(string_split(regexp_replace(input, '(?i)\\.git$', ''), '/'), lambda x: x <> '') AS seg
            FROM (SELECT owner, name, min(input) AS input, count(*) AS links FROM parsed WHERE ok GROUP BY 1, 2) a) b""",
        parsed,
    )
    out["repo_refs_invalid"] = _derived(
        ("repo_refs",), 'SELECT input, count(*) AS "rows" FROM parsed WHERE NOT ok GROUP BY 1', parsed
    )
    out["history_running"] = _derived(
        ("history",), "SELECT workspace, seq, kind, found, fixed, open FROM running", _running("history", "workspace, seq, kind")
    )
    out["history_latest"] = _derived(("history",), _LATEST, _running("history", "workspace, seq"))
    out["stream_stats"] = _derived(
        ("history",), f"SELECT CAST(workspace AS VARCHAR) AS workspace, found, fixed, open FROM ({_LATEST}) l",
        _running("history", "workspace, seq"),
    )
    out["audit_trail"] = _derived(
        ("history",),
        """SELECT workspace, CAST(row_number() OVER (PARTITION BY workspace ORDER BY ts DESC, seq DESC) AS INT) AS audit_rank, seq,
            CASE kind WHEN 'fix' THEN 'remediation' ELSE 'scan' END AS action,
            CASE kind WHEN 'fix' THEN 'Moved ' || secret_type || ' out of ' || regexp_extract(path, '[^/\\\\]*$')
              ELSE n_open || CASE n_open WHEN 1 THEN ' open finding' ELSE ' open findings' END || ' after scan' END AS summary,
            CASE kind WHEN 'fix' THEN provider ELSE '' END AS provider, CASE kind WHEN 'fix' THEN severity ELSE '' END AS severity
          FROM history WHERE kind = 'fix' OR n_open > 0 QUALIFY audit_rank <= 20""",
    )
    out["current_findings"] = _derived(
        ("document_events",),
        "SELECT workspace, path, seq, CAST(unnest(range(1, n_open + 1)) AS INT) AS number FROM newest WHERE n_open > 0",
        _NEWEST_DOCUMENT,
    )
    out["workspace_totals"] = _derived(
        ("document_events",),
        "SELECT workspace, seq, n_open, found, fixed, open FROM running",
        """deltas AS (SELECT *, n - coalesce(lag(n) OVER (PARTITION BY workspace, path ORDER BY ts, seq), 0) AS d
            FROM (SELECT *, coalesce(n_open, 0) AS n FROM document_events) e)""",
        """totals AS (SELECT workspace, ts, seq, 'scan' AS kind, CAST(sum(d) OVER (PARTITION BY workspace ORDER BY ts, seq
            ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_open FROM deltas)""",
        _running("totals", "workspace, seq, n_open"),
    )
    out["insight_report"] = _located(
        f"""SELECT c.repo, scanned, CAST(open AS BIGINT) AS open, coalesce(h.found, 0) AS found, coalesce(h.fixed, 0) AS fixed, {_SCORE.replace('open', 'c.open')} AS score,
            coalesce(f.message, 'Nothing is open, so there is no finding to show.') AS first_issue,
            coalesce(f.path || ':' || f.line || ':' || f."character", 'none') AS first_location,
            coalesce(f.secret_type || ' (' || f.severity || ')', 'none') AS first_type
          FROM counted c LEFT JOIN (SELECT workspace AS repo, found, fixed FROM repo_history) h USING (repo)
          LEFT JOIN (SELECT * FROM described QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, s) = 1) f USING (repo)""",
        _COUNTED, *_REPO_HISTORY,
    )
    severities = " || ',' || ".join(f"'{s}=' || count(f.repo) FILTER (severity = '{s}')" for s in sorted(SEVERITIES))
    providers = " || ',' || ".join(f"'{p}=' || count(f.repo) FILTER (provider = '{p}')" for p in sorted(PROVIDERS))
    out["dashboard_rollup"] = _found(
        f"""SELECT c.repo, {_SCORE.replace('open', 'c.open')} AS score, coalesce(any_value(h.found), 0) AS found, coalesce(any_value(h.fixed), 0) AS fixed,
            CAST(c.open AS BIGINT) AS open, {severities} AS by_severity, {providers} AS by_provider
          FROM counted c LEFT JOIN (SELECT workspace AS repo, found, fixed FROM repo_history) h ON h.repo = c.repo
          LEFT JOIN (SELECT repo, provider, severity FROM found JOIN rules USING (rule_order)) f ON f.repo = c.repo
          GROUP BY c.repo, c.open""",
        _RULES, _COUNTED, *_REPO_HISTORY,
    )
    out["triage_cards"] = _located(f"SELECT doc_id, ordinal, {_CARD_COLUMNS} FROM cards", _HOLES, _cards("gaps", demo=False))
    out["triage_demo_cards"] = _located(f"SELECT doc_id, ordinal, {_CARD_COLUMNS} FROM cards", _HOLES, _cards("gaps", demo=True))
    ok = "a.doc_id IS NOT NULL"
    merged = ", ".join(
        f"CASE WHEN {ok} THEN {mine} ELSE {local} END AS {name}"
        for name, mine, local in (
            ("issue_found", "coalesce(nullif(a_issue, ''), issue_found)", "issue_found"),
            ("location", "coalesce(nullif(a_location, ''), location)", "location"),
            ("intent", "a_intent", "intent"), ("reasoning", "a_reasoning", "reasoning"),
            ("mitre_tactic", "a_mitre", "mitre_tactic"), ("summary", "a_summary", "summary"), ("impact", "a_impact", "impact"),
            ("severity", "a_severity", "card_severity"), ("confidence", "a_confidence", "confidence"),
            ("fluency_score", "a_fluency", "fluency_score"),
            ("context_used", "coalesce(nullif(a_context, ''), context_used)", "context_used"),
            ("next_actions", "a_actions", "next_actions"),
        )
    )
    out["triage_merge"] = _located(
        f"""SELECT c.doc_id || '#' || c.ordinal AS finding_id,
            CASE WHEN {ok} THEN 'ai-fluency-llm' ELSE 'ai-fluency-local-fallback' END AS mode, true AS ai_enabled, {merged}
          FROM cards c LEFT JOIN answered a ON a.doc_id = c.doc_id AND a.ordinal = c.ordinal""",
        _HOLES, _cards("gaps", demo=False), *_ctes("answers"), _ANSWERED,
    )
    fields = ", ".join(
        f"CASE WHEN {column} IS NULL THEN NULL ELSE '\"{name}\":' || {value} END"
        for column, name, value in (
            (f'"{c}"', n, f'CAST("{c}" AS VARCHAR)' if c in ("line", "character") else f"to_json(\"{c}\")::VARCHAR")
            for c, n in tri.REQUEST_FIELDS.items()
        )
    )
    out["triage_requests"] = _located(
        f"SELECT doc_id, ordinal, '{{' || concat_ws(',', {fields}) || '}}' AS payload FROM gaps", _HOLES
    )
    grounded = ", ".join(
        f"CASE WHEN c.repo IS NOT NULL THEN c.{name} ELSE {'trim(left(alert, 180))' if name == 'summary' else text(_FIXED_ALERT[name])} END AS "
        + ("severity" if name == "card_severity" else name)
        for name in (
            "issue_found", "location", "intent", "reasoning", "mitre_tactic", "summary", "impact", "card_severity",
            "context_used", "next_actions",
        )
    )
    out["alert_cards"] = _located(
        f"""SELECT conv_id, turn, c.repo IS NOT NULL AS is_grounded, {grounded},
            CASE WHEN c.repo IS NOT NULL THEN 94 ELSE 68 END AS confidence, CASE WHEN c.repo IS NOT NULL THEN 88 ELSE 72 END AS fluency_score
          FROM (SELECT conv_id, turn, repo, trim(left(alert, 12000), ' ' || chr(10)) AS alert FROM alerts) a
          LEFT JOIN cards c ON c.repo = a.repo WHERE alert <> ''""",
        *_ctes("alerts"),
        """firsts AS (SELECT *, regexp_extract(path, '[^/]*$') AS file_name, path AS file_path FROM described WHERE repo LIKE '%-en'
            QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, s) = 1)""",
        _cards("firsts", demo=True),
    )
    ignored = f"len(list_filter({_SPLIT.format('ignore_text')}, lambda x: trim(x) = '.env')) > 0"
    out["remediation_plan"] = _found(
        f"""SELECT j.repo, path, ordinal, 'process.env.' || variable AS source_replacement, env_line, variable || '=' AS example_line,
            NOT ({ignored}) AS will_add_ignore,
            CASE WHEN conflict THEN '.env already has an existing ' || variable || ' with another value.' ELSE '' END AS conflict_reason,
            'Source: ' || substring(value, 1, 4) || '... becomes process.env.' || variable || chr(10)
              || 'Update .env: make sure ' || variable || ' is set' || chr(10)
              || 'Update .env.example: make sure the variable is listed' || chr(10)
              || 'Update .gitignore: ' || CASE WHEN {ignored} THEN 'already protected' ELSE 'add .env' END AS preview
          FROM judged j JOIN config c ON c.repo = j.repo""",
        *_REMEDIATION,
    )
    out["repo_plan_conflicts"] = _found("SELECT repo, path, ordinal, variable, accepted FROM planned", *_REMEDIATION)
    out["env_append"] = _found(
        f"""SELECT c.repo, {_appended('env_text', 'env_add')} AS env_text, {_appended('example_text', 'example_add')} AS example_text,
            CASE WHEN {ignored} THEN ignore_text ELSE {_appended('ignore_text', "'.env'")} END AS ignore_text
          FROM config c JOIN (SELECT repo, string_agg(env_line, chr(10) ORDER BY path, s) FILTER (NOT present) AS env_add,
              string_agg(variable || '=', chr(10) ORDER BY path, s) FILTER (NOT listed) AS example_add
            FROM (SELECT p.*, len(list_filter({_SPLIT.format('k.example_text')}, lambda x: trim(x) = variable || '=')) > 0 AS listed
              FROM planned p JOIN config k USING (repo) WHERE accepted
              QUALIFY row_number() OVER (PARTITION BY p.repo, variable ORDER BY path, s) = 1) one GROUP BY repo) a ON a.repo = c.repo""",
        *_REMEDIATION,
    )
    out["rewrite_sources"] = _rewritten("p.s", "p.e")
    out["rewrite_sources_unquoted"] = _rewritten(
        f"CASE WHEN {_QUOTED_SPAN} THEN p.s - 1 ELSE p.s END", f"CASE WHEN {_QUOTED_SPAN} THEN p.e + 1 ELSE p.e END"
    )
    out["decoded_contents"] = (
        "SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS INT) AS chars FROM documents WHERE doc_id % 10 < 8"
    )
    out["undecodable_contents"] = _derived(
        ("fetched",), "SELECT doc_id, encoding FROM fetched WHERE encoding <> 'base64' OR content = ''"
    )
    out["stream_scan_on_save"] = _with(
        [
            f"""files AS (SELECT source AS repo, source, 'src/s' || (doc_id % 8) || '.ts' AS path, doc_id,
                text || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'token = ' || chr(34) || 'ghp_' || md5(CAST(doc_id AS VARCHAR)) || chr(34) ELSE '' END AS text
              FROM documents WHERE doc_id % 9 <> 8)""",
        ],
        f"""SELECT source AS workspace, path, doc_id AS seq, 0 AS ordinal, 3 AS rule_order,
            CAST(1 + length(pre) - length(replace(pre, chr(10), '')) AS INT) AS line,
            CAST(length(regexp_extract(pre, '([^\\r\\n]*)$', 1)) + 1 AS INT) AS "character"
          FROM (SELECT *, regexp_extract(text, '(?s)^(.*[\\x22\\x27\\x60])gh[pousr]_[A-Za-z0-9]{{30,}}[\\x22\\x27\\x60]', 1) AS pre FROM files
            WHERE regexp_matches(text, {text(_PATTERNS[2])})) f""",
    )
    out["stream_current_findings"] = f"""SELECT workspace, path, doc_id AS seq, CAST(len(regexp_extract_all(t, {text(_PATTERNS[2])})) AS INT) AS findings
      FROM (SELECT source AS workspace, 'src/s' || (doc_id % 8) || '.ts' AS path, doc_id, text || chr(10)
          || CASE WHEN doc_id % 3 = 0 THEN 'token = ' || chr(34) || 'ghp_' || md5(CAST(doc_id AS VARCHAR)) || chr(34) ELSE '' END AS t
        FROM documents QUALIFY row_number() OVER (PARTITION BY source, doc_id % 8 ORDER BY doc_id DESC) = 1) d
      WHERE doc_id % 9 <> 8"""
    out["stream_stats_late"] = out["stream_stats"]
    out["range_lookup_stored"] = out["range_lookup"]
    out["history_burst"] = _derived(
        ("history",), "SELECT workspace, seq, kind, found, fixed, open FROM running",
        "burst AS (SELECT * REPLACE ('all' AS workspace, TIMESTAMP '1970-01-01' AS ts) FROM history)",
        _running("burst", "workspace, seq, kind"),
    )
    newest_saves = f"""SELECT source AS workspace, 'src/s' || (doc_id % 8) || '.ts' AS path, doc_id AS seq, doc_id % 9 <> 8 AS is_open,
        CASE WHEN doc_id % 9 <> 8 THEN len(regexp_extract_all(text || chr(10)
          || CASE WHEN doc_id % 3 = 0 THEN 'token = ' || chr(34) || 'ghp_' || md5(CAST(doc_id AS VARCHAR)) || chr(34) ELSE '' END, {text(_PATTERNS[2])})) ELSE 0 END AS n
      FROM documents QUALIFY row_number() OVER (PARTITION BY source, doc_id % 8 ORDER BY doc_id DESC) = 1"""
    out["stream_published_snapshots"] = f"""SELECT workspace, path, seq, '2024-01-01T00:00:00.000Z' AS updated_at, n AS open, n AS findings,
        CASE WHEN n > 0 THEN 'github' ELSE '' END AS provider FROM ({newest_saves}) s WHERE is_open"""
    out["stream_workspace_totals"] = f"""SELECT workspace, CAST(sum(n) AS BIGINT) AS open, count(*) FILTER (is_open) AS documents
      FROM ({newest_saves}) s GROUP BY workspace"""
    out["stream_targeted_scans"] = f"""SELECT * FROM ({out["stream_scan_on_save"]}) s WHERE path IN ('src/s0.ts', 'src/s1.ts', 'src/s2.ts')
      AND EXISTS (SELECT 1 FROM documents d WHERE d.source = s.workspace AND s.path = 'src/s' || (d.doc_id % 3) || '.ts')"""
    counts = ", ".join(
        f"count(rule_order) FILTER ({column} = '{name}') AS {name}" for column, names in (("severity", SEVERITIES), ("provider", PROVIDERS)) for name in names
    )
    out["stream_running_totals"] = _found(
        f"""SELECT workspace, count(DISTINCT n.doc_id) FILTER (is_open) AS documents, count(rule_order) AS open,
            CAST(greatest(0, 100 - 20 * count(rule_order)) AS BIGINT) AS score, {counts}
          FROM (SELECT repo AS workspace, doc_id, doc_id % 9 <> 8 AS is_open FROM files
            QUALIFY row_number() OVER (PARTITION BY repo, doc_id % 8 ORDER BY doc_id DESC) = 1) n
          LEFT JOIN (SELECT doc_id, rule_order, provider, severity FROM found JOIN rules USING (rule_order)) f ON f.doc_id = n.doc_id AND is_open
          GROUP BY workspace""",
        _RULES,
    )
    out["stream_audit_trail"] = f"SELECT * REPLACE (CAST(workspace AS VARCHAR) AS workspace) FROM ({out['audit_trail']}) a"
    out["folder_files"] = """SELECT source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '/.env' WHEN 1 THEN '/_main.py' ELSE '/a b.ts' END AS path,
        octet_length(encode(coalesce(text, ''))) AS size, md5(coalesce(text, '')) AS text_md5 FROM documents"""
    out["stream_keyed_findings"] = out["stream_current_findings"]
    return out


