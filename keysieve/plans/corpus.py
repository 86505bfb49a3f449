"""Inputs of the registered queries, derived row by row from the supplied tables.

The supplied texts hold no credential of a covered kind, so each document gets
one synthetic snippet line (chosen by its id) appended to its whole text. The
other tables re-shape orders, line items, customers, events and conversations.
Every table grows with the tables it comes from.

Each definition is plain SQL that Spark and DuckDB both run, so the expected
results can be computed on equal inputs by other means.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

_DQ, _SQ, _BT, _LF, _CR, _BS = "chr(34)", "chr(39)", "chr(96)", "chr(10)", "chr(13)", "chr(92)"


def _part_path(key: str) -> str:
    return (
        f"'src/p' || ({key}) || CASE ({key}) % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.md' "
        "WHEN 3 THEN '.tf' ELSE '.json' END"
    )


_SNIPPET = f"""CASE doc_id % 12
  WHEN 0 THEN 'const k = ' || {_DQ} || 'sk-ant-' || h || {_DQ} || ';'
  WHEN 1 THEN 'const k = ' || {_DQ} || 'sk-' || h || {_DQ} || ';'
  WHEN 2 THEN 'tok = ' || {_SQ} || 'ghp_' || h || {_SQ}
  WHEN 3 THEN 'id = ' || {_DQ} || 'AKIA' || upper(substring(h, 1, 16)) || {_DQ}
  WHEN 4 THEN 'aws_secret_access_key = ' || {_SQ} || substring(x, 1, 40) || {_SQ}
  WHEN 5 THEN 'k = ' || {_BT} || 'sk_live_' || h || {_BT}
  WHEN 6 THEN 't = ' || {_DQ} || 'xoxb-' || h || {_DQ} || {_CR} || {_LF} || 'g = ' || {_DQ} || 'AIza'
    || substring(x, 1, 35) || {_DQ}
  WHEN 7 THEN '-----BEGIN RSA PRIVATE KEY-----'
  WHEN 8 THEN 'password = ' || {_DQ} || 'password' || {_DQ}
  WHEN 9 THEN 'secret = ' || {_DQ} || 'sk-' || h || {_DQ}
  WHEN 10 THEN 'PASSWORD: ' || {_SQ} || h || {_SQ} || '; pwd=' || {_DQ} || h || {_DQ}
  ELSE 'token = ' || {_DQ} || h || {_DQ} || ', ' || {_DQ} || 'password' || {_DQ} || ': ' || {_DQ} || h || {_DQ}
    || ', API_KEY=sk-' || h
END"""

# {name} is another table or definition; @sha256@ is the engine's function.
DEFINITIONS: dict[str, str] = {
    "planted": f"""
        SELECT repo, path, doc_id, text || {_LF} || {_SNIPPET} AS text
        FROM (
          SELECT doc_id, text, source || '-' || lang AS repo,
            'src/d' || doc_id || CASE CAST(floor(doc_id / 12) AS BIGINT) % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.py'
              WHEN 2 THEN '.env' WHEN 3 THEN '.json' WHEN 4 THEN '.tf' ELSE '.md' END AS path,
            md5(CAST(doc_id AS STRING)) AS h, @sha256@ AS x
          FROM {{documents}}
        ) d""",
    "paths": f"""
        SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'node_modules/a/' WHEN 1 THEN 'src/web/' WHEN 2 THEN 'webapp/'
            WHEN 3 THEN 'lib/.git/' WHEN 4 THEN 'a/out/b/' ELSE 'src/' END
          || 'd' || doc_id || CASE doc_id % 11 WHEN 0 THEN '.TS' WHEN 1 THEN '.tsx' WHEN 2 THEN '.mjs'
            WHEN 3 THEN '.yaml' WHEN 4 THEN '.md' WHEN 5 THEN '/.env' WHEN 6 THEN '.env.example'
            WHEN 7 THEN '.hcl' WHEN 8 THEN '.jsx' WHEN 9 THEN '.go' || {_LF} ELSE '.ps1' END AS path
        FROM {{documents}}""",
    "changes": f"""
        SELECT repo, committed_at, commit_id, pos, status, path, old_path FROM (
          SELECT 'c' || o.o_custkey AS repo, o.o_orderdate AS committed_at,
            'k' || (100000000 + o.o_orderkey) AS commit_id, l.l_linenumber AS pos,
            CASE WHEN l.l_returnflag = 'R' THEN 'R' WHEN l.l_returnflag = 'A' THEN 'A'
              WHEN l.l_linestatus = 'F' THEN 'D' ELSE 'M' END AS status,
            {_part_path('l.l_partkey')} AS path,
            CASE WHEN l.l_returnflag = 'R' THEN {_part_path('l.l_partkey + 1')} END AS old_path
          FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey
          UNION ALL
          SELECT 'n' || c.c_nationkey, o.o_orderdate, 'k' || (100000000 + o.o_orderkey), l.l_linenumber,
            CASE WHEN l.l_returnflag = 'R' THEN 'R' WHEN l.l_returnflag = 'A' THEN 'A'
              WHEN l.l_linestatus = 'F' THEN 'D' ELSE 'M' END,
            {_part_path('l.l_partkey')},
            CASE WHEN l.l_returnflag = 'R' THEN {_part_path('l.l_partkey + 1')} END
          FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey
            JOIN {{customer}} c ON o.o_custkey = c.c_custkey
        ) u""",
    "tree": f"""
        SELECT 'n' || c_nationkey AS repo, 'h' || c_nationkey AS head_id, CAST(c_custkey AS BIGINT) AS pos,
          {_part_path('c_custkey')} AS path, 'blob' AS type
        FROM {{customer}}
        UNION ALL
        SELECT 'c' || c_custkey, 'h' || c_custkey, CAST(i AS BIGINT),
          CASE WHEN i = 4 THEN 'web/a' || i || '.ts' WHEN i = 7 THEN 'node_modules/b' || i || '.js'
            WHEN i = 9 THEN 'docs/readme.md' WHEN i = 11 THEN 'lib' ELSE {_part_path('(c_custkey * 7 + i * 13) % 200')} END,
          CASE WHEN i = 11 THEN 'tree' ELSE 'blob' END
        FROM (SELECT c_custkey, @upto12@ AS i FROM {{customer}}) e""",
    "modified": f"""
        SELECT 'c' || o_custkey AS repo, CASE o_orderkey % 4 WHEN 0 THEN ' M' WHEN 1 THEN '??' WHEN 2 THEN 'R ' ELSE 'A ' END
            AS status,
          CASE o_orderkey % 3 WHEN 0 THEN ' ' ELSE '' END || 'src' || {_BS} || 'm' || o_orderkey
            || CASE o_orderkey % 5 WHEN 0 THEN '.txt' ELSE '.py' END AS path,
          CASE o_orderkey % 4 WHEN 2 THEN 'old/m' || o_orderkey || '.go' END AS old_path
        FROM {{orders}} WHERE o_custkey % 3 = 0""",
    "saves": """
        SELECT 'c' || o_custkey AS repo, o_orderkey AS save_id, CASE o_orderkey % 6 WHEN 0 THEN '../' WHEN 1 THEN '/' ELSE '' END
          || 'src/m' || (o_orderkey - o_orderkey % 2) || '.py' AS path
        FROM {orders}""",
    "repo_refs": f"""
        SELECT CASE c_custkey % 8 WHEN 0 THEN 'https://github.com/' || o || '/' || n
            WHEN 1 THEN 'HTTPS://GitHub.com/' || o || '/' || n || '.git/' WHEN 2 THEN 'git@github.com:' || o || '/' || n || '.git'
            WHEN 3 THEN '  ' || o || '/' || n || ' ' WHEN 4 THEN o || '/' || n || '.GIT'
            WHEN 5 THEN 'https://example.org/' || o || '/' || n WHEN 6 THEN n ELSE {_LF} || o || '/' || n END AS input
        FROM (SELECT c_custkey, 'team' || c_nationkey AS o, lower(c_mktsegment) || '-' || (c_custkey % 50) AS n
              FROM {{customer}}) c""",
    "history": f"""
        SELECT user_id AS workspace, ts, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'fix' ELSE 'scan' END AS kind,
          CASE WHEN event_type <> 'purchase' THEN k % 5 END AS n_open,
          CASE event_id % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'aws' ELSE 'generic' END AS provider,
          CASE event_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END AS severity,
          'kind-' || (event_id % 3) AS secret_type,
          CASE event_id % 2 WHEN 0 THEN 'src/f' ELSE 'src' || {_BS} || 'f' END || event_id || '.ts' AS path
        FROM (SELECT *, CAST(regexp_replace(props, '[^0-9]', '' @global@) AS BIGINT) AS k FROM {{events}}) e""",
    "document_events": """
        SELECT user_id AS workspace, 'src/f' || (event_id % 7) || '.ts' AS path, ts, event_id AS seq,
          CASE WHEN event_type = 'error' THEN 'close' ELSE 'scan' END AS kind,
          CASE WHEN event_type <> 'error' THEN CAST(regexp_replace(props, '[^0-9]', '' @global@) AS BIGINT) % 4 END AS n_open
        FROM {events}""",
    "selections": """
        SELECT repo, path, doc_id, CAST(k AS INT) AS sel, CASE k WHEN 0 THEN n - 20 WHEN 1 THEN 0 WHEN 2 THEN n - 1 ELSE n - 60 END AS sel_start,
          CASE k WHEN 0 THEN n - 20 WHEN 1 THEN 5 WHEN 2 THEN n ELSE n - 30 END AS sel_end
        FROM (SELECT repo, path, doc_id, length(text) AS n, @upto3@ AS k FROM {planted}) s""",
    "answers": f"""
        SELECT doc_id, ordinal, CASE (doc_id + ordinal) % 7
          WHEN 0 THEN '{{{{"issue_found": " found it ", "location": "", "intent": "i", "reasoning": "r", "context_used": [" a ", " ", 5, "b"],
            "mitre_tactic": "T1", "summary": "s", "impact": 7, "severity": "Low", "next_actions": ["x", "y", "", "z", "w"],
            "confidence": 93.5, "fluency_score": 250}}}}'
          WHEN 1 THEN 'Sure:' || {_LF} || '{{{{"issue_found": "fenced", "severity": "Critical", "confidence": "90"}}}}' || {_LF} || 'done'
          WHEN 2 THEN '{{{{"confidence": -0.5, "fluency_score": 2.5, "severity": "High", "context_used": "none"}}}}'
          WHEN 3 THEN 'no object here {{{{' WHEN 4 THEN '' ELSE '{{{{"location": "line ' || ordinal || '"}}}}' END AS content
        FROM (SELECT doc_id, 0 AS ordinal FROM {{documents}} UNION ALL SELECT doc_id, 1 FROM {{documents}}) a
        WHERE (doc_id + ordinal) % 7 <> 6""",
    "alerts": """
        SELECT c.conv_id, c.turn, coalesce(d.source || '-' || d.lang, 'unlinked') AS repo,
          CASE c.turn % 9 WHEN 8 THEN '   ' ELSE ' ' || c.text || ' ' END AS alert
        FROM {conversations} c LEFT JOIN {documents} d ON d.doc_id = c.conv_id AND c.conv_id % 3 <> 0""",
    "config_files": f"""
        SELECT repo, CASE i WHEN 1 THEN '.env' WHEN 2 THEN '.env.example' ELSE '.gitignore' END AS path,
          CASE WHEN i = 1 AND n % 3 = 1 THEN 'STRIPE_SECRET_KEY=sk_live_other' || {_LF}
            WHEN i = 1 AND n % 3 = 2 THEN 'A=1' || {_CR} || {_LF} || ' OPENAI_API_KEY=x' || {_LF} || 'GITHUB_TOKEN=ghp_' || h
            WHEN i = 2 AND n % 2 = 1 THEN 'APP_PASSWORD=' || {_LF}
            WHEN i = 3 AND n % 2 = 0 THEN 'dist' || {_LF} || ' .env ' WHEN i = 3 THEN '.env.local' ELSE '' END AS text
        FROM (SELECT source || '-' || lang AS repo, count(*) AS n, md5(CAST(min(doc_id) AS STRING)) AS h, @upto3@ AS i
              FROM {{documents}} GROUP BY source || '-' || lang) c
        WHERE NOT (i = 2 AND n % 5 = 0)""",
    "fetched": f"""
        SELECT doc_id, CASE doc_id % 10 WHEN 9 THEN 'none' ELSE 'base64' END AS encoding,
          CASE doc_id % 10 WHEN 8 THEN '' ELSE substring(b, 1, 60) || {_LF} || substring(b, 61, length(b)) END AS content
        FROM (SELECT doc_id, @base64@ AS b FROM {{documents}}) f""",
    "targets": """
        SELECT repo, path, CASE doc_id % 4 WHEN 0 THEN 'M' ELSE 'A' END AS status FROM {planted} WHERE path NOT LIKE '%.md'
        UNION ALL SELECT repo, 'gone/' || path, 'D' FROM {planted} WHERE path LIKE '%.py'""",
}

_SPARK_WORDS = {
    "@sha256@": "sha2(CAST(doc_id AS STRING), 256)",
    "@global@": "",
    "@upto12@": "explode(sequence(1, 12))",
    "@upto3@": "explode(sequence(1, 3))",
    "@base64@": "replace(base64(encode(text, 'UTF-8')), chr(13) || chr(10), '')",
}
_DUCK_WORDS = {
    "@sha256@": "sha256(CAST(doc_id AS STRING))",
    "@global@": ", 'g'",
    "@upto12@": "unnest(range(1, 13))",
    "@upto3@": "unnest(range(1, 4))",
    "@base64@": "base64(encode(text))",
}


def _spoken(sql: str, words: dict[str, str]) -> str:
    for word, text in words.items():
        sql = sql.replace(word, text)
    return sql


def _uses(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, or one derived from them."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _spoken(DEFINITIONS[name], _SPARK_WORDS)
    return spark.sql(sql, **{used: table(spark, sf_dir, used) for used in _uses(sql)})


def duck_ctes(*names: str) -> dict[str, str]:
    """The same definitions as named DuckDB queries, in the order they depend on each other."""
    out: dict[str, str] = {}
    for name in names:
        sql = _spoken(DEFINITIONS[name], _DUCK_WORDS)
        used = _uses(sql)
        for inner in used:
            if inner not in BASE_TABLES:
                out |= {k: v for k, v in duck_ctes(inner).items() if k not in out}
        out[name] = sql.format(**{u: u for u in used})
    return out
