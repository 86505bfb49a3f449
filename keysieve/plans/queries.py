"""Registered queries: every operator over the whole supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.catalog import Catalog, default_catalog
from keysieve.functions.paths import editor_language, has_editor_language, is_skipped, is_supported
from keysieve.operators import findings as fnd
from keysieve.operators import history as hist
from keysieve.operators import remediate as rem
from keysieve.operators import scan as scn
from keysieve.operators import summary as summ
from keysieve.operators import targets as tgt
from keysieve.operators import triage as tri
from keysieve.operators.detect import describe, detect, detect_located
from keysieve.plans.corpus import table
from keysieve.sources import snapshots as snap
from keysieve.sources.files import decode_contents
from keysieve.sources.folder import register_folders, write_folder
from keysieve.sources.shared import shared_folder, written
from keysieve.streaming import current as keyed
from keysieve.streaming import saves as live
from keysieve.streaming import totals as kept

Query = Callable[[SparkSession, str], DataFrame]
UPDATED_AT = "2024-01-01T00:00:00.000Z"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Planted texts with a supported path."""
    return table(spark, sf, "planted").filter(is_supported(F.col("path")))


def _located(spark: SparkSession, sf: str) -> DataFrame:
    return detect_located(_files(spark, sf))


def supported_paths(spark, sf):
    path = F.col("path")
    language = editor_language(path)
    return table(spark, sf, "paths").select(
        "doc_id",
        is_supported(path).alias("supported"),
        is_skipped(path).alias("skipped"),
        F.coalesce(language, F.lit("")).alias("language"),
        F.coalesce(has_editor_language(language), F.lit(False)).alias("in_editor"),
    )


def detect_spans(spark, sf):
    return detect(_files(spark, sf)).select("repo", "path", "ordinal", "rule_order", "start", "end", "value")


def detect_by_rule(spark, sf):
    keys = ("provider", "secret_type", "severity", "env_var")
    return describe(detect(_files(spark, sf))).groupBy(*keys).agg(F.count(F.lit(1)).alias("findings"))


def overlap_suppression(spark, sf):
    """Password-like spans that give way to a span of an earlier rule."""
    alone = detect(_files(spark, sf), Catalog(default_catalog().rules[-1:]))
    kept = detect(_files(spark, sf)).filter(F.col("rule_order") == len(default_catalog().rules))
    return alone.join(kept, ["repo", "path", "start"], "left_anti").select("repo", "path", "start", "end", "value")


def finding_positions(spark, sf):
    return _located(spark, sf).select("repo", "path", "ordinal", "line", "character")


def redacted_findings(spark, sf):
    return fnd.snapshots(_located(spark, sf))


def diagnostics(spark, sf):
    rows = fnd.diagnostics(_located(spark, sf))
    return rows.select("repo", "path", "start", "end", "level", "code", "message")


def range_lookup(spark, sf):
    selections = table(spark, sf, "selections")
    return fnd.finding_at(_files(spark, sf).select("repo", "path", "text"), selections).select(
        "repo", "path", "sel", F.coalesce("touches", F.lit(False)).alias("touches"),
        *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("rule_order", "start", "end")],
    )


def range_lookup_stored(spark, sf):
    """The same lookups in a written table of findings."""
    found = written(detect(_files(spark, sf)).select("repo", "path", "ordinal", "rule_order", "start", "end"), "finding-places")
    return fnd.stored_finding_at(found, table(spark, sf, "selections")).select(
        "repo", "path", "sel", F.coalesce("touches", F.lit(False)).alias("touches"),
        *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("rule_order", "start", "end")],
    )


def history_burst(spark, sf):
    """All events of one workspace at one time, in the order of their numbers."""
    events = table(spark, sf, "history").withColumns({"workspace": F.lit("all"), "ts": F.timestamp_seconds(F.lit(0))})
    return hist.running_stats(events).select("workspace", "seq", "kind", "found", "fixed", "open")


def first_finding(spark, sf):
    rows = fnd.first_findings(_located(spark, sf).select("repo", "path", "start", "rule_order", "line", "character"))
    return rows.select("repo", "path", "start", "rule_order", "line", "character")


def scan_summary(spark, sf):
    return summ.scan_stats(_files(spark, sf))


def raw_text_scan(spark, sf):
    """All supplied texts as they are."""
    sources = {"documents": "text", "pages": "html", "conversations": "text", "benchmark": "text"}
    union = None
    for name, column in sources.items():
        rows = table(spark, sf, name).select(F.lit(name).alias("repo"), F.col(column).alias("text"))
        union = rows if union is None else union.unionByName(rows)
    return summ.scan_stats(union)


def scan_stats_all(spark, sf):
    """Scans per repository and kind of file; kinds that are not scanned give scans without files."""
    kind = F.element_at(F.split("path", "[.]"), -1)
    scans = table(spark, sf, "planted").withColumn("kind", kind)
    return summ.scan_stats(_files(spark, sf).withColumn("kind", kind), ("repo", "kind"), scans=scans)


def finding_cube(spark, sf):
    return summ.finding_cube(describe(detect(_files(spark, sf))))


def redacted_corpus(spark, sf):
    return rem.redact_texts(_files(spark, sf)).select("doc_id", F.md5("text").alias("text_md5"))


def severity_zero_fill(spark, sf):
    return summ.by_severity(summ.scan_summary(_files(spark, sf)))


def provider_zero_fill(spark, sf):
    return summ.by_provider(summ.scan_summary(_files(spark, sf)))


def scanned_manifest(spark, sf):
    planted = table(spark, sf, "planted")
    manifest = scn.scan_manifest(table(spark, sf, "targets"), planted)
    return manifest.select("repo", "path", "status", "readable", F.size("spans").alias("findings"))


def manifest_stats(spark, sf):
    """The route for many targets: spans travel, texts stay."""
    planted = table(spark, sf, "planted")
    return scn.manifest_stats(scn.scan_manifest(table(spark, sf, "targets"), planted))


def changes_normalised(spark, sf):
    modified = table(spark, sf, "modified")
    union = None
    for rename in ("new", "second"):
        rows = tgt.normalise_changes(modified, rename).withColumn("rename", F.lit(rename))
        union = rows if union is None else union.unionByName(rows)
    return union.groupBy("repo", "rename", "status", "path").agg(F.count(F.lit(1)).alias("rows"))


def recent_commit_targets(spark, sf):
    return tgt.recent_commit_targets(table(spark, sf, "changes"))


def tree_sample_targets(spark, sf):
    return tgt.tree_sample_targets(table(spark, sf, "tree"))


def topup_targets(spark, sf):
    return tgt.repo_targets(table(spark, sf, "changes"), table(spark, sf, "tree"))


def topup_targets_small_cap(spark, sf):
    """Limits small enough to bind in most repositories."""
    changes, tree = table(spark, sf, "changes"), table(spark, sf, "tree")
    return tgt.repo_targets(changes, tree, commits=2, cap=6, top_up_below=4)


def target_fallback(spark, sf):
    modified, changes, tree = (table(spark, sf, n) for n in ("modified", "changes", "tree"))
    rows = tgt.local_targets(modified, changes, tree)
    return rows.groupBy("repo", "path", "status", "mode").agg(F.count(F.lit(1)).alias("rows"))


def targeted_saves(spark, sf):
    modified = tgt.normalise_changes(table(spark, sf, "modified"))
    return tgt.confined_saves(table(spark, sf, "saves"), modified).select("repo", "path", "save_id")


def repo_refs(spark, sf):
    return tgt.repo_registry(table(spark, sf, "repo_refs"))[0]


def repo_refs_invalid(spark, sf):
    return tgt.repo_registry(table(spark, sf, "repo_refs"))[1].groupBy("input").agg(F.count(F.lit(1)).alias("rows"))


def history_running(spark, sf):
    return hist.running_stats(table(spark, sf, "history")).select("workspace", "seq", "kind", "found", "fixed", "open")


def history_latest(spark, sf):
    return hist.latest_stats(table(spark, sf, "history"))


def _audit_rows(trail):
    return trail.select(
        "workspace", "audit_rank", "seq", "action", "summary",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("provider", "severity")],
    )


def audit_trail(spark, sf):
    return _audit_rows(hist.audit_trail(table(spark, sf, "history")))


def current_findings(spark, sf):
    """Findings (``n_open`` per scan) of each open document's newest scan."""
    events = table(spark, sf, "document_events")
    numbers = F.when(F.col("n_open") > 0, F.sequence(F.lit(1), F.col("n_open").cast("int")))
    seen = events.select("workspace", "path", "seq", F.explode(numbers).alias("number"))
    return hist.current_findings(events, seen)


def workspace_totals(spark, sf):
    rows = hist.workspace_scans(table(spark, sf, "document_events"))
    return hist.running_stats(rows).select("workspace", "seq", "n_open", "found", "fixed", "open")


def _repo_history(spark, sf):
    """Event history with the repositories of the planted texts as workspaces."""
    events = table(spark, sf, "history").withColumn(
        "workspace", F.concat(F.lit("src"), F.col("workspace") % 20, F.lit("-en"))
    )
    return hist.latest_stats(events).select(F.col("workspace").alias("repo"), "found", "fixed")


def insight_report(spark, sf):
    return summ.insight_report(_files(spark, sf), _repo_history(spark, sf))


def dashboard_rollup(spark, sf):
    rows = summ.dashboard(summ.scan_summary(_files(spark, sf)), _repo_history(spark, sf))

    def listed(name):
        entries = F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
        return F.array_join(entries, ",").alias(name)

    return rows.select("repo", "score", "found", "fixed", "open", listed("by_severity"), listed("by_provider"))


def _triage_input(spark, sf):
    """Snapshot rows with gaps: some fields empty, null or zero, by document."""
    rows = fnd.snapshots(_located(spark, sf), ("repo", "doc_id", "ordinal"))
    gap = F.col("doc_id") % 5

    def hole(column, at, value):
        return F.when(gap == at, F.lit(value)).otherwise(F.col(column)).alias(column)

    return rows.select(
        "repo", "doc_id", "ordinal", "secret_type", "env_var",
        hole("message", 1, ""), hole("explanation", 2, None), hole("line", 3, 0), hole("file_name", 1, None),
        hole("severity", 4, "LOW"), hole("provider", 3, None), hole("file_path", 2, ""), "character",
    )


def _flat(df, *keys):
    texts = [F.col("card")[n].alias(n) for n in tri.CARD_FIELDS if n not in ("context_used", "next_actions")]
    lists = [F.array_join(F.col("card")[n], "|").alias(n) for n in ("context_used", "next_actions")]
    return df.select(*keys, *texts, *lists)


def triage_cards(spark, sf):
    return _flat(tri.triage_cards(tri.triageable(_triage_input(spark, sf))[0]), "doc_id", "ordinal")


def triage_demo_cards(spark, sf):
    return _flat(tri.triage_cards(_triage_input(spark, sf), "demo"), "doc_id", "ordinal")


def _finding_id():
    return F.concat_ws("#", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")).alias("finding_id")


def triage_merge(spark, sf):
    cards = tri.triage_cards(_triage_input(spark, sf)).select(_finding_id(), "card")
    answers = table(spark, sf, "answers").select(_finding_id(), "content")
    return _flat(tri.merge_answers(cards, answers), "finding_id", "mode", "ai_enabled")


def triage_requests(spark, sf):
    return _triage_input(spark, sf).select("doc_id", "ordinal", tri.request_payload().alias("payload"))


def alert_cards(spark, sf):
    first = fnd.first_findings(_located(spark, sf).drop("doc_id"))
    snapshot = fnd.snapshots(first.filter(F.endswith("repo", F.lit("-en"))))
    return _flat(tri.alert_cards(table(spark, sf, "alerts"), snapshot)[0], "conv_id", "turn", "is_grounded")


def _config(spark, sf):
    return rem.config_texts(table(spark, sf, "config_files"))


def remediation_plan(spark, sf):
    rows = rem.remediation_plans(detect(_files(spark, sf)), _config(spark, sf))
    return rows.select(
        "repo", "path", "ordinal", "source_replacement", "env_line", "example_line", "will_add_ignore",
        F.coalesce("conflict_reason", F.lit("")).alias("conflict_reason"), "preview",
    )


def _plan(spark, sf):
    found = written(detect(_files(spark, sf)), "findings")
    return rem.repo_plan(found, _config(spark, sf))


def repo_plan_conflicts(spark, sf):
    return _plan(spark, sf).select("repo", "path", "ordinal", "variable", "accepted")


def env_append(spark, sf):
    return rem.new_config_texts(_plan(spark, sf), _config(spark, sf))


def rewrite_sources(spark, sf):
    return rem.rewrite_sources(_files(spark, sf), _plan(spark, sf))


def rewrite_sources_unquoted(spark, sf):
    return rem.rewrite_sources(_files(spark, sf), _plan(spark, sf), keep_quotes=False)


def decoded_contents(spark, sf):
    good = decode_contents(table(spark, sf, "fetched"))[0]
    return good.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


def undecodable_contents(spark, sf):
    return decode_contents(table(spark, sf, "fetched"))[1].select("doc_id", "encoding")


def folder_files(spark, sf):
    """All texts written as files, dot names among them, and read again as a folder."""
    doc_id = F.col("doc_id")
    name = F.when(doc_id % 4 == 0, F.lit("/.env")).when(doc_id % 4 == 1, F.lit("/_main.py")).otherwise(F.lit("/a b.ts"))
    files = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), doc_id, name).alias("path"), "text")
    folder = f"{shared_folder(spark)}/keysieve/folder-{uuid.uuid4().hex}"
    write_folder(files.repartition("path"), folder)
    register_folders(spark)
    return spark.read.format("source_files").load(folder).select("path", "size", F.md5("text").alias("text_md5"))


def snapshot_roundtrip(spark, sf):
    documents = snap.snapshot_documents(_files(spark, sf), UPDATED_AT)
    # Every fifth document arrives damaged and reads as having no findings.
    damaged = F.regexp_extract("path", "d([0-9]+)[.]", 1).cast("bigint") % 5 == 0
    cut = F.when(damaged, F.left("document", F.length("document") - 1)).otherwise(F.col("document"))
    parsed = snap.parse_snapshots(documents.withColumn("document", cut))
    first = F.get("findings", F.lit(0))
    return parsed.select(
        "repo", "path", F.col("open").cast("bigint").alias("open"), F.coalesce("updated_at", F.lit("")).alias("updated_at"),
        *[F.coalesce(first[f].cast("string"), F.lit("")).alias(f) for f in ("provider", "line", "character", "envVarName")],
    )


def _stream_folder(spark, name):
    return f"{shared_folder(spark)}/keysieve/stream-{name}-{uuid.uuid4().hex}"


def _stream_of(spark, sf, name):
    """A supplied table read as a stream."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}[.]parquet")


def _dealt_stream(spark, rows, name, key, parts=5):
    """Rows dealt into files by a hash of their key, read a few files at a time: micro-batches in no order of time.

    A part has one file or, where it is large, several of a bounded size, each of them written by a task.
    """
    folder = _stream_folder(spark, name)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)))
    dealt.hint("rebalance", "part").write.partitionBy("part").parquet(folder)
    files = len(spark.read.parquet(folder).inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files // 4)).parquet(f"{folder}/part=*")


def _stat_events(events):
    return events.select(
        F.col("user_id").alias("workspace"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", F.lit("fix")).otherwise(F.lit("scan")).alias("kind"),
        F.when(F.col("event_type") != "purchase", F.regexp_replace("props", "[^0-9]", "").cast("bigint") % 5).alias("n_open"),
    )


def stream_stats(spark, sf):
    """Running stats kept over micro-batches, state after the last one."""
    events = _stat_events(_stream_of(spark, sf, "events"))
    stats = live.RunningStats(spark, _stream_folder(spark, "stats"))
    query = stats.start(events, _stream_folder(spark, "stats-ckpt"))
    query.awaitTermination()
    return stats.state(query.lastProgress["batchId"])


def stream_stats_late(spark, sf):
    """The same over several micro-batches that hold events of all times each."""
    events = _stat_events(_dealt_stream(spark, table(spark, sf, "events"), "late", "event_id"))
    stats = live.RunningStats(spark, _stream_folder(spark, "late-stats"))
    query = stats.start(events, _stream_folder(spark, "late-ckpt"))
    query.awaitTermination()
    return stats.state(query.lastProgress["batchId"])


def _saves(documents):
    """Documents as saves of eight paths per source, newest id last; every ninth is a close."""
    doc_id, h = F.col("doc_id"), F.md5(F.col("doc_id").cast("string"))
    secret = F.concat(F.lit('token = "ghp_'), h, F.lit('"'))
    text = F.concat("text", F.lit("\n"), F.when(doc_id % 3 == 0, secret).otherwise(F.lit("")))
    closing = doc_id % 9 == 8
    return documents.select(
        F.col("source").alias("workspace"),
        F.concat(F.lit("src/s"), doc_id % 8, F.lit(".ts")).alias("path"),
        F.timestamp_seconds(doc_id).alias("ts"),
        doc_id.alias("seq"),
        F.when(closing, F.lit("close")).otherwise(F.lit("save")).alias("kind"),
        F.when(~closing, text).alias("text"),
    )


def _save_stream(spark, sf):
    return _saves(_stream_of(spark, sf, "documents"))


def stream_published_snapshots(spark, sf):
    """What readers see after saves and closes in no order: one document per open file, without findings too."""
    saves = _saves(_dealt_stream(spark, table(spark, sf, "documents"), "published", "doc_id"))
    state = live.CurrentSnapshots(spark, _stream_folder(spark, "snapshots"), lambda _: UPDATED_AT, fold_every=2)
    state.start(saves, _stream_folder(spark, "snapshots-ckpt")).awaitTermination()
    parsed = snap.parse_snapshots(state.documents())
    first = F.get("findings", F.lit(0))
    return parsed.select(
        "workspace", "path", "seq", "updated_at", F.col("open").cast("bigint").alias("open"), F.size("findings").cast("bigint").alias("findings"),
        F.coalesce(first["provider"], F.lit("")).alias("provider"),
    )


def stream_workspace_totals(spark, sf):
    """Published totals per workspace."""
    saves = _saves(_dealt_stream(spark, table(spark, sf, "documents"), "totals", "doc_id"))
    state = live.CurrentSnapshots(spark, _stream_folder(spark, "totals"), lambda _: UPDATED_AT)
    state.start(saves, _stream_folder(spark, "totals-ckpt")).awaitTermination()
    return state.totals()


def stream_running_totals(spark, sf):
    """Totals per workspace kept up to date by retraction: eight paths per repository, saved and closed in no order."""
    doc_id = F.col("doc_id")
    saves = _dealt_stream(spark, _files(spark, sf), "running-totals", "doc_id").select(
        F.col("repo").alias("workspace"),
        F.concat(F.lit("src/s"), doc_id % 8, F.lit(".ts")).alias("path"),
        F.timestamp_seconds(doc_id).alias("ts"),
        doc_id.alias("seq"),
        F.when(doc_id % 9 == 8, F.lit("close")).otherwise(F.lit("save")).alias("kind"),
        "text",
    )
    state = kept.RunningTotals(spark, _stream_folder(spark, "totals-kept"), fold_every=2)
    state.start(saves, _stream_folder(spark, "totals-kept-ckpt")).awaitTermination()
    return state.totals()


def stream_audit_trail(spark, sf):
    """Newest audit rows kept over several micro-batches that hold events of all times each."""
    events = _dealt_stream(spark, table(spark, sf, "history"), "audit", "seq")
    state = kept.RunningAudit(spark, _stream_folder(spark, "audit-kept"), fold_every=2)
    state.start(events, _stream_folder(spark, "audit-ckpt")).awaitTermination()
    return _audit_rows(state.trail())


def stream_targeted_scans(spark, sf):
    """Scans of saved files that are in the modified set."""
    documents = table(spark, sf, "documents")
    sets = live.ModifiedSets(spark, _stream_folder(spark, "sets"))
    status = F.element_at(F.array(F.lit(" M"), F.lit("??"), F.lit("A ")), (F.col("doc_id") % 3 + 1).cast("int"))
    listed = documents.select(
        F.col("source").alias("repo"), status.alias("status"),
        F.concat(F.lit("src\\s"), F.col("doc_id") % 3, F.lit(".ts")).alias("path"), F.lit(None).cast("string").alias("old_path"),
    )
    # The first set is out of date by the time the stream begins.
    sets.replace(listed.withColumn("path", F.lit("src/s7.ts")))
    sets.replace(listed)
    folder = _stream_folder(spark, "targeted")
    saves = _saves(_dealt_stream(spark, documents, "targeted-saves", "doc_id"))
    sets.start(saves, folder, _stream_folder(spark, "targeted-ckpt")).awaitTermination()
    schema = "workspace string, path string, seq bigint, ordinal int, rule_order int, line int, character int"
    return spark.read.schema(schema).json(f"{folder}/batch=*")


def stream_scan_on_save(spark, sf):
    folder = _stream_folder(spark, "scan")
    query = live.publish_snapshots(live.scan_saves(_save_stream(spark, sf)), folder, _stream_folder(spark, "scan-ckpt"))
    query.awaitTermination()
    schema = "workspace string, path string, seq bigint, ordinal int, rule_order int, line int, character int"
    return spark.read.schema(schema).json(f"{folder}/batch=*")


def stream_current_findings(spark, sf):
    """Newest state per document after all saves; the sink keeps each batch's changed rows."""
    folder = _stream_folder(spark, "current")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id:012d}")

    writer = live.current_spans(_save_stream(spark, sf)).writeStream.outputMode("update").foreachBatch(keep)
    writer.option("checkpointLocation", _stream_folder(spark, "current-ckpt")).trigger(availableNow=True).start().awaitTermination()
    changed = spark.read.parquet(f"{folder}/batch=*")
    rest = F.struct("seq", "is_open", F.size("spans").alias("findings"))
    newest = changed.groupBy("workspace", "path").agg(F.max_by(rest, F.struct("ts", "seq")).alias("last"))
    return newest.filter("last.is_open").select("workspace", "path", "last.seq", "last.findings")


def stream_keyed_findings(spark, sf):
    """Newest state per document out of keyed state, over several micro-batches in no order of time."""
    folder = _stream_folder(spark, "keyed")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id:012d}")

    saves = _saves(_dealt_stream(spark, table(spark, sf, "documents"), "keyed-saves", "doc_id"))
    # No event comes so late.
    writer = keyed.current_findings(saves, "36500 days").writeStream.outputMode("update").foreachBatch(keep)
    writer.option("checkpointLocation", _stream_folder(spark, "keyed-ckpt")).trigger(availableNow=True).start().awaitTermination()
    changed = spark.read.parquet(f"{folder}/batch=*")
    rest = F.struct("seq", "is_open", F.size("findings").alias("findings"))
    newest = changed.groupBy("workspace", "path").agg(F.max_by(rest, F.struct("ts", "seq")).alias("last"))
    return newest.filter("last.is_open").select("workspace", "path", "last.seq", "last.findings")


REGISTERED: tuple[Query, ...] = (
    supported_paths, detect_spans, detect_by_rule, overlap_suppression, finding_positions, redacted_findings,
    diagnostics, range_lookup, first_finding, scan_summary, scan_stats_all, finding_cube, redacted_corpus, raw_text_scan, severity_zero_fill, provider_zero_fill,
    scanned_manifest, manifest_stats, changes_normalised, recent_commit_targets, tree_sample_targets, topup_targets,
    topup_targets_small_cap, target_fallback, targeted_saves, repo_refs, repo_refs_invalid, history_running,
    history_latest, audit_trail, current_findings, workspace_totals, insight_report, dashboard_rollup, triage_cards,
    triage_demo_cards, triage_merge, triage_requests, alert_cards, remediation_plan, repo_plan_conflicts, env_append,
    rewrite_sources, rewrite_sources_unquoted, decoded_contents, undecodable_contents, snapshot_roundtrip,
    stream_stats, stream_scan_on_save, stream_current_findings, stream_stats_late, stream_published_snapshots,
    stream_workspace_totals, stream_targeted_scans, range_lookup_stored, history_burst,
    stream_running_totals, stream_audit_trail, folder_files, stream_keyed_findings,
)


def registered() -> dict[str, Query]:
    return {query.__name__: query for query in REGISTERED}
