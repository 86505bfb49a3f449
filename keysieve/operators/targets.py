"""Which files of a repository to scan, for tables of many repositories.

Tables::

    changes(repo, committed_at, commit_id, pos, status, path, old_path)
    tree(repo, head_id, pos, path, type)

A repository may hold a large share of all rows, so nothing here gathers one
repository's rows before they are cut to the cap: first occurrences are plain
aggregates (combined before the shuffle) and ``row_number() <= cap`` filters
run as group limits on both sides of the shuffle. Trees are dealt by path before
they are cut: a limit sorts what its task holds, and one task may read very
many rows of a well compressed table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysieve.functions.paths import clone_slug, is_confined, is_skipped, is_supported, normal_path, repo_owner_and_name
from keysieve.functions.text import js_trim
from keysieve.operators.skew import join_groups

# Limits and labels of target selection.
MAX_FILES = 100
RECENT_COMMITS = 20
TOP_UP_BELOW = 8
KEPT_STATUSES = ("A", "C", "M", "R")


def normalise_changes(changes: DataFrame, rename: str = "new") -> DataFrame:
    """Clean paths and statuses; drop empty and unsupported paths.

    Git's NUL-separated status lists the new path of a rename first. With
    ``rename="new"`` that path is kept; ``rename="second"`` keeps the other one.
    """
    if rename not in ("new", "second"):
        raise ValueError("rename must be 'new' or 'second'")
    path = F.col("path")
    if rename == "second":
        moved = F.rlike(F.col("status"), F.lit("[RC]"))
        path = F.when(moved, F.coalesce(F.nullif(F.col("old_path"), F.lit("")), path)).otherwise(path)
    cleaned = changes.withColumns({"path": normal_path(path), "status": js_trim(F.col("status"))})
    return cleaned.filter((F.col("path") != "") & is_supported(F.col("path")))


def _first_rows(rows: DataFrame, cap: int, *order: Column | str) -> DataFrame:
    position = F.row_number().over(Window.partitionBy("repo").orderBy(*order))
    return rows.withColumn("position", position).filter(F.col("position") <= cap)


def _spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of every repository dealt over all tasks, however few tasks read them."""
    return rows.repartition("repo", *by)


def recent_commits(changes: DataFrame, commits: int = RECENT_COMMITS) -> DataFrame:
    """The newest commits of each repository: ``repo, commit_id, commit_rank, sha``.

    ``commit_rank`` 1 is the newest commit, whose id is ``sha`` on every row.
    """
    newest = Window.partitionBy("repo").orderBy(F.desc("committed_at"), F.desc("commit_id"))
    return (
        changes.select("repo", "committed_at", "commit_id")
        .distinct()
        .withColumn("commit_rank", F.row_number().over(newest))
        .filter(F.col("commit_rank") <= commits)
        .withColumn("sha", F.max(F.when(F.col("commit_rank") == 1, F.col("commit_id"))).over(Window.partitionBy("repo")))
        .drop("committed_at")
    )


def recent_commit_targets(changes: DataFrame, commits: int = RECENT_COMMITS, cap: int = MAX_FILES) -> DataFrame:
    """Supported files of the newest commits, first occurrence first: ``repo, path, position, sha``."""
    newest = recent_commits(changes, commits)
    ranked = changes.filter(is_supported(F.col("path"))).join(newest, ["repo", "commit_id"])
    # One number in place of (commit_rank, pos), and the repository's only sha
    # among the keys: the minimum then runs as a hash aggregate.
    place = F.col("commit_rank").cast("bigint") * F.lit(1 << 40) + F.col("pos")
    first_seen = ranked.groupBy("repo", "path", "sha").agg(F.min(place).alias("seen"))
    return _first_rows(first_seen, cap, "seen", "path").select("repo", "path", "position", "sha")


def tree_sample_targets(tree: DataFrame, cap: int = MAX_FILES) -> DataFrame:
    """First supported blobs in tree order: ``repo, path, position, sha``."""
    blobs = tree.filter((F.col("type") == "blob") & (F.col("path") != "") & is_supported(F.col("path")))
    dealt = _spread(blobs.select("repo", "head_id", "pos", "path"), "pos", "path")
    return _first_rows(dealt, cap, "pos", "path").select("repo", "path", "position", F.col("head_id").alias("sha"))


def repo_targets(
    changes: DataFrame,
    tree: DataFrame,
    commits: int = RECENT_COMMITS,
    cap: int = MAX_FILES,
    top_up_below: int = TOP_UP_BELOW,
) -> DataFrame:
    """Recent files, topped up from the tree when there are few of them:
    ``repo, path, position, status, mode, sha``.

    Repositories without commits take the tree sample alone. Both inputs are
    cut to ``cap`` rows per repository first, so the windows below see at most
    twice that many rows per repository and share one shuffle. It has a fixed
    number of partitions: the windows sort their rows several times, so small
    partitions joined up to a size would hold a multiple of it.
    """
    columns = ("repo", "path", "position", "sha")
    recent = recent_commit_targets(changes, commits, cap).select(*columns, F.lit(0).alias("sampled"))
    sample = tree_sample_targets(tree, cap).select(*columns, F.lit(1).alias("sampled"))

    repo = Window.partitionBy("repo")
    same_path = Window.partitionBy("repo", "path").orderBy("sampled", "position")
    ordered = repo.orderBy("sampled", "position")
    # As many as the inputs have would make this no shuffle of its own.
    tasks = 2 * int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = (
        recent.unionByName(sample)
        .repartition(tasks, "repo")
        .withColumn("copy", F.row_number().over(same_path))
        .withColumns(
            {
                "n_recent": F.count_if(F.col("sampled") == 0).over(repo),
                "recent_sha": F.max(F.when(F.col("sampled") == 0, F.col("sha"))).over(repo),
            }
        )
        # A recent path is the first of its copies, whether or not the sample counts.
        .filter((F.col("copy") == 1) & ((F.col("sampled") == 0) | (F.col("n_recent") < top_up_below)))
        .withColumn("position", F.row_number().over(ordered))
        .filter(F.col("position") <= cap)
        .withColumn("total", F.count(F.lit(1)).over(repo))
    )
    n_recent = F.col("n_recent")
    mode = (
        F.when(n_recent == 0, F.lit("workspace-sample"))
        .when(F.col("total") > n_recent, F.lit("recent+sample"))
        .otherwise(F.lit("recent-commits"))
    )
    # The tree's head counts even when the tree holds no supported file. The
    # largest text is found by sorting, so each is taken once before, by hash:
    # without a shuffle between the two, Spark would leave that step out.
    heads = tree.select("repo", "head_id").distinct().repartition("repo").groupBy("repo").agg(F.max("head_id").alias("head"))
    sha = F.when(n_recent < top_up_below, F.coalesce("head", "recent_sha")).otherwise(F.col("recent_sha"))
    return counted.join(heads, "repo", "left").select("repo", "path", "position", mode.alias("mode"), sha.alias("sha")).select(
        "repo",
        "path",
        "position",
        F.when(F.col("mode") == "workspace-sample", F.lit("TREE")).otherwise(F.lit("COMMIT")).alias("status"),
        "mode",
        "sha",
    )


def walk_sample_targets(tree: DataFrame, cap: int = MAX_FILES) -> DataFrame:
    """Supported files outside skipped folders, by path, cut at ``cap``."""
    path = F.col("path")
    usable = tree.filter((F.col("type") == "blob") & is_supported(path) & ~is_skipped(path))
    return _first_rows(_spread(usable.select("repo", "path"), "path"), cap, "path").select("repo", "path", F.lit("TREE").alias("status"))


def latest_commit_targets(changes: DataFrame) -> DataFrame:
    """Files of the newest commit that still exist after it.

    A commit without one before it has nothing to differ from: a repository's
    only commit gives no files.
    """
    newest = recent_commits(changes, 2).withColumn("commits", F.max("commit_rank").over(Window.partitionBy("repo")))
    tip = newest.filter("commit_rank = 1 AND commits > 1").select("repo", "commit_id")
    kept = F.substring("status", 1, 1).isin(*KEPT_STATUSES)
    return (
        changes.filter(kept)
        .withColumn("path", js_trim(F.col("path")))
        .filter((F.col("path") != "") & is_supported(F.col("path")))
        .join(tip, ["repo", "commit_id"], "left_semi")
        .select("repo", "path", F.lit("COMMIT").alias("status"))
    )


def local_targets(modified: DataFrame, changes: DataFrame, tree: DataFrame, cap: int = MAX_FILES) -> DataFrame:
    """Modified files, else the latest commit's, else a walk sample: ``repo, path, status, mode``."""
    changed = normalise_changes(modified).select("repo", "path", "status", F.lit("modified").alias("mode"))
    latest = latest_commit_targets(changes).withColumn("mode", F.lit("latest-commit"))
    walked = walk_sample_targets(tree, cap).withColumn("mode", F.lit("workspace-sample"))
    with_changes = changed.select("repo").distinct()
    with_latest = latest.select("repo").distinct()
    return changed.unionByName(join_groups(latest, with_changes, "repo", "left_anti")).unionByName(
        walked.join(with_changes, "repo", "left_anti").join(with_latest, "repo", "left_anti")
    )


def targeted(requests: DataFrame, modified: DataFrame) -> DataFrame:
    """Requested paths that are in the modified set."""
    return requests.join(modified, ["repo", "path"], "left_semi")


def confined_saves(saves: DataFrame, modified: DataFrame) -> DataFrame:
    """Save events for supported, confined paths in the modified set."""
    path = F.col("path")
    return targeted(saves.filter(is_confined(path) & is_supported(path)), modified)


def repo_registry(references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``references(input)`` into one row per owner and name, and the invalid inputs."""
    parsed = references.withColumn("input", js_trim(F.col("input"))).withColumn("ref", repo_owner_and_name(F.col("input")))
    valid = (
        parsed.filter(F.col("ref").isNotNull())
        .groupBy(F.col("ref.owner").alias("owner"), F.col("ref.name").alias("name"))
        .agg(F.min("input").alias("input"), F.count(F.lit(1)).alias("links"))
        .withColumn("slug", clone_slug(F.col("input")))
    )
    return valid, parsed.filter(F.col("ref").isNull()).drop("ref")
