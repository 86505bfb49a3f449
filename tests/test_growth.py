"""What one task holds does not follow from how few tasks read the input."""

import re

from pyspark.sql import functions as F

from keysieve.operators import targets as tgt
from keysieve.plans import queries


def test_parts_of_a_dealt_stream_are_divided_by_size(spark):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    largest = []
    spark.conf.set(size, "64k")
    try:
        for n in (4000, 16000):
            rows = spark.range(0, n, 1, n // 500).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
            stream = queries._dealt_stream(spark, rows, f"growth-{n}", "id")
            read = []
            query = stream.writeStream.foreachBatch(lambda batch, _: read.append(batch.withColumn("file", F.input_file_name()).groupBy("file").count().collect()))
            query.option("checkpointLocation", queries._stream_folder(spark, "growth-ckpt")).trigger(availableNow=True).start().awaitTermination()
            files = [r["count"] for batch in read for r in batch]
            assert sum(files) == n and len(read) >= 4
            largest.append(max(files))
    finally:
        spark.conf.set(size, before)
    # Four times the rows give more files, not larger ones.
    assert largest[1] <= 1.5 * largest[0], largest


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trees_are_dealt_by_path_before_they_are_sorted(spark):
    rows = [("r", "h", 5, "a.py", "blob"), ("r", "h", 5, "a.py", "blob"), ("r", "h", 1, "b.py", "blob"), (None, "g", 1, "c.py", "blob"), ("r", "h", None, "d.py", "blob")]
    tree = spark.createDataFrame(rows, "repo string, head_id string, pos int, path string, type string").coalesce(1)
    for found, by in ((tgt.tree_sample_targets(tree, 3), "repo#[0-9]+, pos#[0-9]+, path#[0-9]+"), (tgt.walk_sample_targets(tree, 3), "repo#[0-9]+, path#[0-9]+")):
        # Read from the top, the plan deals by path below the limit that sorts.
        assert re.search(rf"Partial.*Sort.*hashpartitioning\({by}", _plan(found), re.DOTALL)
    got = [(r.repo, r.path, r.position) for r in tgt.tree_sample_targets(tree, 3).collect()]
    assert sorted(got, key=str) == [("r", "a.py", 3), ("r", "b.py", 2), ("r", "d.py", 1), (None, "c.py", 1)]


def test_targets_are_not_gathered_into_few_tasks(spark):
    rows = [(f"r{i}", f"h{i}", 1, "a.py", "blob") for i in range(50)]
    tree = spark.createDataFrame(rows, "repo string, head_id string, pos int, path string, type string")
    changes = spark.createDataFrame([], "repo string, committed_at int, commit_id string, pos int, status string, path string, old_path string")
    found = tgt.repo_targets(changes, tree)
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Heads are taken by hash before the largest is found by sorting, and the windows have a shuffle that is not coalesced.
    assert re.search(r"HashAggregate\(keys=\[repo#[0-9]+, head_id#[0-9]+\]", _plan(found))
    assert re.search(rf"hashpartitioning\(repo#[0-9]+, {tasks}\), REPARTITION_BY_NUM", _plan(found))
    assert {(r.repo, r.path, r.sha) for r in found.collect()} == {(f"r{i}", "a.py", f"h{i}") for i in range(50)}
