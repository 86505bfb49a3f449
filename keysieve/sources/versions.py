"""Tables in numbered versions, of which readers see whole ones only.

The rows of a version are written first and its number is published after
them; Spark's commit of that one-row table is the switch. A version that is
written again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self._spark = spark
        self._folder = folder
        self._schema = schema

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self._folder}/rows/version={version:012d}")
        number = self._spark.range(1).select(F.lit(version).cast("bigint").alias("number"))
        number.coalesce(1).write.mode("overwrite").parquet(f"{self._folder}/published/version={version:012d}")

    def newest(self, upto: int | None = None) -> int | None:
        """Number of the newest published version, or of the newest up to ``upto``; None without any."""
        try:
            published = self._spark.read.schema("number bigint").parquet(f"{self._folder}/published/version=*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        if upto is not None:
            published = published.filter(F.col("number") <= upto)
        return published.agg(F.max("number")).first()[0]

    def rows(self, first: int, last: int) -> DataFrame:
        """Rows of all versions from ``first`` to ``last``, with their ``version``."""
        read = self._spark.read.schema(f"{self._schema}, version bigint").option("basePath", f"{self._folder}/rows")
        return read.parquet(f"{self._folder}/rows/version=*").filter(F.col("version").between(first, last))


class MergedTable:
    """State kept as one version of changes per batch; ``merge`` makes the state of any of its rows.

    ``merge`` must give the same whether it runs over all changes at once or
    over its own results for parts of them. Every ``fold_every`` batches all
    changes so far are merged into one version, so that readers never go
    through more than that many. A batch that runs again reads what was there
    before it, later batches and folds left aside, and replaces itself.
    """

    def __init__(
        self, spark: SparkSession, folder: str, schema: str, merge: Callable[[DataFrame], DataFrame], fold_every: int = 16
    ) -> None:
        self._spark = spark
        self._schema = schema
        self._merge = merge
        self._every = fold_every
        self._changes = VersionedTable(spark, f"{folder}/changes", schema)
        self._folded = VersionedTable(spark, f"{folder}/folded", schema)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        self._changes.write(rows, batch_id)
        if (batch_id + 1) % self._every == 0:
            self._folded.write(self._upto(batch_id, batch_id - 1), batch_id)

    def changes(self, batch_id: int) -> DataFrame:
        return self._changes.rows(batch_id, batch_id).drop("version")

    def _upto(self, last: int, fold: int) -> DataFrame:
        """State after batch ``last``, from the newest fold up to ``fold`` and the changes since."""
        base = self._folded.newest(fold)
        rows = self._changes.rows(0 if base is None else base + 1, last)
        if base is not None:
            rows = rows.unionByName(self._folded.rows(base, base))
        return self._merge(rows.drop("version"))

    def before(self, batch_id: int) -> DataFrame:
        """State before a batch; empty before the first."""
        if self._changes.newest(batch_id - 1) is None:
            return self._spark.createDataFrame([], self._schema)
        return self._upto(batch_id - 1, batch_id - 1)

    def state(self) -> DataFrame:
        """State after the newest published batch."""
        newest = self._changes.newest()
        if newest is None:
            raise ValueError("no batch has been published yet")
        return self._upto(newest, newest)
