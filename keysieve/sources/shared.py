"""Intermediate results in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


_own: dict[str, str] = {}


def _named_folder(spark: SparkSession) -> str | None:
    return spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Where it is unset and driver and executors are one local process, the
    application gets a folder of its own (the setting itself cannot be changed
    in a running session). On a cluster it must be set: other machines would
    neither see nor keep a folder of the driver's.
    """
    folder = _named_folder(spark)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all machines of the cluster share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = tempfile.mkdtemp(prefix="keysieve-")
        folder = _own[application]
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a result once and read it back.

    For results used several times downstream: without this, every use scans
    the texts again. The table outlives lost executors.
    """
    path = f"{shared_folder(df.sparkSession)}/keysieve/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
