"""Folders that the driver and all executors share, and rows that are written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (found.get() if found.isDefined() else None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # local-cluster has other machines too
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corpuswright-")
    if not found.isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; a local session without that setting gets a temporary one."""
    return f"{_base(spark)}/corpuswright-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder: later steps read them and don't make them anew."""
    _base(df.sparkSession)
    return df.checkpoint(eager=True)
