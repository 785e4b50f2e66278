"""Interim results in the folder that the driver and the executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where it is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN.setdefault("folder", tempfile.mkdtemp(prefix="ledgerline-"))


def path(spark: SparkSession, name: str) -> str:
    """A new path there."""
    return os.path.join(folder(spark), f"{name}-{uuid.uuid4().hex}")


def kept(rows: DataFrame) -> DataFrame:
    """``rows``, worked out once: what is planned on them starts from what is stored."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark))
    return rows.checkpoint()
