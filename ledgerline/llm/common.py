"""What several of the training-data operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT = 1_000  # keys that hot_join() broadcasts at most
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, read from the session.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests,
    one machine) a local temporary folder is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="ledgerline-")
        shared_folder.own = folder
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Run a plan once and go on from its rows in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """What runs inside hands rows to Python in batches of at most ``size``, for rows with large cells."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def tidy(spark: SparkSession) -> None:
    """Let go of the shuffle and checkpoint files of finished rounds.

    Spark removes them once the driver's JVM has collected what refers to them; a long loop
    that fills little memory has to ask for that.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table that later stages read again."""
    return os.path.join(shared_folder(spark), f"ledgerline-{name}-{uuid.uuid4().hex}")


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table of ``scratch`` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key) where some keys may be those of most rows.

    ``count`` is a column of ``table``: how many of the ``total`` rows hold the key, at least.
    Keys of more than a thousandth of them are fewer than a thousand, whatever the input, and
    are broadcast, so their rows stay where they are; only the others are dealt by key.
    """
    least = max(total // HOT, 1)
    columns = [c for c in table.columns if c != count]
    big = F.broadcast(table.where(F.col(count) > least).select(columns))
    cold = rows.join(F.broadcast(big.select(key)), key, "left_anti")
    return rows.join(big, key, "inner" if how == "left" else how).unionByName(cold.join(table.where(F.col(count) <= least).select(columns), key, how))


def body(column="text"):
    """A text as the operators see it: null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))
