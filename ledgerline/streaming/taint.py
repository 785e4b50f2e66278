"""Faults in rows as they come: the rows and the record of their faults land together or not at all."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.quality import inject

SINKS = ("rows", "manifest")


def taint_batches(stream: DataFrame, path: str, checkpoint: str, pk: str, rules: Mapping[str, str], rate: float, seed: str, fail_after: str | None = None):
    """Write each micro-batch's tainted rows and its manifest, then a mark that both are there.

    A batch's folders are named by its number. A batch that broke off is written again over what it
    left; one that has its mark is not touched. Faults depend on key and seed only, so a
    repeat makes the same. ``fail_after`` names a sink after which to break off, for tests.
    """

    def write(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if number in marked(spark, path):
            return
        rows = rows.persist()
        tainted, record = inject(rows, pk, rules, rate, seed)
        for name, part in zip(SINKS, (tainted, record), strict=True):
            part.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            if name == fail_after:
                raise RuntimeError(f"stopped after {name}")
        counts = spark.range(1).select(F.lit(number).alias("number"), F.lit(rows.count()).alias("rows"))
        counts.coalesce(1).write.mode("overwrite").json(f"{path}/marks/{number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def marked(spark: SparkSession, path: str) -> set[int]:
    """The batches whose mark is whole."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/marks")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return set()
    done = lambda f: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))
    return {int(f.getPath().getName()) for f in fs.listStatus(p) if done(f)}


def landed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, manifest) of the batches that have landed; what a broken one left is not seen."""
    numbers = sorted(marked(spark, path))
    if not numbers:
        raise FileNotFoundError(f"nothing has landed in {path}")
    return tuple(spark.read.option("basePath", f"{path}/{s}").parquet(*[f"{path}/{s}/batch={n}" for n in numbers]) for s in SINKS)
