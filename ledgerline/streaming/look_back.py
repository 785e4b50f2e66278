"""The look-back window as events come: late ones correct the days after them."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.operators.history import latest
from ledgerline.sources.interim import path as new_path

DAY_MS = 86_400_000
OUT = "key long, day int, value long, recent long"


def _folded(days: int):
    """Holds the sums of a key's days, as one value, as long as a row that is still let in can need them."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new: Counter[int] = Counter()
        if not state.hasTimedOut:
            for frame in frames:
                for day, value in zip(frame["day"].tolist(), frame["value"].tolist(), strict=True):
                    new[day] += value
        sums = Counter({int(d): v for d, v in json.loads(state.get[0]).items()} if state.exists else {})
        sums.update(new)
        if new:
            out = sorted({x for d in new for x in range(d, d + days + 1) if x in sums})
            recent = [sum(sums[d] for d in range(x - days, x) if d in sums) for x in out]
            yield pd.DataFrame({"key": key[0], "day": out, "value": [sums[x] for x in out], "recent": recent})
        # After the rows: those of this batch are judged by the watermark of the one before.
        passed = state.getCurrentWatermarkMs()
        sums = {d: v for d, v in sums.items() if (d + days + 1) * DAY_MS > passed}
        if sums:
            state.update((json.dumps(sums),))
            state.setTimeoutTimestamp((max(sums) + days + 1) * DAY_MS)
        elif state.exists:
            state.remove()

    return step


def look_back_updates(events: DataFrame, key: str, ts: str, value: str, days: int = 14, late: str = "3 days") -> DataFrame:
    """key, day, value, recent: a day's sum and that of the ``days`` days before it, as events come.

    A day comes again whenever an event on it or on a day it looks back to comes; the last row of
    a day counts. Events later than ``late`` are dropped by the watermark, and a day's sum goes when the
    watermark is past all days that look back to it, at the key's next event or with its last day: a key's state is one
    value of some ``days`` numbers, read and written once a batch. Needs the RocksDB state store.
    """
    rows = events.select(F.col(key).cast("long").alias("key"), F.unix_date(F.col(ts).cast("date")).alias("day"), F.col(value).cast("long").alias("value"), F.col(ts).cast("timestamp").alias("ts"))
    return rows.withWatermark("ts", late).groupBy("key").applyInPandasWithState(_folded(days), OUT, "sums string", "update", GroupStateTimeout.EventTimeTimeout)


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def last_rows(updates: DataFrame, out: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run a stream of updates over what is there, and the last row of each of ``keys``.

    Each micro-batch is written to a folder of its number, which a repeat writes over.
    """
    spark = updates.sparkSession

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with state_in_rocksdb(spark):
        updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.option("basePath", out).parquet(out), keys, ["batch"])


def recent_by_stream(events: DataFrame, key: str, ts: str, value: str, days: int = 14, late: str = "3 days") -> DataFrame:
    """``look_back_updates`` over a streaming source up to its end, results in the shared folder."""
    spark = events.sparkSession
    updates = look_back_updates(events, key, ts, value, days, late)
    rows = last_rows(updates, new_path(spark, "recent"), new_path(spark, "recent-state"), ["key", "day"])
    return rows.select(F.col("key").alias(key), F.date_from_unix_date("day").alias("day"), "value", "recent")
