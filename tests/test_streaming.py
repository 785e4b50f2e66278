"""Streams driven to their end must agree with the batch forms."""

from pyspark.sql import functions as F

from ledgerline.operators import ratings
from ledgerline.streaming import events as streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


def stream(spark, tmp_path):
    spark.read.parquet(EVENTS).repartition(2).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(EVENTS).schema).parquet(str(tmp_path / "in"))


def drained(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_running_balance_matches_the_fold(spark, tmp_path):
    rows = stream(spark, tmp_path).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("change", F.col("value") - 50)
    got = drained(streams.running_balance(rows, "user_id", "event_id", "change", 0, 250, 100), "balance", "update")
    last = {r["key"]: (round(r["balance"], 6), r["steps"]) for r in got.orderBy("steps").collect()}
    batch = ratings.clamped_sum(spark.read.parquet(EVENTS).withColumn("change", F.col("value") - 50), "user_id", ["event_id"], "change", 0, 250, 100)
    assert last == {r["user_id"]: (round(r["state"], 6), r["steps"]) for r in batch.collect()}


def test_windows_and_sessions(spark, tmp_path):
    rows = stream(spark, tmp_path).withColumn("ts", F.col("ts").cast("timestamp"))
    days = drained(streams.windowed_counts(rows, "ts", "1 day", "40 days"), "days", "complete")
    assert days.agg(F.sum("n")).first()[0] == spark.read.parquet(EVENTS).count()
    runs = drained(streams.sessions(rows, "user_id", "ts", "2 days", "40 days"), "runs", "complete")
    assert runs.agg(F.sum("n")).first()[0] == spark.read.parquet(EVENTS).count()


def test_batches_land_once(spark, tmp_path):
    rows = stream(spark, tmp_path).withColumn("month", F.date_format("ts", "yyyy-MM"))
    for _ in range(2):
        streams.append_batches(rows, str(tmp_path / "out"), str(tmp_path / "ck"), "month").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(EVENTS).count()
