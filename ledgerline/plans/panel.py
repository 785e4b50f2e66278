"""Read models of the control panel: progress, liveness, batch and file summaries, forecasts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.shares import pct

Tables = Mapping[str, DataFrame]


def job_progress(steps: DataFrame) -> DataFrame:
    """job_id, progress_pct, done: the stages' shares of the work, times how far each is."""
    return steps.groupBy("job_id").agg(F.round(F.least(F.sum(F.col("weight_pct") * F.col("done_pct") / 100), F.lit(100.0)), 2).alias("progress_pct"), F.bool_and(F.col("done_pct") >= 100).alias("done"))


def liveness(jobs: DataFrame, now: Column, stale_after: int, dead_after: int) -> DataFrame:
    """job_id, silent_seconds, state: running, stale or dead, by the last heartbeat."""
    silent = F.timestamp_diff("SECOND", F.max("heartbeat_at"), now)
    rows = jobs.groupBy("job_id").agg(silent.alias("silent_seconds"))
    return rows.withColumn("state", F.when(F.col("silent_seconds") >= dead_after, "dead").when(F.col("silent_seconds") >= stale_after, "stale").otherwise("running"))


def release_files(t: Tables) -> DataFrame:
    """Files and rows of each release, those without files too."""
    files = t["student_dataset_release_files"].groupBy(F.col("release_id").alias("id")).agg(F.count("*").alias("file_count"), F.sum("row_count").alias("row_count"))
    return t["student_dataset_releases"].select("id", "release_name", "status").join(files, "id", "left").fillna(0, ["file_count", "row_count"])


def batch_totals(t: Tables) -> DataFrame:
    """New players, matches and rating updates of each batch, and their running totals' shares."""
    out = t["monthly_batches"].select(F.col("id").alias("batch_id"), "generation_run_id", "batch_month")
    for name, table in (("players", "player_registrations"), ("matches", "matches"), ("rating_updates", "ratings_update_log")):
        out = out.join(t[table].groupBy("batch_id").agg(F.count("*").alias(name)), "batch_id", "left")
    out = out.fillna(0, ["players", "matches", "rating_updates"])
    whole = out.groupBy("generation_run_id").agg(F.sum("matches").alias("all_matches"))
    return out.join(F.broadcast(whole), "generation_run_id").withColumn("match_pct", pct(F.col("matches"), F.col("all_matches"))).drop("all_matches")


def forecast(sizes: DataFrame, months: int, monthly_growth: float) -> DataFrame:
    """table_name, month, rows: compound growth from each table's present rows."""
    ahead = F.explode(F.sequence(F.lit(0), F.lit(months)))
    return sizes.select("table_name", ahead.alias("month"), "rows").withColumn("rows", F.round(F.col("rows") * F.pow(F.lit(1 + monthly_growth), F.col("month"))).cast("long"))
