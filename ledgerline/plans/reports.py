"""Reports on the run times of a generation: stages, subphases, slow-down, gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.history import growth
from ledgerline.operators.pairs import missing_cells
from ledgerline.operators.shares import pct, ratio

Tables = Mapping[str, DataFrame]


def seconds(ms: Column) -> Column:
    return F.round(ms.cast("double") / 1000, 3)


def of_latest_run(t: Tables, run: int | None = None) -> DataFrame:
    """Metrics of the run, or of the one that started last."""
    m = t["generation_runtime_metrics"]
    if run is not None:
        return m.where(F.col("generation_run_id") == run)
    last = m.groupBy("generation_run_id").agg(F.max("started_at").alias("s")).orderBy(F.desc("s"), F.desc("generation_run_id")).limit(1)
    return m.join(F.broadcast(last.select("generation_run_id")), "generation_run_id")


def batch_summary(t: Tables, stage: str, parts: Mapping[str, Sequence[str]], run: int | None = None) -> DataFrame:
    """Seconds of a stage by batch, in all and of named groups of subphases."""
    rows = of_latest_run(t, run).where(F.col("stage_name") == stage)
    sums = [F.sum(F.when(F.col("subphase_name").isin(*names), F.col("elapsed_ms"))).alias(part) for part, names in parts.items()]
    out = rows.groupBy("batch_id").agg(F.sum("elapsed_ms").alias("total"), *sums)
    return out.select("batch_id", seconds(F.col("total")).alias("total_seconds"), *[seconds(F.col(p)).alias(f"{p}_seconds") for p in parts])


def subphase_totals(t: Tables, run: int | None = None) -> DataFrame:
    """Seconds and share of each stage's subphases."""
    out = of_latest_run(t, run).groupBy("stage_name", "subphase_name").agg(F.count("*").alias("metrics"), F.sum("elapsed_ms").alias("ms"), F.max("elapsed_ms").alias("most"))
    share = pct(F.col("ms"), F.sum("ms").over(Window.partitionBy("stage_name")))
    return out.select("stage_name", "subphase_name", "metrics", seconds(F.col("ms")).alias("total_seconds"), seconds(F.col("most")).alias("longest_seconds"), share.alias("pct_of_stage"))


def throughput(t: Tables, run: int | None = None) -> DataFrame:
    """Rows a second and attempts a row by batch and stage."""
    out = of_latest_run(t, run).groupBy("batch_id", "stage_name").agg(F.sum("output_count").alias("rows"), F.sum("attempt_count").alias("attempts"), F.sum("elapsed_ms").alias("ms"))
    return out.select("batch_id", "stage_name", "rows", ratio(F.col("rows") * 1000, F.col("ms")).alias("rows_per_second"), ratio(F.col("attempts"), F.col("rows")).alias("attempts_per_row"))


def slow_down(t: Tables, stage: str, run: int | None = None) -> DataFrame:
    """Each batch's seconds against the batch before and against the first."""
    rows = of_latest_run(t, run).where(F.col("stage_name") == stage).groupBy("batch_id").agg(F.sum("elapsed_ms").alias("total"))
    order = Window.orderBy("batch_id")
    rows = growth(rows, "batch_id", "total")
    return rows.select("batch_id", seconds(F.col("total")).alias("total_seconds"), seconds(F.col("total") - F.lag("total").over(order)).alias("seconds_more"), ratio(F.col("total"), F.first("total").over(order)).alias("multiple_of_first"), "total_growth_pct")


def slowest(t: Tables, n: int = 25, run: int | None = None) -> DataFrame:
    return of_latest_run(t, run).orderBy(F.desc("elapsed_ms"), "id").limit(n).select("id", "batch_id", "stage_name", "subphase_name", seconds(F.col("elapsed_ms")).alias("elapsed_seconds"))


def gaps(t: Tables, stage: str, expected: Sequence[str], run: int | None = None) -> DataFrame:
    """Subphases that a batch lacks, and metrics that did not complete."""
    rows = of_latest_run(t, run).where(F.col("stage_name") == stage)
    spark = rows.sparkSession
    batches = of_latest_run(t, run).select("batch_id").distinct()
    names = spark.createDataFrame([(e,) for e in expected], "subphase_name string")
    lost = missing_cells(rows.select("batch_id", "subphase_name").distinct(), batches, names).withColumn("metric_status", F.lit("missing"))
    bad = rows.where((F.col("event_type") != "completed") & F.col("subphase_name").isin(*expected)).select("batch_id", "subphase_name", F.col("event_type").alias("metric_status"))
    return lost.unionByName(bad)


def subphases_by_batch(t: Tables, stage: str, run: int | None = None) -> DataFrame:
    """Every metric of a stage beside its batch's place and month."""
    batches = t["monthly_batches"].select(F.col("id").alias("batch_id"), "batch_sequence", "batch_month")
    rows = of_latest_run(t, run).where(F.col("stage_name") == stage).join(batches, "batch_id", "left")
    return rows.select("id", "batch_sequence", "batch_month", "batch_id", "subphase_name", "event_type", seconds(F.col("elapsed_ms")).alias("elapsed_seconds"), "input_count", "output_count", "attempt_count", "started_at", "completed_at")


def parent() -> Column:
    """The subphase that a metric is a detail of, from its JSON; empty where it is none."""
    return F.coalesce(F.get_json_object("metadata_json", "$.parent_subphase"), F.lit(""))


def shares_of(rows: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """Totals by subphase, and their share of the total of ``whole`` (by default of ``rows``)."""
    out = rows.groupBy("subphase_name").agg(
        F.count("*").alias("metric_rows"), F.sum("elapsed_ms").alias("ms"), F.avg("elapsed_ms").alias("mean"), F.max("elapsed_ms").alias("most"),
        *[F.sum(c).alias(c) for c in ("input_count", "output_count", "attempt_count")],
    )
    one = (rows if whole is None else whole).agg(F.sum("elapsed_ms").alias("whole"))
    out = out.crossJoin(F.broadcast(one))  # one row
    return out.select("subphase_name", "metric_rows", seconds(F.col("ms")).alias("elapsed_seconds"), pct(F.col("ms"), F.col("whole")).alias("pct_of_whole"), seconds(F.col("mean")).alias("avg_seconds"), seconds(F.col("most")).alias("max_seconds"), "input_count", "output_count", "attempt_count")


def stage_totals(t: Tables, stage: str, run: int | None = None) -> DataFrame:
    """Completed subphases of a stage: the pipeline's stages, players, ratings."""
    return shares_of(of_latest_run(t, run).where((F.col("stage_name") == stage) & (F.col("event_type") == "completed")))


def detail_totals(t: Tables, stage: str, subphase: str, run: int | None = None) -> DataFrame:
    """The details of one subphase (planning, scoring, persistence) against its own completed time."""
    rows = of_latest_run(t, run).where(F.col("stage_name") == stage)
    return shares_of(rows.where(parent() == subphase), rows.where((F.col("subphase_name") == subphase) & (F.col("event_type") == "completed")))


def batch_spans(t: Tables, stage: str, sums: Mapping[str, str], counts: Mapping[str, str], run: int) -> DataFrame:
    """Each batch of a run with the stage's completed time, its span from first to last, and some subphases'
    seconds (``sums``) and largest outputs (``counts``). Batches without metrics stay."""
    done = t["generation_runtime_metrics"].where((F.col("stage_name") == stage) & (F.col("event_type") == "completed"))
    here = lambda name, column: F.when(F.col("subphase_name") == name, F.col(column))
    found = done.groupBy("batch_id").agg(
        F.sum("elapsed_ms").alias("ms"), F.min("started_at").alias("first"), F.max("completed_at").alias("last"),
        *[F.sum(here(name, "elapsed_ms")).alias(alias) for alias, name in sums.items()], *[F.max(here(name, "output_count")).alias(alias) for alias, name in counts.items()],
    )
    batches = t["monthly_batches"].where(F.col("generation_run_id") == run).select(F.col("id").alias("batch_id"), "batch_sequence", "batch_month")
    span = F.unix_timestamp(F.col("last").cast("timestamp")) - F.unix_timestamp(F.col("first").cast("timestamp"))
    return batches.join(found, "batch_id", "left").select("batch_sequence", "batch_month", "batch_id", seconds(F.col("ms")).alias("measured_seconds"), span.alias("span_seconds"), *[seconds(F.col(a)).alias(f"{a}_seconds") for a in sums], *counts)


def failed_first(checks: DataFrame) -> DataFrame:
    """Checks in the order of a report: failed ones, then by category and name, unknown categories last."""
    return checks.orderBy(F.when(F.col("status") == "failed", 0).otherwise(1), F.col("category").asc_nulls_last(), "name")
