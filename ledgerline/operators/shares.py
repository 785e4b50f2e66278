"""Counts, shares of totals, buckets and targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; null where whole is 0 or null."""
    return F.round(F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double")), digits)


def ratio(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def bucket(value: Column, edges: Sequence[tuple[float, str]], rest: str, unknown: str | None = None) -> Column:
    """The label of the first edge that the value lies below, else ``rest``."""
    out = F.when(value.isNull(), F.lit(unknown)) if unknown is not None else None
    for upper, label in edges:
        out = (F if out is None else out).when(value < upper, label)
    return out.otherwise(rest)


def distribution(rows: DataFrame, *keys: str, within: Sequence[str] = (), count: str = "n", share: str = "pct") -> DataFrame:
    """A count for each key and its share of the total, or of the total of ``within``."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias(count))
    return counts.withColumn(share, pct(F.col(count), F.sum(count).over(Window.partitionBy(*within))))


def with_targets(shares: DataFrame, key: str, targets: Mapping[str, float], count: str = "n", share: str = "pct") -> DataFrame:
    """Adds ``configured_pct`` and ``pct_point_drift``; targets that were not seen count 0.

    Targets come first, in their order (column ``ordinal``), then what has no target.
    """
    spark = shares.sparkSession
    goal = spark.createDataFrame([(i, k, float(v)) for i, (k, v) in enumerate(targets.items())], f"ordinal int, {key} string, configured_pct double")
    both = shares.join(F.broadcast(goal), key, "full")
    both = both.withColumns({count: F.coalesce(count, F.lit(0)), share: F.coalesce(share, F.lit(0.0)), "ordinal": F.coalesce("ordinal", F.lit(len(targets)))})
    return both.withColumn("pct_point_drift", F.round(F.col(share) - F.col("configured_pct"), 2))


def histogram_of_counts(rows: DataFrame, *keys: str, value: str = "times", count: str = "n", share: str = "pct") -> DataFrame:
    """How many keys occur once, twice and so on."""
    return distribution(rows.groupBy(*keys).agg(F.count("*").alias(value)), value, count=count, share=share)


def normalised(rows: DataFrame, weight: Column, *cohort: str, digits: int = 8) -> DataFrame:
    """Adds ``probability``: a row's weight over the sum of its cohort's, rounded and not repaired."""
    total = F.sum(weight.cast("double")).over(Window.partitionBy(*cohort))
    return rows.withColumn("probability", F.round(F.try_divide(weight.cast("double"), total), digits))
