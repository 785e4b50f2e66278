"""Snapshots as of a month, and what changed since an earlier one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import suppressed


def project(rows: DataFrame, contract: Sequence[str], overrides: Mapping[str, Column] | None = None) -> DataFrame:
    """The contract's columns in order; ``overrides`` say how some are computed."""
    overrides = overrides or {}
    missing = [c for c in contract if c not in overrides and c not in rows.columns]
    if missing:
        raise ValueError(f"the source lacks {', '.join(missing)}")
    return rows.select(*[overrides.get(c, F.col(c)).alias(c) for c in contract])


def status_as_of(status: str, end: str, at: Column) -> Column:
    """A dormant or retired row whose end lies ahead was still active."""
    return F.when(F.col(status).isin("dormant", "retired") & (F.col(end) >= at), "active").otherwise(F.col(status))


def known_as_of(rows: DataFrame, start: str, end: str, at: Column, status: str | None = None) -> DataFrame:
    """Rows that had started before ``at``, without ends (and states) that lie ahead."""
    out = rows.where(F.col(start) < at)
    if status is not None:
        out = out.withColumn(status, status_as_of(status, end, at))
    return out.withColumn(end, suppressed(end, at))


def changed(current: DataFrame, prior: DataFrame, keys: Sequence[str], ignored: Sequence[str] = ()) -> DataFrame:
    """Rows of ``current`` that ``prior`` lacks or has otherwise. Rows that went are not found."""
    compared = [c for c in current.columns if c not in keys and c not in ignored]
    old = prior.select(*keys, F.struct(*[F.col(c) for c in compared]).alias("__old"), F.lit(True).alias("__there"))
    rows = current.join(old, list(keys), "left")
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__old.{c}")) for c in compared], F.lit(False))
    return rows.where(F.col("__there").isNull() | differs).select(current.columns)


def windows(months: Sequence, baseline: int) -> list[dict]:
    """Release windows over ordered months: a snapshot of the first ``baseline``, then one a month.

    Raises where months repeat or leave a gap.
    """
    ordinal = [m.year * 12 + m.month for m in months]
    if any(b - a != 1 for a, b in zip(ordinal, ordinal[1:], strict=False)):
        raise ValueError("months are not contiguous")
    if not 1 <= baseline <= len(months):
        raise ValueError("the baseline needs one month at least, and no more than there are")
    first = {"kind": "historical_baseline", "facts": list(months[:baseline]), "snapshot": list(months[:baseline]), "prior": []}
    return [first] + [{"kind": "monthly_update", "facts": [months[i]], "snapshot": list(months[: i + 1]), "prior": list(months[:i])} for i in range(baseline, len(months))]


def planned(months: DataFrame, month: str, baseline: int) -> DataFrame:
    """The windows of ``windows`` as rows, one a release; ``contiguous`` is false from the first gap on.

    release, kind, facts_from, facts_to, snapshot_from, snapshot_to, prior_to, months, contiguous. Months are made
    distinct first, so the window without a key sorts as many rows as there are months.
    """
    order = Window.orderBy("month")
    rows = months.select(F.trunc(F.col(month).cast("date"), "month").alias("month")).where("month IS NOT NULL").distinct()
    rows = rows.select("month", F.row_number().over(order).alias("months"), F.lag("month").over(order).alias("prior"), F.first("month").over(order).alias("first"))
    joined = F.coalesce(F.add_months("prior", 1) == F.col("month"), F.lit(True))
    rows = rows.withColumn("contiguous", F.bool_and(joined).over(order)).where(F.col("months") >= baseline)
    start = F.col("months") == baseline
    return rows.select(
        (F.col("months") - baseline + 1).alias("release"),
        F.when(start, "historical_baseline").otherwise("monthly_update").alias("kind"),
        F.when(start, F.col("first")).otherwise(F.col("month")).alias("facts_from"),
        F.col("month").alias("facts_to"),
        F.col("first").alias("snapshot_from"),
        F.col("month").alias("snapshot_to"),
        F.when(~start, F.col("prior")).alias("prior_to"),
        "months",
        "contiguous",
    )
