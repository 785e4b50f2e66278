"""State over time: latest rows, validity intervals, spans, look-back windows, growth."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], until: Column | None = None) -> DataFrame:
    """The row of each key that is last by ``order``; with ``until``, among rows where it holds.

    Each task first finds the greatest first value of ``order`` by key in a hash table. The rows pass by what
    was found, by hashed key and value, and only those that have it (one a key, if none tie) are put in order.
    """
    rows = rows if until is None else rows.where(until)
    others = [c for c in rows.columns if c not in keys and c not in order]
    top = rows.groupBy(*keys).agg(F.max(order[0]).alias(order[0])).withColumnsRenamed({c: f"__top_{c}" for c in (*keys, order[0])})
    met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__top_{c}")) for c in (*keys, order[0])])
    last = rows.join(top.hint("shuffle_hash"), met, "left_semi")
    best = last.groupBy(*keys).agg(F.max(F.struct(*order, *others)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in (*order, *others)])


def active(start: str | Column, end: str | Column, at: Column) -> Column:
    """start <= at and (end is null or end > at): half-open validity."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return (start <= at) & (end.isNull() | (end > at))


def suppressed(end: str, at: Column) -> Column:
    """An end that lies at or after ``at`` is not yet known: null."""
    return F.when(F.col(end) >= at, None).otherwise(F.col(end))


def spans(rows: DataFrame, key: str, at: str, last: Column, start: str = "from_at", end: str = "to_at") -> DataFrame:
    """Each row holds from its ``at`` until the key's next one, or until ``last``."""
    after = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    return rows.withColumn(start, F.col(at)).withColumn(end, F.coalesce(after, last))


def at_each(rows: DataFrame, start: str = "from_at", end: str = "to_at", at: str = "at") -> DataFrame:
    """A row for each integer point of [start, end): a range join as an equi join later."""
    return rows.where(F.col(start) < F.col(end)).withColumn(at, F.explode(F.sequence(start, F.col(end) - 1)))


def look_back(daily: DataFrame, key: str, day: str, value: str, days: int, name: str) -> DataFrame:
    """The sum of ``value`` over the ``days`` days before, the day itself left out."""
    near = Window.partitionBy(key).orderBy(F.unix_date(day)).rangeBetween(-days, -1)
    return daily.withColumn(name, F.coalesce(F.sum(value).over(near), F.lit(0)))


def growth(rows: DataFrame, order: str, *values: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds ``<value>_growth_pct``: change in percent against the row before."""
    before = Window.partitionBy(*within).orderBy(order)
    for v in values:
        prior = F.lag(v).over(before).cast("double")
        rows = rows.withColumn(f"{v}_growth_pct", F.round(F.try_divide(F.lit(100.0) * (F.col(v) - prior), prior), 2))
    return rows


def age_years(birth: Column, at: Column) -> Column:
    """Whole years by the calendar: a birthday counts from its month and day."""
    return F.year(at) - F.year(birth) - (F.date_format(at, "MMdd") < F.date_format(birth, "MMdd")).cast("int")


def trend(rows: DataFrame, order: str, value: str, warning: float, error: float, within: Sequence[str] = ()) -> DataFrame:
    """order, value, earlier, expected, delta_pct, severity: each row against the line through the rows before it.

    Two earlier rows make a line. ``rows`` are sums by release or batch, so a window over all of them is small.
    """
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("earlier", F.count("*").over(before)).withColumn("slope", F.regr_slope(value, order).over(before)).withColumn("intercept", F.regr_intercept(value, order).over(before))
    expected = F.when(F.col("earlier") >= 2, F.round(F.col("slope") * F.col(order) + F.col("intercept"), 4))
    rows = rows.withColumn("expected", expected).withColumn("delta_pct", F.round(F.try_divide(F.lit(100.0) * (F.col(value) - F.col("expected")), F.col("expected")), 2))
    severity = F.when(F.abs("delta_pct") >= error, "error").when(F.abs("delta_pct") >= warning, "warning").otherwise("ok")
    return rows.select(*within, order, value, "earlier", "expected", "delta_pct", severity.alias("severity"))
