"""Unordered pairs, missing partners and expected cells."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roster_keys(members: DataFrame, group: Sequence[str], member: str, exactly: int | None = None) -> DataFrame:
    """group, roster_key ("smaller:larger"), first_id, second_id of each group's members."""
    out = members.groupBy(*group).agg(F.min(member).alias("first_id"), F.max(member).alias("second_id"), F.count("*").alias("members"))
    if exactly is not None:
        out = out.where(F.col("members") == exactly)
    return out.withColumn("roster_key", F.concat(F.col("first_id").cast("string"), F.lit(":"), F.col("second_id").cast("string")))


def unordered(rows: DataFrame, one: str, two: str, low: str = "low_id", high: str = "high_id") -> DataFrame:
    """Adds the pair with its smaller id first (null where either is null)."""
    ok = F.col(one).isNotNull() & F.col(two).isNotNull()
    return rows.withColumn(low, F.when(ok, F.least(one, two))).withColumn(high, F.when(ok, F.greatest(one, two)))


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows of ``child`` whose non-null ``fk`` no ``pk`` has."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def missing_cells(seen: DataFrame, *axes: DataFrame) -> DataFrame:
    """Combinations of the axes' rows (small tables, one column or more each) not in ``seen``."""
    expected = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), axes)
    return expected.join(seen, expected.columns, "left_anti")


def closure(*ids: DataFrame) -> DataFrame:
    """The distinct ids of several one-column tables."""
    return reduce(DataFrame.union, ids).distinct()


def ordered_json(members: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Each group's values as a JSON list, in order. For groups of bounded size, such as a team's members."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__value"))))
    return members.groupBy(*group).agg(F.to_json(F.transform(listed, lambda x: x["__value"])).alias(name))
