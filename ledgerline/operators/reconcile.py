"""Two copies of a table against each other, by key, with waivers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal(value: Column, kind: T.DataType) -> Column:
    """A value as text: numbers to six places, dates as ISO, text without outer space."""
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.round(value.cast("double"), 6).cast("string")
    if isinstance(kind, T.StringType):
        return F.trim(value)
    return value.cast("string")


def differences(left: DataFrame, right: DataFrame, key: str, columns: Mapping[str, str], waivers: DataFrame | None = None) -> DataFrame:
    """key, column_name, issue, left_value, right_value, waived.

    ``columns`` maps names of the left to those of the right. Issues: missing (no such key on
    the right), extra (none on the left), value. ``waivers`` has column_name and, if it is for
    one row only, the key as text in ``waived_key``.
    """
    one = left.select(F.col(key).alias("k"), F.array(*[normal(F.col(c), left.schema[c].dataType) for c in columns]).alias("l"))
    two = right.select(F.col(key).alias("k"), F.array(*[normal(F.col(c), right.schema[c].dataType) for c in columns.values()]).alias("r"))
    names = F.array(*map(F.lit, columns))
    both = one.join(two, "k", "full")
    cells = F.filter(F.transform(F.arrays_zip(names.alias("n"), F.col("l"), F.col("r")), lambda x: F.struct(x["n"].alias("column_name"), F.lit("value").alias("issue"), x["l"].alias("left_value"), x["r"].alias("right_value"))), lambda x: ~x["left_value"].eqNullSafe(x["right_value"]))
    whole = lambda issue: F.array(F.struct(F.lit("*").alias("column_name"), F.lit(issue).alias("issue"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value")))
    found = both.select("k", F.explode(F.when(F.col("r").isNull(), whole("missing")).when(F.col("l").isNull(), whole("extra")).otherwise(cells)).alias("x")).select(F.col("k").alias(key), "x.*")
    if waivers is None:
        return found.withColumn("waived", F.lit(False))
    # Two equi joins, as one with "or" would compare every difference with every waiver.
    every = waivers.where(F.col("waived_key").isNull()).select("column_name", F.lit(True).alias("w1")).distinct()
    some = waivers.where(F.col("waived_key").isNotNull()).select("column_name", F.col("waived_key").alias("wk"), F.lit(True).alias("w2")).distinct()
    rows = found.withColumn("wk", F.col(key).cast("string")).join(every, "column_name", "left").join(some, ["column_name", "wk"], "left")
    return rows.select(*found.columns, F.coalesce("w1", "w2", F.lit(False)).alias("waived"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("times")).where(F.col("times") > 1)


def summary(found: DataFrame) -> DataFrame:
    """column_name, issue, open and waived differences."""
    return found.groupBy("column_name", "issue").agg(F.count_if(~F.col("waived")).alias("open"), F.count_if("waived").alias("waived"))


def write(found: DataFrame, path: str, key: str) -> None:
    """Differences as CSV and as lines of JSON in order of the key, and their summary, in three folders."""
    ordered = found.orderBy(F.col(key).asc_nulls_last(), "column_name")
    ordered.write.mode("overwrite").option("header", True).csv(f"{path}/mismatches_csv")
    ordered.write.mode("overwrite").json(f"{path}/mismatches_json")
    summary(found).write.mode("overwrite").json(f"{path}/summary")
