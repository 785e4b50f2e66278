"""Checks of tables: each one row of (category, name, status, failures), all in one result."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pairs import orphans


def _result(category: str, name: str, failures: DataFrame) -> DataFrame:
    n = F.col("failures")
    return failures.select(F.lit(category).alias("category"), F.lit(name).alias("name"), F.when(n == 0, "passed").otherwise("failed").alias("status"), n)


def unique(name: str, rows: DataFrame, *keys: str) -> DataFrame:
    """Fails for each key that several rows have."""
    twice = rows.groupBy(*keys).agg(F.count("*").alias("k")).where(F.col("k") > 1)
    return _result("primary_key", name, twice.agg(F.count("*").alias("failures")))


def required(name: str, rows: DataFrame, *columns: str) -> DataFrame:
    """Fails for each row in which any of the columns is null."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return _result("required", name, rows.agg(F.count_if(bad).alias("failures")))


def references(name: str, child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Fails for each row whose non-null reference no parent has."""
    return _result("foreign_key", name, orphans(child, parent, fk, pk).agg(F.count("*").alias("failures")))


def holds(category: str, name: str, rows: DataFrame, condition: str) -> DataFrame:
    """Fails for each row that contradicts the condition; one that is unknown does not count."""
    return _result(category, name, rows.agg(F.count_if(~F.expr(condition)).alias("failures")))


def not_empty(name: str, rows: DataFrame) -> DataFrame:
    return _result("not_empty", name, rows.limit(1).agg((1 - F.count("*")).alias("failures")))


def count_is(name: str, rows: DataFrame, expected: int) -> DataFrame:
    return _result("row_count", name, rows.agg(F.abs(F.count("*") - F.lit(expected)).alias("failures")))


def columns_are(name: str, rows: DataFrame, expected: Iterable[str]) -> DataFrame:
    """Fails for each column that is missing, extra or out of order."""
    expected, found = list(expected), rows.columns
    wrong = len(set(expected) ^ set(found)) or int(expected != found)
    return _result("columns", name, rows.sparkSession.createDataFrame([(wrong,)], "failures long"))


def shape_drift(rows: DataFrame, expected: T.StructType) -> DataFrame:
    """column_name, problem, expected, found: columns that are missing, extra, moved or of another type.

    Works on the plan's schema alone; no row is read.
    """
    want, have = ({f.name: (i, f.dataType.simpleString()) for i, f in enumerate(s.fields)} for s in (expected, rows.schema))
    found = [(c, "missing", want[c][1], None) for c in want if c not in have] + [(c, "extra", None, have[c][1]) for c in have if c not in want]
    both = [c for c in want if c in have]
    there = sorted(both, key=lambda c: have[c][0])
    found += [(c, "moved", str(both.index(c) + 1), str(there.index(c) + 1)) for c in both if both.index(c) != there.index(c)]
    found += [(c, "type", want[c][1], have[c][1]) for c in both if want[c][1] != have[c][1]]
    return rows.sparkSession.createDataFrame(found, "column_name string, problem string, expected string, found string")


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def failed_first(results: DataFrame) -> DataFrame:
    """A report's rows in the order in which they are read: failures first, the largest before the others."""
    return results.orderBy((F.col("status") == "failed").desc(), F.col("failures").desc_nulls_last(), "category", "name")
