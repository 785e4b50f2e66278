"""Tables of a database: read in ranges of a key that hold about as many rows each, written by way of a stage."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SPLITS = 16  # that a range with too many rows is looked at in


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _asked(spark: SparkSession, url: str, sql: str, properties: Mapping[str, str]) -> list:
    return spark.read.jdbc(url, f"({sql}) t", properties=dict(properties)).collect()


def ranges(spark: SparkSession, url: str, table: str, key: str, rows_each: int, properties: Mapping[str, str] | None = None) -> list[str]:
    """Conditions that part a table by a whole-number key: each holds for about ``rows_each`` rows at most.

    The database counts rows by equal parts of the key's range; a part with too many rows is looked at
    again in finer parts, so a hot stretch of keys becomes many ranges, and neighbours with few
    rows become one. Only one key's own rows can't be parted. Null keys have a range of their own.
    """
    k, name, properties = quoted(key), quoted(table), properties or {}
    low, high, nulls = _asked(spark, url, f"SELECT MIN({k}) AS a, MAX({k}) AS b, COUNT(*) - COUNT({k}) AS c FROM {name}", properties)[0]
    out = [f"{k} IS NULL"] if nulls else []
    if low is None:
        return out or ["1 = 1"]
    counts: list[tuple[int, int, int]] = []  # from, to (not in it), rows
    todo = [(int(low), int(high) + 1)]
    while todo:
        a, b = todo.pop()
        width = max(1, -(-(b - a) // SPLITS))
        for r in _asked(spark, url, f"SELECT b, COUNT(*) AS n FROM (SELECT ({k} - {a}) / {width} AS b FROM {name} WHERE {k} >= {a} AND {k} < {b}) x GROUP BY b", properties):
            start, n = a + int(r[0]) * width, int(r[1])
            if n > rows_each and width > 1:
                todo.append((start, min(b, start + width)))
            else:
                counts.append((start, min(b, start + width), n))
    held, first = 0, int(low)
    for a, _, n in sorted(counts):
        if held and held + n > rows_each:
            out.append(f"{k} >= {first} AND {k} < {a}")
            held, first = 0, a
        held += n
    return [*out, f"{k} >= {first}"]


def read(spark: SparkSession, url: str, table: str, key: str, rows_each: int = 1_000_000, properties: Mapping[str, str] | None = None) -> DataFrame:
    """A table in tasks of about as many rows each; filters and columns go to the database."""
    return spark.read.jdbc(url, quoted(table), predicates=ranges(spark, url, table, key, rows_each, properties), properties=dict(properties or {}))


@contextmanager
def _transaction(spark: SparkSession, url: str, properties: Mapping[str, str]):
    given = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        yield connection.createStatement()
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def replace_rows(rows: DataFrame, url: str, table: str, where: str | None = None, properties: Mapping[str, str] | None = None) -> int:
    """Put ``rows`` in place of those for which ``where`` holds (all, if it is null). Returns how many there are.

    Tasks write to a stage, where rows of tasks that ran twice would show in the count; one
    transaction in the database then deletes and inserts. Doing it again changes nothing, and what breaks
    off before that transaction leaves the table as it was.
    """
    spark, properties = rows.sparkSession, properties or {}
    stage = f"stage_{uuid.uuid4().hex[:12]}"
    rows.write.jdbc(url, quoted(stage), mode="overwrite", properties=dict(properties))
    n, sent = _asked(spark, url, f"SELECT COUNT(*) AS n FROM {quoted(stage)}", properties)[0][0], rows.count()
    columns = ", ".join(map(quoted, rows.columns))
    with _transaction(spark, url, properties) as statement:
        if n == sent:
            statement.executeUpdate(f"DELETE FROM {quoted(table)}" + (f" WHERE {where}" if where else ""))
            statement.executeUpdate(f"INSERT INTO {quoted(table)} ({columns}) SELECT {columns} FROM {quoted(stage)}")
        statement.executeUpdate(f"DROP TABLE {quoted(stage)}")
    if n != sent:
        raise ValueError(f"the stage has {n} rows of {sent}")
    return n
