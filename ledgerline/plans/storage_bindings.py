"""Streams driven to their end, tables rewritten in part and releases read back, bound to the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import faults
from ledgerline.sources import interim, inventory, release, versions
from ledgerline.streaming import look_back, taint

from . import domain, fault_bindings, release_bindings, snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, of the files that are there: a pattern, as a streaming source takes no single file by name."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


@query("""
    WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS value FROM events GROUP BY 1, 2)
    SELECT a.user_id, a.day, a.value, CAST(coalesce(sum(b.value), 0) AS BIGINT) AS recent FROM d a LEFT JOIN d b ON b.user_id = a.user_id AND b.day BETWEEN a.day - 14 AND a.day - 1 GROUP BY 1, 2, 3""")
def recent_activity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_back.recent_by_stream(event_stream(spark, sf_dir).withColumn("one", F.lit(1)), "user_id", "ts", "one")


_K = "CAST('0x' || substr(sha256('stream|event_type|' || event_id), 1, 13) AS BIGINT)"


@query(f"SELECT event_id, 'event_type' AS column_name, 'missing' AS issue_type, event_type AS clean_value, CAST(NULL AS VARCHAR) AS tainted_value FROM events WHERE event_type IS NOT NULL AND {_K} < {int(0.04 * 2**52)}")
def streamed_fault_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, state = interim.path(spark, "tainted"), interim.path(spark, "tainted-state")
    taint.taint_batches(event_stream(spark, sf_dir), path, state, "event_id", {"event_type": "missing"}, 0.04, "stream").awaitTermination()
    return taint.landed(spark, path)[1].drop("batch")


@query(domain.oracle(f"""
    WITH {fault_bindings._turns('low')} SELECT r.id, player_id, rating_date, CASE WHEN a.id IS NULL THEN rating_type END AS rating_type, CASE WHEN b.id IS NULL THEN note ELSE b.tainted_value END AS note, coalesce(CAST(c.tainted_value AS DOUBLE), rating_value) AS rating_value, coalesce(CAST(d.tainted_value AS DATE), seen_on) AS seen_on
    FROM r LEFT JOIN {fault_bindings._LAST} a ON a.id = r.id AND a.column_name = 'rating_type' LEFT JOIN {fault_bindings._LAST} b ON b.id = r.id AND b.column_name = 'note' LEFT JOIN {fault_bindings._LAST} c ON c.id = r.id AND c.column_name = 'rating_value' LEFT JOIN {fault_bindings._LAST} d ON d.id = r.id AND d.column_name = 'seen_on'"""))
def ratings_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings, appended to a table in two parts and rewritten where faults hit."""
    path, rows = interim.path(spark, "ratings"), fault_bindings.clean(domain.tables(spark, sf_dir))
    late = F.col("rating_date") >= "1996-01-01"
    versions.append(rows.where(~late), path)
    versions.append(rows.where(late), path)
    cells = faults.exact_cells(versions.read(spark, path), fault_bindings.injection("low"))
    versions.inject_into(spark, path, "id", cells, faults.applied)
    return versions.read(spark, path)


@query(domain.oracle(" UNION ALL ".join(f"SELECT 'update' AS release, '{n}' AS table_name, count(*) AS row_count, '2000-01-01' AS first_day FROM ({text})" for n, text in release_bindings._NOW.items())))
def release_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release as it is written, by what its manifest says."""
    t, root = domain.tables(spark, sf_dir), interim.path(spark, "releases")
    made = {n: f(t, release_bindings.UPDATE) for n, f in snapshots.SNAPSHOT.items()}
    release.write(made, root, "update", {"first_day": "2000-01-01", "last_day": "2000-12-31"})
    return inventory.manifests(spark, root).select("release", "table_name", "row_count", "first_day")
