"""A release on disk: Parquet tables and a manifest, staged and then promoted."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def schema_hash(rows: DataFrame) -> str:
    return hashlib.sha256(json.dumps([[f.name, f.dataType.simpleString(), f.nullable] for f in rows.schema]).encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def file_list(spark: SparkSession, path: str) -> list[dict]:
    """name, bytes, rows and sha256 of each Parquet file of a table; digests and counts are made in tasks."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    raw = raw.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("rows"))
    return [r.asDict() for r in raw.join(rows, "name", "left").na.fill(0, ["rows"]).orderBy("name").collect()]


def write(tables: Mapping[str, DataFrame], root: str, name: str, about: Mapping | None = None, single_file: bool = False) -> dict:
    """Write each table under a staging folder, check it, and rename the folder into place.

    An empty table becomes files with its schema and no rows. The manifest has each table's
    rows, ordered columns and schema hash, and of each file its rows, bytes and SHA-256; ``about``
    may give the window as first_day and last_day. Paths may be on any file system that Spark opens.
    A release that is there already is not replaced.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, final = _fs(spark, f"{root}/{name}")
    if fs.exists(final):
        raise FileExistsError(f"{root}/{name}")
    staging = f"{root}/_staging_{name}"
    manifest = {"release": name, **(about or {}), "tables": {}}
    for table, rows in tables.items():
        path = f"{staging}/{table}"
        (rows.coalesce(1) if single_file else rows).write.mode("overwrite").option("compression", "snappy").parquet(path)
        back = spark.read.parquet(path)
        if back.columns != rows.columns:
            raise ValueError(f"{table} reads back with other columns")
        files = file_list(spark, path)
        manifest["tables"][table] = {"row_count": sum(f["rows"] for f in files), "columns": back.columns, "schema_hash": schema_hash(back), "files": files}
    text = json.dumps(manifest, indent=1, default=str)
    out = fs.create(_fs(spark, f"{staging}/manifest.json")[1])
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(_fs(spark, staging)[1], final):
        raise OSError(f"{staging} can't be renamed")
    return manifest


def read(spark: SparkSession, root: str, name: str) -> tuple[dict[str, DataFrame], dict]:
    """(tables, manifest) of a promoted release."""
    row = spark.read.text(f"{root}/{name}/manifest.json", wholetext=True).first()
    manifest = json.loads(row["value"])
    return {t: spark.read.parquet(f"{root}/{name}/{t}") for t in manifest["tables"]}, manifest
