"""What of a release is on disk: files, rows and columns as tables, held against its manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .release import _fs

MANIFEST = "release string, first_day string, last_day string, tables map<string, struct<row_count: long, columns: array<string>, schema_hash: string, files: array<struct<name: string, bytes: long, rows: long, sha256: string>>>>"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """release, table_name, row_count, columns, schema_hash, files, first_day, last_day: the manifests below ``root`` as a table."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(f"{root}/*/manifest.json")
    return rows.select("release", "first_day", "last_day", F.explode("tables").alias("table_name", "t")).select("release", "table_name", "t.row_count", "t.columns", "t.schema_hash", "t.files", "first_day", "last_day")


def listed(spark: SparkSession, root: str, digests: bool = False) -> DataFrame:
    """release, table_name, name, bytes and, if asked for, sha256 of each Parquet file below ``root``/release/table.

    The listing is a scan without contents; digests read each file whole, in the task that has it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    place = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)$", k)
    rows = files.select(place(1).alias("release"), place(2).alias("table_name"), place(3).alias("name"), F.col("length").alias("bytes"), *([F.sha2("content", 256).alias("sha256")] if digests else []))
    return rows.where(~F.col("release").startswith("_staging_"))


def counted(spark: SparkSession, root: str, release: str, tables: list[str]) -> DataFrame:
    """table_name, name, rows of each file that can be read; one that can't has no row."""
    out = None
    for t in tables:
        found = spark.read.schema("__none int").option("ignoreCorruptFiles", True).option("pathGlobFilter", "*.parquet").parquet(f"{root}/{release}/{t}")
        rows = found.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "name", "rows")
        out = rows if out is None else out.unionByName(rows)
    return out


def release_on_disk(spark: SparkSession, root: str, release: str, digests: bool = False) -> DataFrame:
    """category, name, status, failures: each table's folder, files, rows, columns and schema against the manifest."""
    said = manifests(spark, root).where(F.col("release") == release).drop("release")
    tables = [r["table_name"] for r in said.select("table_name").orderBy("table_name").collect()]
    fs, _ = _fs(spark, root)
    there = [t for t in tables if fs.exists(_fs(spark, f"{root}/{release}/{t}")[1])]
    disk = listed(spark, root, digests).where(F.col("release") == release).drop("release")
    files = said.select("table_name", F.explode("files").alias("f")).select("table_name", "f.name", F.col("f.bytes").alias("said_bytes"), F.col("f.rows").alias("said_rows"), F.col("f.sha256").alias("said_sha256"))
    both = files.join(disk, ["table_name", "name"], "full")
    if there:
        both = both.join(counted(spark, root, release, there), ["table_name", "name"], "left")
    else:
        both = both.withColumn("rows", F.lit(None).cast("long"))
    known, found = F.col("said_bytes").isNotNull(), F.col("bytes").isNotNull()
    rules = {
        "file_exists": known & ~found,
        "unexpected_file": ~known & found,
        "file_size": known & found & (F.col("bytes") != F.col("said_bytes")),
        "readable": known & found & (F.col("said_rows") > 0) & F.col("rows").isNull(),
        "file_rows": known & found & F.col("rows").isNotNull() & (F.col("rows") != F.col("said_rows")),
    }
    if digests:
        rules["checksum"] = known & found & (F.col("sha256") != F.col("said_sha256"))
    by_table = both.groupBy("table_name").agg(*[F.count_if(F.coalesce(x, F.lit(False))).alias(n) for n, x in rules.items()], F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    by_table = by_table.join(said.select("table_name", "row_count"), "table_name", "left").withColumn("row_count", F.when(F.col("row_count").isNotNull(), F.abs(F.col("row_count") - F.col("rows"))).otherwise(0))
    parts = [by_table.select(F.explode(F.array(*[F.struct(F.lit(n).alias("category"), F.col("table_name").alias("name"), F.col(n).cast("long").alias("failures")) for n in (*rules, "row_count")])).alias("r")).select("r.*")]
    shapes = []
    for r in said.collect():
        got = None
        if r["table_name"] in there:
            try:
                got = spark.read.parquet(f"{root}/{release}/{r['table_name']}").columns
            except Exception:  # no file of the table has a footer; the files' own rows say which
                got = None
        shapes.append((r["table_name"], int(got != r["columns"])))
    parts.append(spark.createDataFrame(shapes, "name string, failures long").select(F.lit("columns").alias("category"), "name", "failures"))
    return parts[0].unionByName(parts[1]).select("category", "name", F.when(F.col("failures") == 0, "passed").otherwise("failed").alias("status"), "failures")
