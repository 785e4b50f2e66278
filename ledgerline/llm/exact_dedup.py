"""Exact deduplication by Grace hash partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, cut, small_batches

#: Distinct content that one in-memory table may hold.
BUCKET_BYTES = 64 << 20
#: A bucket that stays too large after so many levels holds one content only.
LEVELS = 6

_COMBINED = pa.schema([("bucket", pa.int64()), ("norm", pa.large_string()), ("sha", pa.binary()), ("min_id", pa.int64()), ("n", pa.int64())])
_CLASSES = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def normalised(text="text"):
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(body(text), r"[\x20\x09-\x0D]+", " ")


class Table:
    """An open-addressing table: content -> smallest id, rows.

    A dict probes by hash and compares whole keys, so two contents share a slot only
    if they are identical.
    """

    def __init__(self, limit: int):
        self.limit, self.bytes, self.rows = limit, 0, {}

    def add(self, norm: str, sha: bytes, bucket: int, key: int | None, n: int) -> None:
        row = self.rows.get(norm)
        if row is None:
            self.rows[norm] = [bucket, sha, key, n]
            self.bytes += len(norm) + 200
        else:
            if key is not None and (row[2] is None or key < row[2]):
                row[2] = key
            row[3] += n

    def full(self) -> bool:
        return self.bytes > self.limit

    def clear(self) -> None:
        self.rows, self.bytes = {}, 0


def _combine(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(limit)

        def out():
            norms = list(table.rows)
            rows = list(table.rows.values())
            step = 2000
            for i in range(0, len(norms), step):
                part = rows[i : i + step]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array(norms[i : i + step], pa.large_string()), pa.array([r[1] for r in part], pa.binary()), pa.array([r[2] for r in part], pa.int64()), pa.array([r[3] for r in part], pa.int64())], schema=_COMBINED)
            table.clear()

        for b in batches:
            for i in range(0, b.num_rows, 500):
                c = b.slice(i, 500).to_pydict()
                for bucket, norm, sha, key, n in zip(c["bucket"], c["norm"], c["sha"], c["min_id"], c["n"], strict=True):
                    table.add(norm, sha, bucket, key, n)
                if table.full():
                    yield from out()
        yield from out()

    return run


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come bucket by bucket; each bucket has a table of its own."""
    table, now = Table(0), None

    def out():
        rows = list(table.rows.values())
        table.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], schema=_CLASSES)

    for b in batches:
        for i in range(0, b.num_rows, 500):
            c = b.slice(i, 500).to_pydict()
            for bucket, norm, sha, key, n in zip(c["bucket"], c["norm"], c["sha"], c["min_id"], c["n"], strict=True):
                if bucket != now:
                    if table.rows:
                        yield out()
                    now = bucket
                table.add(norm, sha, bucket, key, n)
    if table.rows:
        yield out()


def buckets(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES, levels: int = LEVELS) -> DataFrame:
    """The partition tree: (level-0 bucket or its split) for each hash.

    ``rows`` has ``h`` and ``size``, one row a distinct hash. Level 0 has as many buckets as
    the total needs; a bucket that is too large is split by the next level's hash, and so on.
    Only sums by bucket are looked at. Returns the depth of each split level-0 bucket.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    n0 = max(1, -(-2 * total // bucket_bytes))
    out, over = [], None
    level = rows.withColumn("b", F.pmod("h", F.lit(n0)))
    for depth in range(levels):
        big = {r["b"] for r in level.groupBy("b").agg(F.sum("size").alias("s"), F.count("*").alias("k")).where((F.col("s") > bucket_bytes) & (F.col("k") > 1)).select("b").collect()}
        if not big:
            break
        out.append(sorted(big))
        level = level.where(F.col("b").isin(big)).withColumn("b", bucket_at(F.col("b"), F.col("h"), depth + 1))
    return n0, out


def bucket_at(bucket, h, depth: int):
    """A bucket's children: sixteen, dealt by a hash that differs from level to level."""
    return bucket * 16 + F.pmod(F.xxhash64(h, F.lit(depth)), F.lit(16)) + F.lit(1 << (40 + 2 * depth))


def classes(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, content=None) -> DataFrame:
    """sha (of the content), keep_id, group_size: one row for each distinct content.

    Each task first combines its own equal rows, so a content that a third of all rows hold
    reaches its bucket once a task and not once a row. Spark's shuffle writes the buckets'
    files; a bucket above ``bucket_bytes`` of distinct content is partitioned again by
    another hash before anything is written, until each fits a table that compares whole
    contents. Buckets of a partition are read one after the other.
    """
    spark = docs.sparkSession
    content = normalised() if content is None else content
    rows = docs.select(F.col("doc_id").cast("long").alias("min_id"), content.alias("norm")).withColumn("h", F.xxhash64("norm"))
    sizes = rows.select("h", F.octet_length("norm").cast("long").alias("size")).groupBy("h").agg(F.max("size").alias("size"))
    n0, splits = buckets(sizes, bucket_bytes)
    bucket = F.pmod("h", F.lit(n0))
    for depth, big in enumerate(splits):
        bucket = F.when(bucket.isin(big), bucket_at(bucket, F.col("h"), depth + 1)).otherwise(bucket)
    dealt = rows.select(bucket.alias("bucket"), "norm", F.unhex(F.sha2("norm", 256)).alias("sha"), "min_id", F.lit(1).cast("long").alias("n"))
    combined = dealt.mapInArrow(_combine(min(bucket_bytes, 32 << 20)), "bucket long, norm string, sha binary, min_id long, n long")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n0)
    return combined.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_solve, "sha binary, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (after white-space normalisation; null is empty) the smallest doc_id stays.
    A null doc_id counts as larger than any other; repeated rows with one id count as so many
    rows of the group and are kept or dropped together. An empty table gives an empty result.
    Other columns of ``docs`` are not looked at.
    """
    with small_batches(docs.sparkSession):
        found = cut(classes(docs, bucket_bytes))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(), 256)).alias("sha"))
    return ids.join(found, "sha").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    A row goes only for its own text: other texts with its doc_id stay. Of a text whose rows
    all have null ids one row stays.
    """
    with small_batches(docs.sparkSession):
        found = cut(classes(docs, bucket_bytes))
    found = found.select(F.col("sha").alias("__sha"), F.col("keep_id").alias("__keep"))
    rows = docs.withColumn("__sha", F.unhex(F.sha2(normalised(), 256)))
    return keepers(rows, found, ["__sha"]).drop("__sha")


def keepers(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose ``key`` and doc_id ``found`` (key, __keep) names; of those with null ids one a key."""
    named = found.where(F.col("__keep").isNotNull())
    unnamed = found.where(F.col("__keep").isNull()).drop("__keep")
    one = rows.where(F.col("doc_id").isNotNull()).withColumn("__keep", F.col("doc_id").cast("long")).join(named, [*key, "__keep"], "left_semi").select(*rows.columns)
    two = rows.where(F.col("doc_id").isNull()).join(unnamed, key, "left_semi").dropDuplicates(key)
    return one.union(two.select(*rows.columns))
