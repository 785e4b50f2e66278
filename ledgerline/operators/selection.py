"""Exactly the n rows of smallest hash, without sorting the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 52  # of a hash, as quality.token gives it
STEP = 16  # bits that one histogram looks at


def _edge(rows: DataFrame, n: int, at: str) -> tuple[int, int, int]:
    """(bucket, rows before it, rows in all): the bucket of ``at`` in which the n-th row lies."""
    counts = {r["b"]: r["k"] for r in rows.groupBy(F.col(at).alias("b")).agg(F.count("*").alias("k")).collect()}
    before = 0
    for b in sorted(counts):
        if before + counts[b] >= n:
            return b, before, sum(counts.values())
        before += counts[b]
    return -1, before, before


def n_smallest(rows: DataFrame, hashed: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of smallest ``hashed`` (in [0, 2**52)), by ``ties`` where hashes are equal; all rows if there are fewer.

    Two histograms of at most 2**16 counts find the bucket in which the n-th row lies; it holds one
    row in 2**32. Only its rows are ordered; all others are taken or left by a comparison.
    """
    if n <= 0:
        return rows.limit(0)
    top, low = BITS - STEP, BITS - 2 * STEP
    first, before, total = _edge(rows.withColumn("__b", F.shiftright(hashed, top)), n, "__b")
    if total <= n:
        return rows
    inside = rows.where(F.shiftright(hashed, top) == first).withColumn("__b", F.shiftright(hashed, low))
    second, within, _ = _edge(inside, n - before, "__b")
    bucket = F.shiftright(F.col(hashed), low)
    last = rows.where(bucket == second).orderBy(hashed, *ties).limit(n - before - within)
    return rows.where(bucket < second).unionByName(last)
