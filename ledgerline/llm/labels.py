"""Labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body


def fold(modulus: int, doc_id="doc_id"):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable, rows: int) -> DataFrame:
    """doc_id, text, y of at most ``rows`` labelled documents, by the smallest hashes of ids.

    The bound is a parameter of the classifiers; null labels and ids are left out, and of
    labels that contradict each other the larger counts.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", body().alias("text")).join(F.broadcast(chosen), "doc_id")
