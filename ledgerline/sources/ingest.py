"""Seed folders: which files, each in its own encoding, with row numbers and checksums, loaded again by source."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .delimited import Dataset

MARK = "ï»¿"  # a byte order mark, one letter a byte


def _cp1252() -> tuple[str, str]:
    """The letters of bytes 0x80 to 0x9f and what Windows-1252 has there; bytes it leaves open stay."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, b in pairs if b), "".join(b for _, b in pairs)


def discover(spark: SparkSession, folder: str, tokens: Sequence[str], suffixes: Sequence[str] = (".csv",)) -> DataFrame:
    """path, name, length of a folder's files that hold one of the tokens and end in a suffix, by path.

    Lists the files only: no content is read. Neither case counts.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    low = F.lower("name")
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    return files.where(any_of([low.contains(t.lower()) for t in tokens]) & any_of([low.endswith(s.lower()) for s in suffixes])).orderBy("path")


def checksums(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """name, length, sha256 over the file's name, a null byte, its bytes and a null byte.

    A file is one value here, so it may have 2 GB at most, as Spark's reader has it.
    """
    name, zero = F.element_at(F.split("path", "/"), -1), F.unhex(F.lit("00"))
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select(name.alias("name"), "length", F.sha2(F.concat(F.encode(name, "UTF-8"), zero, "content", zero), 256).alias("sha256"))


def read_numbered(spark: SparkSession, paths: Sequence[str] | str, dataset: Dataset) -> DataFrame:
    """All columns as text, with source_file and source_row_number.

    Rows are numbered as in the file, from 1, or from 2 after a header; blank lines do not count. Blocks of one
    file are read apart: each counts its rows, and the counts of the blocks before it are added.
    Letters are those of UTF-8 in files that are valid UTF-8 as a whole, else of Windows-1252.
    """
    reader = spark.read.option("delimiter", dataset.delimiter).option("header", dataset.header).option("encoding", "ISO-8859-1").option("mode", "PERMISSIVE")
    if not dataset.header:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in dataset.columns]))
    found = reader.csv(list(paths) if not isinstance(paths, str) else paths)
    names = [c.removeprefix(MARK) for c in found.columns]
    place = [F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    rows = found.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(found.columns, names)]).alias("row"), *place)
    raw = lambda c: F.encode(F.col("row")[c], "ISO-8859-1").cast("string")
    valid = reduce(lambda a, b: a & b, [F.coalesce(F.is_valid_utf8(raw(c)), F.lit(True)) for c in names])
    blocks = rows.groupBy("source_file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.bool_and(valid).alias("valid"))
    file = Window.partitionBy("source_file")
    before = F.coalesce(F.sum("n").over(file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("source_file", "block", "first", before.alias("before"), F.min("valid").over(file).alias("utf8"))
    letters = lambda c: F.regexp_replace(F.when(F.col("utf8"), raw(c)).otherwise(F.translate(F.col("row")[c], *_cp1252())), "^﻿", "").alias(c)
    number = (F.col("at") - F.col("first") + F.col("before") + (2 if dataset.header else 1)).alias("source_row_number")
    return rows.join(blocks, ["source_file", "block"]).select(*[letters(c) for c in names], "source_file", number)


def replace_by_source(kept: DataFrame, loaded: DataFrame, source: str = "source_file") -> DataFrame:
    """What was kept, with all rows of a source that was loaded again replaced by the new ones."""
    return kept.join(loaded.select(source).distinct(), source, "left_anti").unionByName(loaded)
