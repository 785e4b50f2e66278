"""Parquet tables that are appended to and rewritten in part: files never change, versions name them.

A version is a list of data files. Appending adds files; a rewrite replaces only the files that
hold changed rows (copy on write). Readers open the files of the newest version, so a run that
breaks off leaves nothing but files that no version names, and ``vacuum`` removes those.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .interim import kept


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".txt")) for n in _listed(spark, f"{path}/versions") if n.endswith(".txt"))


def files(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    """The data files of a version, the newest unless one is named, relative to ``path``."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{path} has no version {version or ''}".strip())
    text = spark.read.text(f"{path}/versions/{known[-1] if version is None else version}.txt", wholetext=True).first()["value"]
    return text.split()


def _commit(spark: SparkSession, path: str, number: int, names: Iterable[str]) -> None:
    """Make a version: written aside, then renamed; one that is there already is never replaced."""
    fs, final = _fs(spark, f"{path}/versions/{number}.txt")
    aside = _fs(spark, f"{path}/versions/_{uuid.uuid4().hex}")[1]
    out = fs.create(aside)
    out.write(bytearray("\n".join(sorted(names)).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise FileExistsError(f"version {number} of {path} was made meanwhile")


def _added(rows: DataFrame, path: str) -> list[str]:
    """Write rows as new files; their names relative to ``path``."""
    part = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{part}")
    return [f"{part}/{n}" for n in _listed(rows.sparkSession, f"{path}/{part}") if n.endswith(".parquet")]


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{n}" for n in files(spark, path, version)])


def append(rows: DataFrame, path: str) -> int:
    """Add rows, the first time too. Columns must be those that are there, in any order. Returns the version."""
    spark = rows.sparkSession
    known = versions(spark, path)
    before = files(spark, path) if known else []
    if known:
        there = read(spark, path)
        if dict(there.dtypes) != dict(rows.dtypes):
            raise ValueError(f"{path} has columns {dict(there.dtypes)}, not {dict(rows.dtypes)}")
        rows = rows.select(there.columns)
    number = (known[-1] if known else 0) + 1
    _commit(spark, path, number, [*before, *_added(rows, path)])
    return number


def rewrite(spark: SparkSession, path: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> tuple[int, list[str]]:
    """Replace the files that hold rows with one of ``keys`` (its columns are the key): (version, replaced files).

    ``change`` gets all rows of those files and gives what is to stand there instead. The scan that finds
    them reads the key columns only; which files they are is all that reaches the driver. Files
    without such rows are neither read whole nor written.
    """
    names = files(spark, path)
    key: Sequence[str] = keys.columns
    where = read(spark, path).select(*key, F.col("_metadata.file_path").alias("__file"))
    hit = {r["__file"] for r in where.join(keys.distinct(), list(key), "left_semi").select("__file").distinct().collect()}
    tails = {"/".join(h.rsplit("/", 3)[-3:]) for h in hit}  # data, folder, file
    replaced = [n for n in names if n in tails]
    if not replaced:
        return versions(spark, path)[-1], []
    old = spark.read.parquet(*[posixpath.join(path, n) for n in replaced])
    new = change(old)
    if new.columns != old.columns:
        raise ValueError("a rewrite must keep the columns")
    _commit(spark, path, versions(spark, path)[-1] + 1, [*(n for n in names if n not in set(replaced)), *_added(new, path)])
    return versions(spark, path)[-1], replaced


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove all but the last ``keep`` versions, and the files that none of those names. Returns the files."""
    known = versions(spark, path)
    alive = {n for v in known[-keep:] for n in files(spark, path, v)}
    gone = []
    for part in _listed(spark, f"{path}/data"):
        for name in _listed(spark, f"{path}/data/{part}"):
            if name.endswith(".parquet") and f"data/{part}/{name}" not in alive:
                fs, p = _fs(spark, f"{path}/data/{part}/{name}")
                fs.delete(p, False)
                gone.append(f"data/{part}/{name}")
    for v in known[:-keep]:
        fs, p = _fs(spark, f"{path}/versions/{v}.txt")
        fs.delete(p, False)
    return gone


def inject_into(spark: SparkSession, path: str, pk: str, cells: DataFrame, apply: Callable[[DataFrame, str, DataFrame], DataFrame]) -> tuple[int, list[str]]:
    """A rewrite that puts faults into the rows that ``cells`` name."""
    cells = kept(cells)
    return rewrite(spark, path, cells.select(pk), lambda rows: apply(rows, pk, cells))
