"""Line deduplication by overlapping three-line windows; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body, cut

LINES = 3


def lines(text="text"):
    return F.split(body(text), "\n", -1)


def windows(docs: DataFrame, width: int = LINES) -> DataFrame:
    """doc_id, pos (from 0), w: a hash of each run of ``width`` lines of each text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines().alias("ls")).where(F.size("ls") >= width)
    # Lists are zipped and not looked up line by line: work stays linear in the lines.
    joined = F.slice("ls", F.lit(1), F.size("ls") - width + 1)
    for k in range(1, width):
        joined = F.zip_with(joined, F.slice("ls", F.lit(k + 1), F.size("ls") - width + 1), lambda x, y: F.concat(x, F.lit("\n"), y))
    # 128 bits: two runs that differ meet by chance in no corpus.
    pairs = F.transform(joined, lambda x, i: F.struct(i.alias("pos"), F.md5(x).alias("w")))
    return rows.select("doc_id", F.explode(pairs).alias("x")).select("doc_id", "x.pos", F.unhex("x.w").alias("w"))


def repeats(docs: DataFrame, width: int = LINES) -> DataFrame:
    """doc_id, pos of every window that an earlier (doc_id, pos) has too."""
    found = windows(docs, width)
    first = found.groupBy("w").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).select("w", "first")
    return found.join(first, "w").where(F.struct("doc_id", "pos") != F.col("first")).select("doc_id", "pos")


def covered(docs: DataFrame, width: int = LINES) -> DataFrame:
    """doc_id, p: the first lines of its repeated windows, each once, in order."""
    return repeats(docs, width).groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("p"))


def kept_runs(p, n, width: int = LINES):
    """(start, count) of the runs of lines that no window starting at one of ``p`` covers, of ``n`` lines."""
    # Of repeated rows one may have fewer lines than another has windows: no run ends beyond n.
    after = F.transform(p, lambda x, i: F.struct((x + width).alias("s"), F.least(F.get(p, i + 1), n).alias("e")))
    runs = F.concat(F.array(F.struct(F.lit(0).alias("s"), F.least(F.get(p, F.lit(0)), n).alias("e"))), after)
    return F.transform(F.filter(runs, lambda r: r["e"] > r["s"]), lambda r: F.struct(r["s"].alias("s"), (r["e"] - r["s"]).alias("n")))


def deduplicated_lines(docs: DataFrame, width: int = LINES) -> DataFrame:
    """doc_id, text, n_lines, n_removed: one row per row of ``docs``, without repeated lines.

    Lines end at ``\\n``. Of equal runs of ``width`` lines the one with the smallest
    (doc_id, line) stays; the others go, and a line goes once any of its runs does. Texts of
    fewer lines stay as they are; a null text is an empty line. Rows with a null doc_id
    stay whole and make nothing repeat. Repeated rows of one doc_id lose the lines that any
    of them loses, and do not count against each other at the same line. Work grows with a
    text's lines and no faster. An empty table gives no rows; other columns, of whatever
    name, are not looked at.
    """
    rows = docs.where(F.col("doc_id").isNotNull())
    gone = cut(covered(rows, width))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines().alias("ls")).join(gone.withColumnRenamed("doc_id", "g"), F.col("doc_id") == F.col("g"), "left")
    size = F.size("ls")
    out = out.withColumn("runs", F.when(F.col("p").isNotNull(), kept_runs(F.col("p"), size, width)))
    left = F.flatten(F.transform("runs", lambda r: F.slice(F.col("ls"), r["s"] + 1, r["n"])))
    count = F.aggregate("runs", F.lit(0), lambda a, r: a + r["n"])
    text = F.when(F.col("p").isNull(), F.array_join("ls", "\n")).otherwise(F.array_join(left, "\n"))
    return out.select("doc_id", text.alias("text"), size.cast("long").alias("n_lines"), F.coalesce(size - count, F.lit(0)).cast("long").alias("n_removed"))


def line_digest(docs: DataFrame, width: int = LINES) -> DataFrame:
    """deduplicated_lines() with a digest in place of the text."""
    return deduplicated_lines(docs, width).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS pos FROM l WHERE len(ls) >= 3),
w AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS w FROM p),
f AS (SELECT w, min(struct_pack(d := doc_id, p := pos)) AS f, count(*) AS n FROM w GROUP BY w HAVING count(*) > 1),
r AS (SELECT DISTINCT w.doc_id, unnest([w.pos, w.pos + 1, w.pos + 2]) AS i FROM w JOIN f ON w.w = f.w WHERE struct_pack(d := w.doc_id, p := w.pos) <> f.f),
a AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM l),
k AS (SELECT a.doc_id, string_agg(a.ls[a.i + 1], chr(10) ORDER BY a.i) FILTER (WHERE r.i IS NULL) AS text, count(*) AS n, count(r.i) AS g
      FROM a LEFT JOIN r ON a.doc_id = r.doc_id AND a.i = r.i GROUP BY a.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(g AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM k
"""
