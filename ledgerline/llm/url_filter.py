"""URL filtering: host and path rules, and a ratio of two character language models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ORDERS = 6  # contexts of 0 to 5 characters
CHUNK = 2048  # rows that are scored together
WEIGHT = 2.0  # of the next shorter context
BINS = 2001  # of the score histogram from -10 to 10 that calibrates the threshold

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rest (all after ``://``); null or no ``://``: all three empty."""
    at = F.instr(F.col("url"), "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(rest, F.lit("")).alias("rest"))
    host = F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return rows.select("page_id", host.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"), "rest")


def ruled(rows: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds ``rule`` (host and path of the longest rule that fits, else null) and ``decided``."""
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        decided = F.when(fits, F.lit(verdict)).otherwise(decided)
    return rows.withColumn("rule", rule).withColumn("decided", decided)


def windows(urls: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the five before it as one number of 48 bits, and the byte's URL.

    The number is the n-gram itself and not a hash. A URL's start is padded with zero bytes.
    """
    pad = ORDERS - 1
    raw = [u.encode() for u in urls]
    sizes = np.array([len(r) for r in raw], np.int64)
    a = np.frombuffer(b"".join(b"\0" * pad + r for r in raw), np.uint8).astype(np.int64)
    at = np.arange(int(sizes.sum())) + np.repeat(np.cumsum(sizes + pad) - np.cumsum(sizes), sizes)
    keys = np.zeros(len(at), np.int64)
    for k in range(ORDERS):
        keys |= a[at - k] << (8 * k)
    return keys, np.repeat(np.arange(len(raw)), sizes)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct windows of each chunk and how often its accepted and rejected examples hold them."""
    for b in batches:
        chunk, side, urls = np.asarray(b.column(0)), np.asarray(b.column(1)), b.column(2).to_pylist()
        for i, j in pairwise([0, *(np.flatnonzero(np.diff(chunk)) + 1), len(urls)]):
            keys, who = windows(urls[i:j])
            found, at = np.unique(keys, return_inverse=True)
            sides = side[i:j][who]
            allow, block = (np.bincount(at[sides == x], minlength=len(found)) for x in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(chunk[i:j][:1], len(found))), pa.array(found), pa.array(allow), pa.array(block)], names=["chunk", "gram", "allow", "block"])


def ratios(counts: DataFrame) -> DataFrame:
    """gram, ratio: ln P(char | rejected) - ln P(char | accepted) of each window of ``counts``.

    ``counts``: gram, allow, block, one row a window. Shorter n-grams are its ends, so their
    counts are sums of its rows. An n-gram has at most 256 extensions: no join has a hot key.
    Only tables of at most two bytes' n-grams are broadcast by hint.
    """
    orders = [cut(counts)]
    for k in range(ORDERS - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        orders.append(cut(orders[-1].groupBy(shorter.alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))))
    known = None
    for k, now in enumerate(reversed(orders)):
        small = F.broadcast if k <= 2 else lambda x: x
        now = now.withColumn("context", F.shiftright("gram", 8))
        context = now.groupBy("context").agg(F.sum("allow").alias("allows"), F.sum("block").alias("blocks"))
        rows = now.join(small(context), "context")
        if known is None:
            rows = rows.withColumn("pa", F.lit(1 / 256)).withColumn("pb", F.lit(1 / 256))
        else:
            rows = rows.withColumn("end", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(small(known.withColumnRenamed("gram", "end")), "end")
        p = lambda n, total, before: (F.col(n) + F.col(before) * WEIGHT) / (F.col(total) + WEIGHT)
        known = rows.select("gram", p("allow", "allows", "pa").alias("pa"), p("block", "blocks", "pb").alias("pb"))
    return known.select("gram", (F.log("pb") - F.log("pa")).alias("ratio"))


def _score(pages: pa.Table, known: pa.Table) -> pa.Table:
    """The pages of one chunk with the mean ratio of their windows."""
    urls = pages["rest"].to_pylist()
    keys, who = windows(urls)
    grams_, order = np.asarray(known["gram"]), np.argsort(np.asarray(known["gram"]))
    ratio = np.asarray(known["ratio"])[order][np.searchsorted(grams_[order], keys)]
    n = np.bincount(who, minlength=len(urls))
    score = np.bincount(who, ratio, minlength=len(urls)) / np.maximum(n, 1)
    return pages.select(["page_id", "host", "path", "rule", "decided", "held"]).append_column("score", pa.array(score))


def threshold(histogram: list[tuple[int, int, int]]) -> float:
    """The cut of (bin, accepted, rejected) with the best mean of both sides' rates.

    0 where the held-out URLs lack a side. Ties go to the cut nearest 0.
    """
    accepted, rejected = np.zeros(BINS), np.zeros(BINS)
    for at, a, r in histogram:
        accepted[at], rejected[at] = a, r
    if not accepted.sum() or not rejected.sum():
        return 0.0
    right = np.cumsum(accepted) / accepted.sum() + 1 - np.cumsum(rejected) / rejected.sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    edges = (best + 0.5) / (BINS - 1) * 20 - 10
    return float(edges[np.argmin(np.abs(edges))])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of ``pages``.

    The rules' own URLs are the accepted and rejected examples: four fifths (by a hash of the
    URL) are counted, one fifth calibrates the threshold. Other URLs are blocked where the
    score lies above it. A null URL, one without ``://`` and an empty one score 0 and are
    allowed unless the threshold is below 0. Without examples every score is 0 and such URLs
    are allowed. Repeated rows are judged each for itself; other columns are not looked at.
    All n-grams are counted exactly, in tables that grow with the input. URLs are scored in
    chunks of at most ``CHUNK`` rows: a chunk's distinct windows are joined to their ratios, so
    a window that all URLs hold is one row a chunk. Only the score histogram reaches the driver.
    """
    held = F.pmod(F.xxhash64("rest"), F.lit(5)) == 0
    rows = cut(ruled(parsed(pages), rules).withColumn("held", held).withColumn("chunk", F.floor(F.monotonically_increasing_id() / CHUNK)))
    side = F.when(~F.col("held") & (F.col("decided") == "allow"), 0).when(~F.col("held") & (F.col("decided") == "block"), 1).otherwise(-1)
    gathered = cut(rows.select("chunk", side.alias("side"), "rest").mapInArrow(_gather, "chunk long, gram long, allow long, block long"))
    found = ratios(gathered.groupBy("gram").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    known = gathered.select("chunk", "gram").join(found, "gram")
    scored = cut(rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_score, "page_id long, host string, path string, rule string, decided string, held boolean, score double"))
    at = F.least(F.greatest(F.floor((F.col("score") + 10) / 20 * (BINS - 1) + 0.5), F.lit(0)), F.lit(BINS - 1))
    histogram = scored.where(F.col("held") & F.col("decided").isNotNull()).groupBy(at.alias("at")).agg(F.count_if(F.col("decided") == "allow").alias("a"), F.count_if(F.col("decided") == "block").alias("r")).collect()
    cut_at = threshold([(r["at"], r["a"], r["r"]) for r in histogram])
    verdict = F.coalesce("decided", F.when(F.col("score") > cut_at, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
