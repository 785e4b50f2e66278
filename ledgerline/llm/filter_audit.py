"""How five filters act on each other, in every order, from counts of which filters a text fails.

Which texts are copies is found by partition refinement: rows part by length in code points,
then by the hash of one block after the other, and rows that are alone in their class are
dropped at each step. What is left is compared as whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, cut, hot_join
from .words import segments, sliced

FILTERS = "ABCDE"
BLOCK = 256  # bytes of the first block; each later one is GROWTH times as long
GROWTH = 16

_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_MARK = bytes(b for b in range(256) if b not in b"#$%&*|")


def failures(raw: bytes, points: int) -> int:
    """Which of the filters A to D a text fails: bits 1, 2, 4 and 8."""
    words, distinct = 0, set()
    for piece in segments(raw):
        found = piece.split()
        words += len(found)
        distinct.update(found)
    upper = len(raw.translate(None, _NOT_UPPER))
    return (words < 200) | (100 * len(distinct) < 50 * words) << 1 | (100 * upper > 2 * points) << 2 | (len(raw.translate(None, _NOT_MARK)) > 0) << 3


def marks(raw: bytes, points: int) -> list[int]:
    """The names of a text's classes, one a step: its length, then the name before with one more block."""
    out, at, size = [points], 0, BLOCK
    while at < len(raw):
        out.append(xxhash.xxh3_64_intdigest(raw[at : at + size], seed=out[-1]))
        at, size = at + size, size * GROWTH
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``mask`` and ``marks`` to rows in place of their first column, the texts."""
    for part in sliced(batches, 0):
        mask, names = [], []
        for raw in part.column(0).to_pylist():
            points = len(raw.decode("utf-8", "replace"))
            mask.append(failures(raw, points))
            names.append(marks(raw, points))
        yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(mask, pa.int32()), pa.array(names, pa.list_(pa.int64()))], names=[*part.schema.names[1:], "mask", "marks"])


def features(rows: DataFrame, extra: str = "") -> DataFrame:
    """doc_id, part, whole, the columns of ``extra``, mask, marks of rows (text, doc_id, part, whole, ...)."""
    names = [c.split()[0] for c in extra.split(",") if c]
    return rows.select(F.col("text").cast("binary").alias("raw"), "doc_id", "part", "whole", *names).mapInArrow(_features, f"doc_id long, part string, whole long, {extra + ', ' if extra else ''}mask int, marks array<long>")


def refined(rows: DataFrame) -> DataFrame:
    """whole, k: the digests of the texts that share every class with another row, and how many rows have them.

    A step counts the classes that rows still in question have, by partial counts, and keeps the
    rows of classes of two or more (``hot_join``: a class may be that of most rows). A row is
    through once its blocks are used up.
    """
    alive, through, step = rows.select("whole", "marks"), [], 0
    while True:
        alive = alive.withColumn("c", F.col("marks")[step])
        total = alive.count()
        if not total:
            break
        shared = cut(alive.groupBy("c").agg(F.count("*").alias("k")).where(F.col("k") > 1))
        alive = cut(hot_join(alive, shared, "c", "k", total, "left_semi").select("whole", "marks"))
        through.append(alive.where(F.size("marks") == step + 1).select("whole"))
        alive = alive.where(F.size("marks") > step + 1)
        step += 1
    if not through:
        return rows.select("whole", F.lit(0).cast("long").alias("k")).limit(0)
    out = through[0]
    for x in through[1:]:
        out = out.unionByName(x)
    return out.groupBy("whole").agg(F.count("*").alias("k"))


def masks(docs: DataFrame, digest: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """doc_id, part, mask: which filters each row fails, the fifth as bit 16."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body("source").alias("part"), body("text").alias("text")).withColumn("whole", digest("text").cast("long"))
    found = cut(features(rows))
    total = found.count()
    again = cut(refined(found))
    # Whole texts are compared here: equal ones meet as one row a task.
    same = cut(hot_join(rows.select("whole", "doc_id", "text"), again, "whole", "k", total, "left_semi").groupBy("whole", "text").agg(F.min("doc_id").alias("keep"), F.count("*").alias("k")))
    each = cut(same.groupBy("whole").agg(F.count("*").alias("texts"), F.min("keep").alias("keep"), F.sum("k").alias("k")))
    # A digest that different texts share tells nothing; their rows are looked up by text.
    single = hot_join(found, each.select("whole", "keep", "texts", "k"), "whole", "k", total, "left").where("texts is null or texts = 1")
    several = each.where(F.col("texts") > 1).select("whole", "k")
    mixed = hot_join(rows, several, "whole", "k", total, "left_semi").join(same.select("whole", "text", "keep"), ["whole", "text"])
    every = single.select("doc_id", "part", "mask", "keep").unionByName(features(mixed, "keep long").select("doc_id", "part", "mask", "keep"))
    return every.select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("keep"), 16).otherwise(0)).alias("mask"))


def filter_interactions(docs: DataFrame, labels: DataFrame, digest: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """A row for each part, order of the five filters and step in it: what the step removes, and what of it others would.

    Rows become counts of (part, mask) before any order is looked at, 32 a part at most. A null
    text or source is empty. A row with null doc_id is never a copy of a smaller one nor smaller
    than another, and has no label; rows that repeat an id with one text are no copies of each
    other, so if theirs is the smallest id all stay. A document that ``labels`` names more than
    once has a flag if any of the rows has. Texts of any length count whole. An empty table gives
    no rows; other columns, of whatever name, are not looked at.
    """
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("bad"))
    rows = masks(docs, digest)
    named = rows.where(F.col("doc_id").isNotNull()).join(told, "doc_id", "left").select("part", "mask", "good", "bad")
    rows = named.unionByName(rows.where(F.col("doc_id").isNull()).select("part", "mask", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("bad")))
    counts = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    counts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("m"))
    steps = F.sequence(F.lit(1), F.lit(len(FILTERS)))
    orders = F.split(F.lit(" ".join("".join(x) for x in permutations(FILTERS))), " ")
    rows = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(steps))
    bit = lambda letter: f"shiftleft(1, ascii({letter}) - 65)"
    rows = rows.withColumn("own", F.expr(bit("substr(filter_order, step, 1)"))).withColumn("before", F.expr(f"aggregate(sequence(0, step - 1), 0, (a, i) -> if(i = 0, a, a | {bit('substr(filter_order, i, 1)')}))"))
    total = lambda when, what="x.n": F.expr(f"aggregate(m, 0L, (a, x) -> a + if({when}, {what}, 0L))")
    here = "(x.mask & own) > 0 and (x.mask & before) = 0"
    # Of the filters that a text fails each is the first one in an equal share of the orders.
    return rows.select(
        "part", "filter_order", "step",
        total("(x.mask & (own | before)) = 0").alias("kept"),
        total(here).alias("removed"),
        total("(x.mask & own) > 0 and (x.mask & before) > 0").alias("redundant"),
        total("x.mask = own").alias("unique_fails"),
        total(here, "x.good").alias("good_lost"),
        total(here, "x.bad").alias("toxic_lost"),
        total("(x.mask & own) > 0", f"x.n * ({len(list(permutations(FILTERS)))} div bit_count(x.mask))").alias("shapley"),
    )


ORACLE = r"""
    WITH t AS (SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, coalesce(l.good, 0) AS good, coalesce(l.bad, 0) AS bad
               FROM documents d LEFT JOIN (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
    f AS (SELECT part, good, bad, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
                 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
                 coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM w),
    m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL),
    l AS (SELECT i, substr('ABCDE', i + 1, 1) AS letter, CAST(pow(2, i) AS INT) AS bit FROM range(5) r(i)),
    o AS (SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
          FROM l p, l q, l r, l s, l t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
    x AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS own, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS before FROM o, range(1, 6) s(k)),
    y AS (SELECT m.*, x.*, (mask & own) > 0 AS fails, (mask & before) > 0 AS gone FROM m, x)
    SELECT part, filter_order, step, CAST(sum(n * CAST(NOT fails AND NOT gone AS INT)) AS BIGINT) AS kept,
           CAST(sum(n * CAST(fails AND NOT gone AS INT)) AS BIGINT) AS removed, CAST(sum(n * CAST(fails AND gone AS INT)) AS BIGINT) AS redundant,
           CAST(sum(n * CAST(mask = own AS INT)) AS BIGINT) AS unique_fails,
           CAST(sum(good * CAST(fails AND NOT gone AS INT)) AS BIGINT) AS good_lost, CAST(sum(bad * CAST(fails AND NOT gone AS INT)) AS BIGINT) AS toxic_lost,
           CAST(sum(CASE WHEN fails THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
    FROM y GROUP BY part, filter_order, step"""
