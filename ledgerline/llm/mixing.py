"""Mixing sources to target weights by temperature; DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, cut

STEPS = 40  # halvings of the exponent's interval
HALVINGS = 4  # of them that one aggregate serves
FEW = 10_000  # sources whose weights are broadcast; the weights of more are joined by source
BLOCKS = 16  # blocks of the mixed stream, each with the target weights
PASSES = 2.0  # how often a source may be repeated
CHUNK_ROWS = 20_000


def tokens(text="text"):
    """White-space separated words; at least one, so that empty texts are placed too."""
    words = F.size(F.filter(F.split(body(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return F.greatest(words, F.lit(1)).cast("long")


def hashed(*columns):
    """A hash in [0, 2**60) that SQL engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, n: the null source counts as the empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), tokens().alias("n"))


def measured(totals: DataFrame, points: Sequence[float]) -> list[tuple[float, float]]:
    """(entropy, most passes) of the weights that shares to each exponent of ``points`` give.

    Passes are those over the most repeated source when no source has less than one.
    ``totals`` has a row for each source with its share ``p``. One aggregate serves all points.
    """
    x = F.pow(F.col("p"), F.col("e"))
    every = totals.withColumn("e", F.explode(F.array(*map(F.lit, points))))
    rows = every.groupBy("e").agg(F.sum(x).alias("z"), F.sum(x * F.ln(x)).alias("xl"), F.max(x / F.col("p")).alias("hi"), F.min(x / F.col("p")).alias("lo")).collect()
    found = {r["e"]: (math.log(r["z"]) - r["xl"] / r["z"], r["hi"] / r["lo"]) for r in rows if r["z"]}
    return [found.get(e, (0.0, 1.0)) for e in points]


def exponent(totals: DataFrame, passes: float | None = PASSES, entropy: float | None = None, steps: int = STEPS) -> float:
    """The smallest exponent in [0, 1] whose weights meet the limits, by bisection.

    1 keeps the natural shares, 0 makes all sources equal. ``passes`` bounds the repetition of
    any source; ``entropy`` (nats) is what the weights' entropy need not exceed. Both fall as the
    exponent grows. The interval is halved four times by each aggregate over the table of sources.
    """
    low, width = 0.0, 1.0
    for step in range(0, steps, HALVINGS):
        n = 1 << min(HALVINGS, steps - step)
        points = [low + width * i / n for i in range(0 if not step else 1, n)]
        fits = [(passes is None or most <= passes + 1e-12) and (entropy is None or h <= entropy + 1e-12) for h, most in measured(totals, points)]
        if not step and fits[0]:
            return 0.0
        # The last point is known to meet the limits, or is 1.
        first = next((e for e, ok in zip(points, fits, strict=True) if ok), low + width)
        width /= n
        low = first - width
    return low + width


def mix(docs: DataFrame, passes: float | None = PASSES, entropy: float | None = None, budget: int | None = None, blocks: int = BLOCKS, seed: int = 0) -> DataFrame:
    """doc_id, source, pass, block, order_key, n_tokens: a row each time a document is taken.

    A source's weight is its token share to an exponent (see ``exponent``), normalised. The
    ``budget`` of tokens is dealt by weight; without one it is the smallest that takes every
    document at least once, so nothing is dropped. A source is gone through in passes, each a
    permutation of its own by a seeded hash, until its part of the budget is spent; the document
    that crosses the end is taken. Where in its part a document begins decides its block, so each
    block has the target weights; order_key orders a block. Running sums are taken within
    chunks of a source's permutation and joined by the chunks' totals, so no source is ever
    in one task. Null text counts as one token, the null source as the empty one; repeated
    rows are documents of their own. An empty table gives no rows.
    """
    rows = sized(docs)
    totals = cut(rows.groupBy("source").agg(F.sum("n").alias("t"), F.count("*").alias("k")))
    whole = totals.agg(F.sum("t").alias("t"), F.sum("k").alias("k"), F.count("*").alias("sources")).first()
    shares = totals.withColumn("p", F.col("t") / F.lit(float(whole["t"] or 1)))
    power = exponent(shares, passes, entropy)
    x = F.pow("p", F.lit(power))
    z = shares.agg(F.sum(x).alias("z"), F.max(F.col("t") / x).alias("least")).first()
    spend = float(budget) if budget is not None else (z["least"] or 0.0) * (z["z"] or 0.0)
    # A part that differs from whole passes by rounding only is whole passes.
    part = F.round(x / F.lit(z["z"] or 1.0) * F.lit(spend) / F.col("t"), 9)
    parts = cut(shares.select("source", "t", part.alias("rounds")))
    chunks = max(8, -(-(whole["k"] or 0) // CHUNK_ROWS))
    # Rows stay where they are where the sources are few; of very many none holds most rows.
    weighed = rows.join(F.broadcast(parts) if whole["sources"] <= FEW else parts, "source")
    taken = weighed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("rounds") - 1, F.lit(0)).cast("int")))).where(F.col("rounds") > 0)
    taken = taken.withColumn("h", hashed(F.lit(seed), "pass", "doc_id")).withColumn("chunk", F.floor(F.col("h") / F.lit(2.0**60) * chunks).cast("int"))
    sums = taken.groupBy("source", "pass", "chunk").agg(F.sum("n").alias("s"))
    before = Window.partitionBy("source", "pass").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "pass", "chunk", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "pass", "chunk").orderBy("h", "doc_id", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = taken.withColumn("run", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, ["source", "pass", "chunk"])
    at = F.col("pass") + (F.col("before") + F.col("run")) / F.col("t")
    placed = placed.withColumn("at", at).where(F.col("at") < F.col("rounds"))
    block = F.least(F.floor(F.col("at") / F.col("rounds") * blocks), F.lit(blocks - 1)).cast("int")
    return placed.select("doc_id", "source", "pass", block.alias("block"), hashed(F.lit(seed + 1), "h").alias("order_key"), F.col("n").alias("n_tokens"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as ``mix`` takes them."""
    times = mix(docs, **how).groupBy("doc_id", F.col("source").alias("__source")).agg(F.count("*").alias("__times"))
    copies = docs.groupBy(F.col("doc_id").cast("long").alias("__id"), F.coalesce("source", F.lit("")).alias("__source2")).agg(F.count("*").alias("__copies"))
    times = times.join(copies, (times["doc_id"].eqNullSafe(copies["__id"])) & (times["__source"] == copies["__source2"])).select("__id", "__source", F.ceil(F.col("__times") / F.col("__copies")).cast("int").alias("__n"))
    out = docs.join(times, docs["doc_id"].cast("long").eqNullSafe(times["__id"]) & (F.coalesce(docs["source"], F.lit("")) == times["__source"]))
    return out.withColumn("__n", F.explode(F.sequence(F.lit(1), "__n"))).select(docs.columns)


#: For the default limits the exponent has a closed form: the rarest source is taken PASSES
#: times as often as the largest.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source,
                  greatest(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')), 1) AS n FROM documents),
s AS (SELECT source, sum(n) AS t, sum(n) / (SELECT sum(n) FROM d) AS p FROM d GROUP BY source),
e AS (SELECT CASE WHEN max(p) <= {PASSES} * min(p) THEN 0.0 ELSE 1 - ln({PASSES}) / ln(max(p) / min(p)) END AS e FROM s),
x AS (SELECT source, t, pow(p, e) AS x FROM s, e),
r AS (SELECT source, t, round(x / (SELECT sum(x) FROM x) * ((SELECT max(t / x) FROM x) * (SELECT sum(x) FROM x)) / t, 9) AS rounds FROM x),
k AS (SELECT d.*, t, rounds, unnest(range(CAST(ceil(rounds) AS BIGINT))) AS pass FROM d JOIN r ON d.source = r.source),
h AS (SELECT *, CAST('0x' || substr(md5('0|' || pass || '|' || doc_id), 1, 15) AS BIGINT) AS h FROM k),
o AS (SELECT *, pass + coalesce(sum(n) OVER (PARTITION BY source, pass ORDER BY h, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / t AS begins FROM h)
SELECT doc_id, source, CAST(pass AS INTEGER) AS pass, CAST(least(floor(begins / rounds * {BLOCKS}), {BLOCKS - 1}) AS INTEGER) AS block,
       CAST('0x' || substr(md5('1|' || h), 1, 15) AS BIGINT) AS order_key, CAST(n AS BIGINT) AS n_tokens
FROM o WHERE begins < rounds
"""
