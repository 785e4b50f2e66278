"""How the sources of each language differ in their terms: sorted postings, scanned by runs.

Postings (lang, term, source, document) are dealt by (lang, term), sorted, and scanned run by
run for document frequencies and counts. The documents that a task reads are counted together
before they are dealt, so the postings of a term that every text has are as many as there are
tasks and sources, not documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, cut, hot_join, partitions
from .words import LETTER, segments, sliced

DOCUMENTS = 3  # that a term must be in to be kept in its language
TOP = 200  # ranks of terms that are reported
SCALE = 1_000_000_000
HELD = 200_000  # counts that a task holds before it emits them

#: Bytes of terms as they are, but A-Z in lower case; all others become a space. Digits separate terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if LETTER[b] and not 48 <= b <= 57 else 32 for b in range(256))
_POSTING = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("document", pa.int64()), ("docs", pa.int64()), ("n", pa.int64())])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, doc_id, raw) -> postings; one stands for some documents of its source, the first of which it names."""
    held: dict[tuple[str, str], tuple[Counter, Counter, list]] = {}

    def out():
        for (lang, source), (docs, n, first) in held.items():
            rows = pa.array([k.decode("utf-8", "replace") for k in n], pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), rows, pa.repeat(source, len(n)), pa.repeat(pa.scalar(first[0], pa.int64()), len(n)), pa.array([docs[k] for k in n], pa.int64()), pa.array(n.values(), pa.int64())], schema=_POSTING)
        held.clear()

    size = 0
    for part in sliced(batches, 3):
        for lang, source, key, raw in zip(*(c.to_pylist() for c in part.columns), strict=True):
            docs, n, first = held.setdefault((lang, source), (Counter(), Counter(), [key]))
            before, seen = len(n), set()
            for piece in segments(raw.translate(_TERM)):
                terms = piece.split()
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            if key is not None and (first[0] is None or key < first[0]):
                first[0] = key
            size += len(n) - before
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def _edges(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the row before in one of the columns."""
    new = np.ones(len(columns[0]), bool)
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        new[1:] &= np.asarray(pc.equal(c[1:], c[:-1]))
    new[1:] = ~new[1:]
    return np.flatnonzero(new)


def _scan(least: int):
    """Sorted postings -> lang, term, source, n, total of the terms that at least ``least`` documents have."""

    def summed(t: pa.Table) -> pa.Table:
        at = _edges(t["lang"], t["term"], t["source"])
        return pa.table({c: t[c].take(pa.array(at)) for c in ("lang", "term", "source")} | {c: np.add.reduceat(np.asarray(t[c]), at) for c in ("docs", "n")})

    def runs(t: pa.Table) -> pa.RecordBatch:
        at = _edges(t["lang"], t["term"])
        sizes = np.diff(np.append(at, t.num_rows))
        keep = np.repeat(np.add.reduceat(np.asarray(t["docs"]), at) >= least, sizes)
        total = np.repeat(np.add.reduceat(np.asarray(t["n"]), at), sizes)
        return t.append_column("total", pa.array(total)).select(["lang", "term", "source", "n", "total"]).filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # what has come of the last term, a row a source
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).select(["lang", "term", "source", "docs", "n"])
            t = summed(t if carry is None else pa.concat_tables([carry, t]))
            last = int(_edges(t["lang"], t["term"])[-1])
            carry = t.slice(last)
            if last:
                yield from runs(t.slice(0, last)).to_batches()
        if carry is not None:
            yield from runs(carry).to_batches()

    return run


def term_counts(docs: DataFrame, least: int = DOCUMENTS) -> DataFrame:
    """lang, term, source, n, total (of the language): a row for each kept term and source that has it."""
    rows = docs.select("lang", "source", "doc_id", F.col("text").cast("binary").alias("raw"))
    postings = rows.mapInArrow(_postings, "lang string, term string, source string, document long, docs long, n long")
    dealt = postings.repartition(partitions(docs.sparkSession), "lang", "term").sortWithinPartitions("lang", "term", "source", "document")
    return dealt.mapInArrow(_scan(least), "lang string, term string, source string, n long, total long")


def share(n, size):
    """One more than ``n`` + 1 in ``size``, in billionths, without rounding errors."""
    return (F.lit(1) + F.expr(f"(cast({n} as decimal(19,0)) + 1) * {SCALE} div cast({size} as decimal(19,0))")).cast("long")


def gap(p, q):
    """floor((p - q)^2 / q)."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def source_divergence(docs: DataFrame, least: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how a source of a language differs from each other one, and in which terms.

    Part ``pair`` sums over all kept terms of the language. Of two sources most terms have no
    count in either, so the sum is that of all terms as if neither had any, plus what a source's
    own terms change, plus what the terms of both change; only terms that are there are looked
    at. Part ``term`` has a source's ``top`` terms that are more frequent there than in the language.
    Null texts, languages and sources are empty, and each row is a document of its own, so
    repeated rows and null ids count as rows; very long texts go through in parts; ties go to
    the smaller item; an empty table gives no rows; other columns, of whatever name, are not
    looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body("lang").alias("lang"), body("source").alias("source"), body("text").alias("text"))
    found = cut(term_counts(docs, least))
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count("*").alias("terms"))
    whole = found.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.sum("total").alias("all"), F.count("*").alias("v"))
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["own", "terms", "all", "v"])
    size = F.col("own") + F.col("v")
    groups = groups.withColumn("size", size).withColumn("none", F.when(F.col("v") > 0, share("0", "greatest(size, 1)")).otherwise(1).cast("long"))
    groups = cut(groups.select("lang", "source", "v", "size", (F.col("all") + F.col("v")).alias("lang_size"), "none", "terms"))

    # A source may have most of the terms, so its rows stay where they are.
    named = groups.select(F.struct("lang", "source").alias("g"), "size", "lang_size", "none", "terms")
    counts = hot_join(found.withColumn("g", F.struct("lang", "source")), named, "g", "terms", found.count()).drop("g")
    terms = counts.select("lang", "source", "term", share("n", "size").alias("p"), share("total", "lang_size").alias("q")).where("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # As if no term had a count: a row for each pair, which the result has too.
    a, b = (groups.select("lang", F.col("source").alias(x), F.col("none").alias(f"{x}0"), *(["v"] if x == "a" else [])) for x in "ab")
    pairs = a.join(b, "lang").where("a <> b")
    base = pairs.select("lang", "a", "b", (F.col("v") * gap("a0", "b0")).alias("value"))
    # What the terms of one source change against every other one, by how often they are there.
    times = counts.groupBy("lang", F.col("source").alias("a"), "n", "size").agg(F.count("*").alias("k")).select("lang", "a", "k", share("n", "size").alias("p"))
    one = times.join(pairs.drop("v"), ["lang", "a"])
    ahead = one.select("lang", "a", "b", (F.col("k") * (gap("p", "b0") - gap("a0", "b0"))).alias("value"))
    behind = one.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), (F.col("k") * (gap("b0", "p") - gap("b0", "a0"))).alias("value"))
    # What a term changes that both have: a run's sources, pair by pair, summed in the task.
    run = counts.select("lang", "term", F.struct("source", share("n", "size").alias("p"), F.col("none").alias("p0")).alias("x")).groupBy("lang", "term").agg(F.collect_list("x").alias("xs")).where(F.size("xs") > 1)
    two = run.select("lang", F.explode("xs").alias("x"), "xs").select("lang", "x", F.explode("xs").alias("y")).where("x.source <> y.source")
    both = two.select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), (gap("x.p", "y.p") - gap("x.p", "y.p0") - gap("x.p0", "y.p") + gap("x.p0", "y.p0")).alias("value"))
    each = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    sums = base.unionByName(ahead).unionByName(behind).unionByName(both).groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))
    sums = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(each))
    return sums.unionByName(terms)


ORACLE = r"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
    v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
    c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
    g AS (SELECT DISTINCT lang, source FROM d),
    full_ AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    s AS (SELECT lang, source, sum(n) AS n FROM full_ GROUP BY lang, source),
    p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (CAST(1000000000 AS HUGEINT) * (f.n + 1)) // CAST(s.n + v.v AS HUGEINT) AS p,
                 1 + (CAST(1000000000 AS HUGEINT) * (f.total + 1)) // CAST(v.n + v.v AS HUGEINT) AS q
          FROM full_ f JOIN s USING (lang, source) JOIN v ON v.lang = f.lang),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    out AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM out)
    SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200"""
