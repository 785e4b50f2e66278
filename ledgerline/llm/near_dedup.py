"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, in bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, cut, small_batches, tidy
from .exact_dedup import keepers
from .words import SPACE, Block, blocks, mix

WORDS = 5
SIMILARITY = 0.8
SAMPLES, ROWS, BANDS = 30, 3, 15  # a pair of similarity 0.8 meets in no band once in 5,000 times
LIKE = 15  # equal samples that a pair to compare has; at similarity 0.8 it has fewer once in 20,000 times
FINE = 256  # more samples, for texts of buckets that hold several classes still
#: Equal ones of these of the pairs that each pass compares, the likeliest first: what they join
#: need not be compared later. At similarity 0.8 a pair has fewer than the last once in 40,000 times.
FINE_LIKE = (205, 178)
PART = 400_000  # shingles that one group looks through for those of one class only
FREQUENT = 0.01  # shingles in fewer documents than this share weigh as those in just so many
COUNTED = 500_000  # shingles that a task counts before it forgets the rare ones
CANDIDATES = 2_000_000  # hashes of shingles that one counting pass looks for
CACHED = 1 << 18  # bytes of text whose shingles stay in a core's cache

_M = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64)) for j in range(WORDS)]
_RNG = np.random.default_rng(20)
_GAMMA = _RNG.gamma(2, 1, 1 << 16).astype(np.float32)
_LOG_GAMMA = np.log(_RNG.gamma(2, 1, 1 << 16)).astype(np.float32)
_SEEDS = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_FINE_SEEDS = np.random.default_rng(21).integers(0, 1 << 63, FINE, dtype=np.uint64)
#: Samples of each band: all samples once, then half of them in another order.
_BAND = np.concatenate([_RNG.permutation(SAMPLES), _RNG.permutation(SAMPLES)])[: BANDS * ROWS].reshape(BANDS, ROWS)


def shingles(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of five words; a shorter text is one shingle."""
    n = np.where(b.words > 0, np.maximum(b.words - WORDS + 1, 1), 0)
    first = np.cumsum(b.words) - b.words
    doc = np.repeat(np.arange(b.n), n)
    at = np.arange(len(doc)) - (np.cumsum(n) - n)[doc] + first[doc]
    end = (first + b.words)[doc]
    w = b.hashes(b.start, b.end)
    out = np.zeros(len(doc), np.uint64)
    for j in range(WORDS):
        k = at + j
        out += np.where(k < end, w[np.minimum(k, len(w) - 1)] * _M[j], np.uint64(0)) if len(w) else np.uint64(0)
    return doc, mix(out)


def counted(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times) of each text's distinct shingles, by text and hash."""
    doc, h = shingles(b)
    order = np.argsort(h)
    # Texts of a block are few: a stable sort of 16-bit numbers is a radix sort.
    order = order[np.argsort(doc[order].astype(np.uint16 if b.n < 1 << 16 else np.int64), kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def weights(h: np.ndarray, times: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Term frequency times inverse document frequency."""
    known, idf = model
    w = np.full(len(h), 1 - np.log(FREQUENT))
    if len(known) and len(h):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        w = np.where(known[at] == h, idf[at], w)
    return w * times


def samples(doc: np.ndarray, h: np.ndarray, w: np.ndarray, seeds: np.ndarray = _SEEDS) -> tuple[np.ndarray, np.ndarray]:
    """Improved consistent weighted sampling: (texts, a sample id of each for each seed).

    Two texts have the same sample with the probability of their weighted similarity.
    """
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, int)
    which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
    log_w = np.log(w).astype(np.float32)
    out = np.zeros((len(first), len(seeds)), np.uint64)
    for k in range(len(seeds) if len(h) else 0):
        z = (h ^ seeds[k]) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(31)
        z *= np.uint64(0xD6E8FEB86659FD93)
        part = z.view(np.uint16).reshape(-1, 4)  # draws of gamma(2, 1), its logarithm, uniform
        r = _GAMMA[part[:, 1]]
        beta = part[:, 2] * np.float32(2.0**-16)
        t = log_w / r
        t += beta
        np.floor(t, out=t)
        a = _LOG_GAMMA[part[:, 3]] - r * (t - beta + np.float32(1))
        hit = np.flatnonzero(a == np.minimum.reduceat(a, first)[which])
        hit = hit[np.concatenate([[True], which[hit[1:]] != which[hit[:-1]]])]
        out[:, k] = mix(h[hit] ^ (t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    return doc[first], out


def bands(sample: np.ndarray) -> np.ndarray:
    """A key for each band of each text."""
    key = np.zeros((len(sample), BANDS), np.uint64)
    for j in range(ROWS):
        key = mix(key + sample[:, _BAND[:, j]] + np.uint64(j + 1))
    return mix(key + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def packed_bytes(sample: np.ndarray) -> np.ndarray:
    """The low bytes of each text's samples, seven to a number; what is over is zero."""
    low = (sample & np.uint64(0xFF)).astype(np.int64)
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % 7)))
    return (low.reshape(len(low), -1, 7) << (8 * np.arange(7))).sum(axis=2)


def equal_bytes(x: Column, y: Column) -> Column:
    """How many of seven packed bytes are equal: those that have no bit of x xor y."""
    v = x.bitwiseXOR(y)
    low, high = F.lit(0x7F7F7F7F7F7F7F), F.lit(0x80808080808080)
    return F.lit(7) - F.bit_count((v.bitwiseAND(low) + low).bitwiseOR(v).bitwiseAND(high))


def equal_samples(x: str, y: str, count: int) -> Column:
    """How many of ``count`` samples, packed by ``packed_bytes``, are equal. Chance makes a few more so, never fewer."""
    words = -(-count // 7)
    return sum((equal_bytes(F.col(x)[i], F.col(y)[i]) for i in range(words)), F.lit(count - 7 * words))


def _local(share: float, held_most: int = COUNTED):
    """The shingles that at least ``share`` of a partition's texts may have, by lossy counting.

    Every ``held_most`` shingles those are forgotten that even with all times that may have been
    missed before they were first counted do not come to ``share`` of the texts so far. What is
    held follows the shingles of some 1 / share texts and not the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = docs_before = 0
        kept, times, missed = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0)

        def settled(held: list[np.ndarray]):
            new, n = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            at = np.searchsorted(kept, new)
            old = np.zeros(len(new), bool)
            old[at < len(kept)] = kept[at[at < len(kept)]] == new[at < len(kept)]
            times[at[old]] += n[old]
            h = np.concatenate([kept, new[~old]])
            t = np.concatenate([times, n[~old]])
            m = np.concatenate([missed, np.full(len(h) - len(kept), share * docs_before)])
            stay = np.flatnonzero(t + m >= share * docs - 1e-6)
            stay = stay[np.argsort(h[stay])]
            return h[stay], t[stay], m[stay]

        held, size = [], 0
        for batch in batches:
            for _, b in blocks(batch.column("text"), ~SPACE):
                h = shingles(b)[1]  # times, not texts: at least as many
                docs += b.n
                held.append(h)
                size += len(h)
                if size > held_most:
                    kept, times, missed = settled(held)
                    docs_before, held, size = docs, [], 0
        h = settled(held)[0]
        for i in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64))], names=["h"])

    return run


def _global(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        n = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, b in blocks(batch.column("text"), ~SPACE):
                doc, h = shingles(b)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                found = np.flatnonzero(known[at] == h)
                once = np.unique(doc[found] * len(known) + at[found])
                n += np.bincount(once % len(known), minlength=len(known))
        at = np.flatnonzero(n)
        for i in range(0, len(at), 100_000):
            k = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(known[k].view(np.int64)), pa.array(n[k])], names=["h", "n"])

    return run


def frequencies(texts: DataFrame, share: float = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies, 1 + ln(documents / those with it), of the shingles in at least ``share`` of all documents.

    Such a shingle is as frequent in some partition, so the first pass names candidates and
    the second counts them over all documents, some millions at a time. The result has at
    most (shingles a document) / share entries, however many documents there are.
    """
    spark = texts.sparkSession
    total = texts.count()
    named = cut(texts.mapInArrow(_local(share), "h long").distinct()) if total else None
    passes = -(-named.count() // CANDIDATES) if total else 0
    hashes, counts = [], []
    for i in range(passes):
        part = named.where(F.pmod("h", F.lit(passes)) == i).toArrow().column("h")
        known = np.sort(np.asarray(part).astype(np.int64).view(np.uint64))
        if not len(known):
            continue
        shared = spark.sparkContext.broadcast(known)
        found = texts.mapInArrow(_global(shared), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= share * total).toArrow()
        hashes.append(np.asarray(found.column("h")).astype(np.int64).view(np.uint64))
        counts.append(np.asarray(found.column("n")))
    h = np.concatenate([np.empty(0, np.uint64), *hashes])
    n = np.concatenate([np.empty(0), *counts])
    order = np.argsort(h)
    return h[order], 1 + np.log(total / n[order])


def _sign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids = batch.column("node"), batch.column("doc_id")
            for which, b in blocks(batch.column("text"), ~SPACE, CACHED):
                doc, h, times = counted(b)
                w = weights(h, times, shared.value)
                who, sample = samples(doc, h, w)
                n, full = b.n, np.zeros((b.n, SAMPLES), np.uint64)
                full[who] = sample
                sizes = np.bincount(doc, w, minlength=n)
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.isin(np.arange(n), who) * BANDS)]), pa.int32()), pa.array(bands(sample).view(np.int64).ravel()))
                low = packed_bytes(full)
                yield pa.RecordBatch.from_arrays([ids.slice(which.start, n), nodes.slice(which.start, n), pa.array(sizes), keys, pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * low.shape[1], pa.int32()), pa.array(low.ravel()))], names=["doc_id", "node", "size", "bands", "sample"])

    return run


def _pack(shared):
    """A text's distinct shingles and their weights, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            for which, b in blocks(batch.column("text"), ~SPACE):
                doc, h, times = counted(b)
                w = weights(h, times, shared.value).astype(np.float32)
                cuts = np.searchsorted(doc, np.arange(b.n + 1))
                own = nodes[which]
                for i in range(0, b.n, 100):
                    k = range(i, min(i + 100, b.n))
                    yield pa.RecordBatch.from_arrays([pa.array([own[j] for j in k], pa.binary()), pa.array([h[cuts[j] : cuts[j + 1]].tobytes() for j in k], pa.binary()), pa.array([w[cuts[j] : cuts[j + 1]].tobytes() for j in k], pa.binary())], names=["node", "h", "w"])

    return run


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FINE samples of each text, eight bits of each: chance makes a few more equal, never fewer."""
    for whole in batches:
        for i in range(0, whole.num_rows, 50):
            batch = whole.slice(i, 50)
            hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("h")]
            w = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in batch.column("w")])
            _, found = samples(np.repeat(np.arange(len(hashes)), [len(x) for x in hashes]), np.concatenate(hashes), w, _FINE_SEEDS)
            low = packed_bytes(found)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * low.shape[1], pa.int32()), pa.array(low.ravel()))], names=["node", "fine"])


def weighted_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Sum of smaller weights over sum of larger ones; ha and hb are sorted."""
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    same = hb[at] == ha
    both = float(np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64))
    return both / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - both)


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            ok = []
            for ha, wa, hb, wb in zip(*(batch.column(c) for c in ("ha", "wa", "hb", "wb")), strict=True):
                one, two = (np.frombuffer(x.as_buffer(), np.uint64) for x in (ha, hb))
                ok.append(weighted_jaccard(one, np.frombuffer(wa.as_buffer(), np.float32), two, np.frombuffer(wb.as_buffer(), np.float32)) >= similarity)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return run


def _deal(parts: int):
    """Shingles by part of the hash range, packed: each row has some texts' shingles of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("h")]
                h = np.concatenate(hashes)
                w = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in batch.column("w")])
                own = np.repeat(np.arange(len(hashes), dtype=np.uint16), [len(x) for x in hashes])
                part = (h % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part)
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                low = (h // np.uint64(parts)).astype(np.uint32)[order]
                full = np.flatnonzero(np.diff(cuts))
                ids, labels = (np.asarray(batch.column(c)).tobytes() for c in ("id", "label"))
                packed = lambda x: pa.array([x[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary())  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays([pa.array(full), packed(low), packed(own[order]), packed(w[order]), pa.array([ids] * len(full), pa.binary()), pa.array([labels] * len(full), pa.binary())], names=["part", "h", "own", "w", "ids", "labels"])

    return run


def _alone(table: pa.Table) -> pa.Table:
    """id, alone: the weight of a text's shingles that only its own class has."""
    rows = {c: [x.as_py() for x in table.column(c)] for c in ("h", "own", "w", "ids", "labels")}
    h = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["h"]])
    w = np.concatenate([np.frombuffer(x, np.float32) for x in rows["w"]]).astype(np.float64)
    own = [np.frombuffer(x, np.uint16) for x in rows["own"]]
    ids, labels = (np.concatenate([np.frombuffer(t, np.int64)[o] for t, o in zip(rows[c], own, strict=True)]) for c in ("ids", "labels"))
    order = np.lexsort((labels, h))
    h, w, ids, labels = h[order], w[order], ids[order], labels[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.append(first[1:], len(h)) - 1
    one = np.repeat(labels[first] == labels[last], last - first + 1)
    found, at = np.unique(ids[one], return_inverse=True)
    return pa.table({"id": pa.array(found, pa.int64()), "alone": pa.array(np.bincount(at, w[one], minlength=len(found)), pa.float64())})


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of every node with an edge.

    Labels spread to neighbours and then jump along themselves until none changes; each
    round's table is written, and no group is gathered.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    now = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    none = F.lit(None).cast("binary")
    while True:
        heard = both.join(now, both["b"] == now["node"]).select(F.col("a").alias("node"), "label", none.alias("was"))
        step = heard.union(now.select("node", "label", F.col("label").alias("was"))).groupBy("node").agg(F.min("label").alias("label"), F.min("was").alias("was"))
        up = now.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = cut(step.join(up, "label", "left").select("node", "was", F.coalesce(F.least("label", "up"), "label").alias("label")))
        changed = step.where(F.col("label") < F.col("was")).limit(1).count()
        now = step.select("node", "label")
        if not changed:
            tidy(edges.sparkSession)
            return now


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, class_size: one row per row of ``docs``.

    A class is a connected component of documents whose weighted Jaccard similarity over
    TF-IDF shingles of five words is at least ``similarity``; its id is its smallest doc_id.
    Texts are lower-cased and split at white space; a text of fewer words is one shingle, and
    texts without words are classes of their own, equal ones together. Equal texts are joined
    first, so copies of one text are one node. In each band's bucket every node is compared
    with the one that meets most others. Only where a bucket then still holds several
    classes, nodes of different classes are compared with each other, if what they share with
    other classes at all, and their samples, allow the similarity; nodes that are in one
    class already need no more links. Null texts are
    empty; rows with a null doc_id belong to a class but never name it. Repeated rows are
    rows of one class. An empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        signed, named = classed_nodes(docs, similarity)
    ids = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    of_node = named.join(ids, "label").select("node", "class_id", "class_size")
    return signed.select("doc_id", "node").join(of_node, "node").select("doc_id", "class_id", "class_size")


def node_of(text):
    """What equal texts share, from the lower-cased text."""
    return F.unhex(F.md5(F.regexp_replace(F.trim(text), r"[\x20\x09-\x0D]+", " ")))


def classed_nodes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, ... of each row; node, its smallest doc_id, its rows n and its class's label)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(body()).alias("text")).withColumn("node", node_of("text"))
    model = spark.sparkContext.broadcast(frequencies(rows.select("text")))
    signed = cut(rows.mapInArrow(_sign(model), "doc_id long, node binary, size double, bands array<long>, sample array<long>"))
    nodes = cut(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("size", "bands", "sample")).alias("x"), F.count("*").alias("n")).select("node", "doc_id", "x.size", "x.bands", "x.sample", "n"))
    members = nodes.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    members = cut(members.join(buckets, "key"))
    # The text that meets most others is likeliest what they are copies of.
    score = members.groupBy("node").agg(F.sum("m").alias("score"))
    centers = members.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("c")).select("key", F.col("c.node").alias("center"))

    wanted = members.select("node").distinct().join(nodes.select("node", F.col("doc_id").alias("id")), "node")
    source = rows.join(wanted, (rows["doc_id"].eqNullSafe(wanted["id"])) & (rows["node"] == wanted["node"])).select(rows["node"], "text")
    sets = cut(source.mapInArrow(_pack(model), "node binary, h binary, w binary").dropDuplicates(["node"]))

    def linked(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("node").alias("a"), F.col("h").alias("ha"), F.col("w").alias("wa"))
        two = sets.select(F.col("node").alias("b"), F.col("h").alias("hb"), F.col("w").alias("wb"))
        return cut(pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(_verify(similarity), "a binary, b binary"))

    star = members.join(centers, "key").where(F.col("node") != F.col("center"))
    labels = components(linked(star.select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()))

    # What the comparisons with the centers have not joined: classes that share a bucket.
    classed = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    split = classed.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where(F.col("l1") != F.col("l2")).select("key")
    open_ = cut(classed.join(split, "key", "left_semi"))
    # A text of which too much is its own class's only can be like no text of another class:
    # what two share is at most what either shares with other classes at all. (Ids and labels are
    # 64-bit hashes here: two that meet by chance would need a corpus of some 10**9 such texts.)
    told = sets.join(open_.select("node", F.xxhash64("label").alias("label")).distinct(), "node").withColumn("id", F.xxhash64("node"))
    total = told.agg(F.sum(F.octet_length("h") / 8)).first()[0] or 0
    parts = max(16, int(-(-total // PART)))
    alone = told.select("id", "label", "h", "w").mapInArrow(_deal(parts), "part long, h binary, own binary, w binary, ids binary, labels binary").groupBy("part").applyInArrow(_alone, "id long, alone double").groupBy("id").agg(F.sum("alone").alias("alone"))
    known = nodes.select("node", "size", "sample", "bands").withColumn("id", F.xxhash64("node"))
    free = open_.select("node").distinct().join(known, "node").join(alone, "id", "left").withColumn("shared", F.col("size") - F.coalesce("alone", F.lit(0.0)))
    slack = 1 - 1e-3
    tidy(spark)
    free = cut(free.where(F.col("shared") >= F.col("size") * (similarity * slack)).drop("id", "alone"))
    free = cut(free.join(sets.join(free.select("node"), "node").mapInArrow(_fine, "node binary, fine array<long>"), "node"))
    part = similarity / (1 + similarity) * slack
    most = FINE
    for least in FINE_LIKE:
        now = open_.select("key", "node").join(free, "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        a, b = (now.select(F.col("key").alias(f"key_{x}"), F.col("node").alias(x), F.col("label").alias(f"l{x}"), F.col("size").alias(f"s{x}"), F.col("shared").alias(f"v{x}"), F.col("sample").alias(f"p{x}"), F.col("fine").alias(f"f{x}"), F.col("bands").alias(f"k{x}")) for x in "ab")
        # Many numbers are folded, as an expression for each would be too much code for the compiler.
        alike = F.aggregate(F.zip_with("fa", "fb", equal_bytes), F.lit(FINE - 7 * -(-FINE // 7)), lambda s, x: s + x)
        needed = (F.col("sa") + F.col("sb")) * part
        fits = (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (F.least("va", "vb") >= needed) & (equal_samples("pa", "pb", SAMPLES) >= LIKE)
        # From least to most in one comparison: an expression that stands twice is computed for every pair, before the cheaper ones are asked.
        fits = fits & (F.abs(2 * alike - (least + most)) <= most - least)
        # Two that share several buckets meet in the first only.
        once = F.array_min(F.array_intersect("ka", "kb")) == F.col("key_a")
        more = linked(a.join(b, (F.col("key_a") == F.col("key_b")) & fits & once).select("a", "b"))
        most = least - 1
        tidy(spark)
        if not more.limit(1).count():
            continue
        # The classes as nodes: those that the new links join.
        joined = more.join(labels.withColumnsRenamed({"node": "a", "label": "la"}), "a", "left").join(labels.withColumnsRenamed({"node": "b", "label": "lb"}), "b", "left")
        joined = components(joined.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct())
        of = joined.withColumnsRenamed({"node": "was", "label": "now"})
        every = members.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("was"))
        labels = cut(every.join(of, "was", "left").select("node", F.coalesce("now", "was").alias("label")))

    named = nodes.select("node", "doc_id", "n").join(labels, "node", "left").select("node", "doc_id", "n", F.coalesce("label", "node").alias("label"))
    return signed, named


def distinct_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that name their class, with all their columns.

    Rows are told apart by doc_id and text, so an id with two texts loses the near copy only.
    Of a class without ids one row stays.
    """
    with small_batches(docs.sparkSession):
        named = classed_nodes(docs, similarity)[1]
    first = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("x"))
    found = cut(first.select(F.col("x.node").alias("__node"), F.col("x.doc_id").alias("__keep")))
    rows = docs.withColumn("__node", node_of(F.lower(body())))
    return keepers(rows, found, ["__node"]).drop("__node")
