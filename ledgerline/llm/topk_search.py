"""Exact top-k inner-product search as a Voronoi kNN join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PIVOTS = 32
BLOCK = 8_192  # data rows, and queries, that one local join holds at most, about
WIDE = 0.5  # share of all rows that a query group wants at least where groups are merged
SLACK = 1e-6  # relative, for rounding of distances


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (array of long): floor(scale * x); rows with a null or non-finite part go."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _packed(m: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in m]


def _unpacked(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int64 if len(column) and len(column.iloc[0]) == 8 * dim else np.int32).reshape(-1, dim)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows of a and rows of b."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _lifted(v: np.ndarray, top: float, data: bool) -> np.ndarray:
    """One more coordinate, so that the nearest row has the largest inner product."""
    x = v.astype(np.float64)
    rest = np.sqrt(np.maximum(top - (x * x).sum(1), 0)) if data else np.zeros(len(x))
    return np.column_stack([x, rest])


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products; exact in floats where every sum stays below 2**53."""
    return (q.astype(d.dtype) @ d.T).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def search(vectors: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS, block: int = BLOCK, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows for each row with vec_id % every = 0.

    Inner products become distances by one more coordinate. Data and queries go to the nearest
    of a few pivots. Summaries by group (counts, ranges of distances to each pivot, the k + 1
    smallest of them, of different ids) bound how far a group's answers can lie, and a data row
    is copied only to the query groups within whose bound it can be. Query groups that would
    need most rows each become one, so a row goes there once. Groups of copies and of queries
    are dealt out in blocks; each pair of blocks is solved by itself and the answers are merged.
    Vectors that are null or hold nulls or non-finite parts take no part; shorter ones count as
    filled up with zeros. Rows with equal vec_id are rows of their own, but none is a candidate
    for a query of its id; of equal scores the smaller vec_id comes first. An empty table gives
    no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = cut(usable(vectors, scale))
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)
    size = F.array_max(F.transform("v", lambda e: F.abs(e)))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("top"), F.max(size).alias("most")).first()
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    dim, top = max(facts["dim"], 1), facts["top"]
    exact = float(facts["most"] or 0) ** 2 * dim < 2**52
    kind = np.int32 if (facts["most"] or 0) < 2**31 else np.int64
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()
    p = _lifted(_matrix([r["v"] for r in chosen], dim), top, True)
    n = len(p)
    is_query = F.pmod("vec_id", F.lit(every)) == 0

    def assign(frames):
        for f in frames:
            m = _matrix(f["v"], dim)
            far = _far(_lifted(m, top, True), p)
            yield pd.DataFrame({"vec_id": f["vec_id"], "v": _packed(m.astype(kind)), "home": far.argmin(1), "d": far.min(1)})

    def assign_queries(frames):
        for f in frames:
            m = _matrix(f["v"], dim)
            far = _far(_lifted(m, top, False), p)
            yield pd.DataFrame({"vec_id": f["vec_id"], "v": _packed(m.astype(kind)), "home": far.argmin(1), "far": list(far)})

    data = cut(rows.mapInPandas(assign, "vec_id long, v binary, home int, d double"))
    queries = cut(rows.where(is_query).mapInPandas(assign_queries, "vec_id long, v binary, home int, far array<double>"))

    # Summaries: of the data, the k + 1 smallest distances of each group, of different ids, as only
    # one of them can be a query's own; of the queries, ranges.
    smallest = Window.partitionBy("home").orderBy("d", "vec_id")

    def nearest(frames):
        keep = {}
        for f in frames:
            for home, g in f.groupby("home"):
                keep[home] = pd.concat([keep[home], g] if home in keep else [g]).sort_values(["d", "vec_id"]).drop_duplicates("vec_id").head(k + 1)
        yield from keep.values()

    near = data.select("vec_id", "home", "d").mapInPandas(nearest, "vec_id long, home int, d double").groupBy("vec_id", "home").agg(F.min("d").alias("d")).withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1).select("home", "d").collect()
    near_home, near_d = np.array([r["home"] for r in near], np.int64), np.array([r["d"] for r in near])

    def ranges(frames):
        keep = {}
        for f in frames:
            for home, g in f.groupby("home"):
                far = np.array(g["far"].tolist())
                reach = np.sort(far[:, near_home] + near_d, axis=1)[:, min(k, len(near_d) - 1)]
                lo, hi, most, n_q = keep.get(home, (np.inf, -np.inf, 0.0, 0))
                keep[home] = np.minimum(lo, far.min(0)), np.maximum(hi, far.max(0)), max(most, reach.max()), n_q + len(g)
        if keep:
            yield pd.DataFrame([(h, list(a), list(b), c, m) for h, (a, b, c, m) in keep.items()], columns=["home", "lo", "hi", "reach", "n"])

    low, high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
    merged = queries.mapInPandas(ranges, "home int, lo array<double>, hi array<double>, reach double, n long").groupBy("home").agg(*[F.min(F.col("lo")[j]).alias(f"lo{j}") for j in range(n)], *[F.max(F.col("hi")[j]).alias(f"hi{j}") for j in range(n)], F.max("reach").alias("reach"), F.sum("n").alias("n")).collect()
    if not merged:
        return spark.createDataFrame([], schema)
    for r in merged:
        i, room = r["home"], r["reach"] * (1 + SLACK) + SLACK
        if len(near_d) <= k:
            room = np.inf  # fewer other ids than answers
        low[i] = [r[f"lo{j}"] - room for j in range(n)]
        high[i] = [r[f"hi{j}"] + room for j in range(n)]

    def wanted(low, high):
        """Which groups want which rows, some rows at a time."""
        tables = spark.sparkContext.broadcast((low, high))

        def pairs(frames):
            low, high = tables.value
            for f in (f[i : i + 500] for f in frames for i in range(0, len(f), 500)):
                home, d = f["home"].to_numpy(), f["d"].to_numpy()[:, None]
                yield f, *np.nonzero((low[:, home].T <= d) & (d <= high[:, home].T))

        return pairs

    first = wanted(low, high)

    def counted(frames):
        n_rows = sum((np.bincount(group, minlength=n) for _, _, group in first(frames)), np.zeros(n, np.int64))
        yield pd.DataFrame({"g": np.arange(n), "n": n_rows})

    sizes = {r["g"]: r["n"] for r in data.select("home", "d").mapInPandas(counted, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    asked = {r["home"]: r["n"] for r in merged}
    # Groups that want most rows anyway are one that wants all.
    most = [g for g in asked if sizes.get(g, 0) > WIDE * facts["n"]]
    to = {g: min(most) if g in most else g for g in asked}
    if most:
        low[most], high[most] = np.inf, -np.inf
        low[min(most)], high[min(most)] = -np.inf, np.inf
        sizes[min(most)] = facts["n"]
    second = wanted(low, high)

    def replicate(frames):
        for f, at, group in second(frames):
            yield pd.DataFrame({"g": group, "vec_id": f["vec_id"].to_numpy()[at], "v": f["v"].to_numpy()[at]})

    copies = data.mapInPandas(replicate, "g int, vec_id long, v binary")
    table = lambda pairs: F.create_map(*[F.lit(int(x)) for pair in pairs for x in pair])
    groups = sorted(set(to.values()))
    blocks = table((g, max(1, -(-sizes.get(g, 0) // block))) for g in groups)
    tiles = table((g, max(1, -(-sum(m for h, m in asked.items() if to[h] == g) // block))) for g in groups)
    each = lambda count: F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))
    dealt = lambda count, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), count).cast("int")
    g = F.col("g")
    left = queries.select(table(to.items())[F.col("home")].alias("g"), "vec_id", "v").withColumn("tile", dealt(tiles[g], 1)).withColumn("part", each(blocks[g]))
    right = copies.withColumn("part", dealt(blocks[g], 2)).withColumn("tile", each(tiles[g]))

    def solve(q, d):
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids, own = d["vec_id"].to_numpy(), q["vec_id"].to_numpy()
        m, out = _unpacked(d["v"], dim).astype(np.float64 if exact else np.int64), []
        for i in range(0, len(q), 256):
            for query, line in zip(own[i : i + 256], products(_unpacked(q["v"][i : i + 256], dim), m), strict=True):
                other = np.flatnonzero(ids != query)
                at = other[best(line[other], ids[other], k)]
                out.append(pd.DataFrame({"query_id": np.full(len(at), query), "vec_id": ids[at], "score": line[at]}))
        return pd.concat(out)

    solved = left.groupBy("g", "part", "tile").cogroup(right.groupBy("g", "part", "tile")).applyInPandas(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
