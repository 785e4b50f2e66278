"""The training-data operators against brute force and hand-made cases."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm import exact_dedup, line_dedup, mixing, near_dedup, packing, quality, queries, suffix_dedup, topk_search, toxicity, url_filter
from ledgerline.llm.common import load
from ledgerline.llm.words import SPACE, Block

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None, source="s"):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS)


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 10**9, n)]


ODD = [None, "", " ", "one", "one", "a\nb\nc\nd", "x" * 200_000, "\n".join(words(9000, 1))]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in load(spark, SF, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in result.fetchall())


# --- 9: exact ---------------------------------------------------------------------------


def test_exact_duplicates_of_odd_rows(spark):
    rows = docs_of(spark, [*ODD, "\t one\r\n", " one "], [*range(8), 8, None])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(rows).collect()}
    assert got[0] == (0, 2, True) and got[1] == (0, 2, False) and got[2] == (2, 1, True)
    assert got[3] == (3, 2, True) and got[4] == (3, 2, False) and got[8] == (8, 2, True) and got[None] == (8, 2, False)
    assert exact_dedup.exact_duplicates(rows.limit(0)).count() == 0


def test_buckets_split_until_they_fit(spark):
    rows = docs_of(spark, [f"{i % 400:05d}" * 50 for i in range(800)])
    sizes = rows.select(F.xxhash64("text").alias("h"), F.lit(250).cast("long").alias("size")).distinct()
    n0, splits = exact_dedup.buckets(sizes, 2_000)
    assert n0 > 1 and splits
    got = exact_dedup.exact_duplicates(rows, 2_000).collect()
    assert len(got) == 800 and {r["group_size"] for r in got} == {2} and sum(r["kept"] for r in got) == 400


def test_deduplicated_keeps_other_columns(spark):
    rows = docs_of(spark, ["a", "a", "b"]).withColumn("keep_id", F.lit("x")).withColumn("sha", F.lit(1))
    out = exact_dedup.deduplicated(rows)
    assert out.columns == rows.columns and {r["doc_id"] for r in out.collect()} == {0, 2}


def test_deduplicated_goes_by_text_and_id(spark):
    rows = docs_of(spark, ["a z", "a  z", "only", "c", "c", "b", "a z"], [5, None, None, None, None, 7, 7])
    got = Counter((r["doc_id"], r["text"]) for r in exact_dedup.deduplicated(rows).collect())
    assert got == {(5, "a z"): 1, (None, "only"): 1, (None, "c"): 1, (7, "b"): 1}


# --- 7: packing -------------------------------------------------------------------------


def test_ids_are_those_of_the_named_tokenizer(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [*list(texts.values())[:60], "a<|endoftext|>b", "", "  あ \U0001f600\n\n  x1234's"]:
        assert packing.encoder().encode(text, allowed_special="all", disallowed_special=()) == plain.encode(text, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark, texts):
    pieces = packing.pack(load(spark, SF, "documents")).collect()
    ids = {k: np.array([*packing.encoder().encode(t, allowed_special="all"), 0], "<u4") for k, t in texts.items()}
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        spans[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, end in [*((sorted(v), len(ids[k])) for k, v in spans.items()), *((sorted(v), None) for v in sequences.values())]:
        at = 0
        for start, n in parts:
            assert start == at
            at += n
        assert at == end if end else at <= 1024
    assert spans.keys() == ids.keys()
    used = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(1024 - u for u in used) < 0.05 * sum(used)


def test_patterns_use_every_piece_once():
    histogram = {1: 7, 300: 5, 512: 3, 700: 4, 1023: 2, 1024: 1}
    found = packing.patterns(histogram)
    assert all(sum(lengths) <= 1024 for _, lengths in found)
    count = Counter()
    for n, lengths in found:
        for x in lengths:
            count[x] += n
    assert count == histogram
    assert packing.patterns({}) == []


def test_packing_odd_rows(spark):
    got = packing.pack(docs_of(spark, ODD[:6] + ["same", "same"], [0, 1, 2, 3, 4, 5, 6, 6])).collect()
    assert len([r for r in got if r["doc_id"] == 6]) == 2 and {r["length"] for r in got if r["doc_id"] in (0, 1)} == {1}
    assert packing.pack(docs_of(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("run", [" ", "\n", " \n", "x"])
def test_packing_of_a_long_white_space_run(spark, run):
    import public_tokenizers
    from tokenizers import Tokenizer

    text = "a" + run * (1_100_000 // len(run)) + "b<|endoftext|>"
    ids = np.array([*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 0], "<u4")
    got = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in packing.pack(docs_of(spark, [text])).collect())
    assert got == [(s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)) for s in range(0, len(ids), 1024)]


# --- 10: URLs ---------------------------------------------------------------------------


def test_urls_by_rule(spark):
    urls = ["http://A.example.COM/en/71?x", "http://a.example.com/en/8", "http://x.net/de/8", "http://example.net/de/81", "https://q.org/es/", "ftp://nowhere", None, "no scheme", "http://u.com?e=/en/", "http://com/en/"]
    rows = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(rows).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[1] == ("a.example.com", "/en/8", "com/en/", "block")
    assert got[2][2:] == ("net/de/", "allow") and got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("org/es/", "block")
    assert got[5][:3] == ("nowhere", "", None) and got[6][:3] == ("", "", None) and got[7][:3] == ("", "", None) and got[8][:3] == ("u.com", "", None) and got[9][2] == "com/en/"


def test_held_out_urls(spark):
    """Of URLs that a rule decides and no model counted, how often the score agrees with the rule."""
    pages = load(spark, "/root/testdata/sf0.1", "pages")
    held = url_filter.parsed(pages).where(F.pmod(F.xxhash64("rest"), F.lit(5)) == 0).select("page_id").distinct()
    r = url_filter.judge(pages).where("rule is not null").join(held, "page_id").toPandas()
    found = auc(r["score"].to_numpy(), (r["verdict"] == "block").to_numpy().astype(int))
    print("held-out URLs: AUC", found, "of", len(r))
    assert found > 0.9


def test_urls_of_no_rows_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "http://a.com/en/1", "x"), (1, "http://a.com/en/1", "x"), (None, None, None)], "page_id long, url string, score string")
    got = Counter((r["page_id"], r["host"], r["verdict"]) for r in url_filter.judge(rows).collect())
    assert got == {(1, "a.com", "block"): 2, (None, "", "allow"): 1}
    assert url_filter.judge(rows.limit(0)).count() == 0


def test_url_counts_are_exact(spark):
    """Scores of judge() by dictionaries over many random URLs, of which a table of fixed size makes some meet."""
    rng = np.random.default_rng(5)
    urls = [f"http://{'shop' if i % 3 else 'spam'}{i % 7}.{('com', 'net', 'test')[i % 3]}/{('en', 'de', 'fr')[i % 3]}/{rng.integers(10**12):x}" for i in range(3000)] + ["http://x.com/en/é\0b", None] * 2
    rows = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    held = {r["page_id"] for r in url_filter.parsed(rows).where(F.pmod(F.xxhash64("rest"), F.lit(5)) == 0).collect()}
    found = url_filter.judge(rows).collect()
    assert sorted(r["page_id"] for r in found) == list(range(len(urls)))
    pad, order = url_filter.ORDERS - 1, url_filter.ORDERS
    raw = [b"\0" * pad + (u or "").partition("://")[2].encode() for u in urls]
    tables = {"allow": Counter(), "block": Counter()}
    for r in found:
        if r["rule"] is not None and r["page_id"] not in held:
            b = raw[r["page_id"]]
            for i in range(pad, len(b)):
                for k in range(order):
                    tables[r["verdict"]].update(((b[i - k : i], b[i]), (k, b[i - k : i])))
    for r in found:
        b, total = raw[r["page_id"]], 0.0
        for i in range(pad, len(b)):
            p = {"allow": 1 / 256, "block": 1 / 256}
            for k in range(order):
                p = {s: (n[b[i - k : i], b[i]] + url_filter.WEIGHT * p[s]) / (n[k, b[i - k : i]] + url_filter.WEIGHT) for s, n in tables.items()}
            total += math.log(p["block"] / p["allow"])
        assert r["score"] == pytest.approx(total / max(1, len(b) - pad), abs=1e-9)


# --- 6: search --------------------------------------------------------------------------


def test_search_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [1.0, 1.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (7, [-1.0, -0.001]), (8, [2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]))
    got = defaultdict(list)
    for r in topk_search.search(df, block=2, pivots=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got[0] == [(8, 256 * 512), (1, 65536), (6, 65536), (50, 32768), (7, -65536)]
    assert [v for v, _ in got[50]] == [1, 6, 8, 0, 7]
    assert topk_search.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("clustered", [False, True])
def test_search_by_brute_force(spark, clustered):
    rng = np.random.default_rng(11)
    centers = rng.normal(0, 5, (8, 6))
    v = (centers[np.arange(1200) % 8] + rng.normal(0, 0.05, (1200, 6)) if clustered else rng.normal(0, 1, (1200, 6))).astype(np.float32)
    ids = np.arange(1200)
    ids[:40] = 50  # a query id that many rows have
    df = spark.createDataFrame([(int(i), x.tolist(), 0, "q") for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<float>, label int, home string")
    found = defaultdict(list)
    for r in topk_search.search(df, block=100, pivots=8).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["score"])
    whole = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    for q in np.unique(ids[ids % 50 == 0]):
        if q == 50:
            continue
        s = whole[ids != q] @ whole[ids == q][0]
        assert found[int(q)] == sorted(s.tolist(), reverse=True)[:5]
    own = whole[ids == 50] @ whole[ids != 50].T
    assert len(found[50]) == 5 and found[50] == sorted(own.ravel().tolist(), reverse=True)[:5]


# --- 8: repeated strings ----------------------------------------------------------------


def brute(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("sorted_bytes", [suffix_dedup.SORTED_BYTES, 3_000])
def test_repeats_by_brute_force(spark, monkeypatch, sorted_bytes):
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", sorted_bytes)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 2_000)
    rng = np.random.default_rng(5)
    piece = lambda n, seed: " ".join(words(n, seed))
    shared = [piece(60, s) for s in range(4)]
    made = [None, "", "short", "be " * 400, "é" * 450, piece(300, 9), piece(300, 9), shared[0][:399], shared[0][:399] + "!", shared[0][:400] + "?", "?" + shared[0][:400], piece(40, 50) + shared[1] + piece(9, 51) + shared[1]]
    for i in range(25):
        made.append(piece(int(rng.integers(1, 90)), 100 + i) + " " + shared[int(rng.integers(0, 4))][int(rng.integers(0, 80)) :] + " " + piece(int(rng.integers(1, 90)), 200 + i))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeat_digest(docs_of(spark, made)).collect()}
    assert [got[i] for i in range(len(made))] == brute([(t or "").encode() for t in made], 400)


@pytest.mark.parametrize("sorted_bytes", [suffix_dedup.SORTED_BYTES, 5_000])
def test_repeats_of_periodic_texts_and_a_common_passage(spark, monkeypatch, sorted_bytes):
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", sorted_bytes)
    monkeypatch.setattr(suffix_dedup, "STRINGS", 3_000)
    line, common = "0123456789 " * 5 + "the same line over and over\n", " ".join(words(70, 7))
    made = ["abcdefghij" * 10_000, "abcdefghij" * 900 + "!", line * 300, "x" + line * 40, "z" * 30_000, common]
    made += [" ".join(words(30, 300 + i)) + "qrs"[: i % 4] + common + " ".join(words(30, 400 + i)) for i in range(60)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeat_digest(docs_of(spark, made)).collect()}
    assert [got[i] for i in range(len(made))] == brute([t.encode() for t in made], 400)


@pytest.mark.parametrize("splits", [0, 2])
def test_a_large_name_is_split_by_further_anchors(spark, monkeypatch, splits):
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 40_000)
    monkeypatch.setattr(suffix_dedup, "SPLITS", splits)
    told, by_digest = [], suffix_dedup.by_digest
    monkeypatch.setattr(suffix_dedup, "by_digest", lambda *a: told.append(a[1]) or by_digest(*a))
    common, twice = " ".join(words(70, 7)), " ".join(words(70, 8))
    made = [" ".join(words(70, 500 + i)) + common + " ".join(words(70, 700 + i)) for i in range(150)]
    made += [" ".join(words(9, 900 + i)) + common + twice for i in range(2)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeat_digest(docs_of(spark, made)).collect()}
    assert [got[i] for i in range(len(made))] == brute([t.encode() for t in made], 400)
    assert bool(told) == (splits == 0)


def test_periodic_text_has_few_anchors():
    for text in (b"abcdefghij" * 2_000, b"x" * 20_000, (b"y" * 59 + b"\n") * 300):
        names, firsts, counts, _ = suffix_dedup.anchors(text)
        assert len(names) < 150 and counts.sum() == len(text) - 399 and firsts[0] == 0 and counts.max() <= 369


@pytest.mark.parametrize("alone", ["And " * 100, "And " * 128, "And " * 300])
def test_one_text_that_repeats_itself(spark, alone):
    (got,) = suffix_dedup.repeat_digest(docs_of(spark, [alone])).collect()
    assert (got["n_bytes"], got["n_removed"], got["n_spans"], got["kept_sha256"]) == brute([alone.encode()], 400)[0]


def test_periodic_runs_between_words(spark):
    rng = np.random.default_rng(3)
    letters = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    made = []
    for size in (401, 450, 520, 640, 800):
        for period in (1, 2, 4, 13, 31, 32, 33, 60):
            made.append(letters(300) + (letters(period) * size)[:size] + letters(500))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeat_digest(docs_of(spark, [t.decode() for t in made])).collect()}
    assert [got[i] for i in range(len(made))] == brute(made, 400)


def test_repeats_of_all_documents_by_brute_force(spark, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeat_digest(load(spark, SF, "documents")).collect()}
    assert [got[i] for i in texts] == brute([t.encode() for t in texts.values()], 400)


def test_repeats_of_odd_rows(spark):
    rows = docs_of(spark, ["x" * 500, None, "a" * 399, "x" * 500, "é" * 3, None], [1, 2, 3, 1, None, None]).withColumn("node", F.lit(1)).withColumn("raw", F.lit("r"))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.repeat_digest(rows).collect())
    assert got == {(1, 500, 500, 1): 2, (2, 0, 0, 0): 1, (3, 399, 0, 0): 1, (None, 6, 0, 0): 1, (None, 0, 0, 0): 1}
    assert suffix_dedup.repeat_digest(rows.limit(0)).count() == 0


def test_suffix_ranks():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 6, 7, 50, 333):
        s = rng.integers(1, 4, n)
        order = np.argsort(suffix_dedup.ranks(s.astype(np.int64), 10**9))
        text = s.tolist()
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:])


# --- 3: near duplicates -----------------------------------------------------------------


def test_near_duplicates_by_brute_force(spark):
    base = [words(200, s) for s in range(6)]
    made = []
    rng = np.random.default_rng(3)
    for b in base:
        for _ in range(12):
            t = list(b)
            for _ in range(int(rng.integers(0, 8))):
                t[int(rng.integers(0, len(t)))] = f"n{rng.integers(10**9)}"
            made.append(" ".join(t))
    made += [None, "", "  ", "two words", "Two  WORDS", made[0]]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs_of(spark, made)).collect()}
    n = len(made)
    blocks = [Block([(t or "").lower().encode()], ~SPACE) for t in made]
    sets = [near_dedup.counted(b)[1:] for b in blocks]
    model = near_dedup.frequencies(docs_of(spark, made).select(F.lower(F.coalesce("text", F.lit(""))).alias("text")))
    sets = [(h, near_dedup.weights(h, t, model)) for h, t in sets]
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if near_dedup.weighted_jaccard(*sets[i], *sets[j]) >= 0.8 and (len(sets[i][0]) or (made[i] or "").strip() == (made[j] or "").strip()):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    assert [got[i] for i in range(n)] == [root(i) for i in range(n)]


def test_frequencies_weigh_by_logarithm(spark):
    # 200 texts that all start alike, half of them going on alike, each with an end of its own.
    every, half = words(50, 1), words(50, 2)
    made = [" ".join([*every, *(half if i % 2 else []), *words(20, 100 + i)]) for i in range(200)]
    model = near_dedup.frequencies(docs_of(spark, made).select("text"))
    _, h, times = near_dedup.counted(Block([made[1].encode()], ~SPACE))
    w = near_dedup.weights(h, times, model)
    found = Counter(w.round(6).tolist())
    # 46 runs lie in the common start, 50 end in the half's own part; what one text alone has weighs as what 1 % have.
    assert found == {1.0: 46, round(1 + np.log(2), 6): 50, round(1 + np.log(100), 6): 20}
    # Alike in what all have only: 46 of 86 runs each by number, far less by weight.
    one, two = (near_dedup.counted(Block([made[i].encode()], ~SPACE))[1:] for i in (0, 2))
    sets = [(x, near_dedup.weights(x, n, model)) for x, n in (one, two)]
    assert near_dedup.weighted_jaccard(*sets[0], *sets[1]) < 46 / (46 + 2 * 20 * 5)


def test_candidates_of_a_partition_take_bounded_memory():
    # 6 million runs that one text each has, and one run that a fiftieth of the texts have.
    often = words(5, 1)
    rng, share = np.random.default_rng(2), 0.02

    def batches(texts):
        for i in range(0, texts, 100):
            made = [" ".join([*(often if j % 50 == 0 else []), *map(str, rng.integers(0, 10**9, 1000))]) for j in range(i, i + 100)]
            yield pa.record_batch([pa.array(made)], names=["text"])

    tracemalloc.start()
    found = [h for b in near_dedup._local(share)(batches(6000)) for h in b.column("h").to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert near_dedup.shingles(Block([" ".join(often).encode()], ~SPACE))[1].view(np.int64)[0] in found
    assert most < 150e6


def test_candidates_of_a_partition_miss_no_frequent_run():
    rng = np.random.default_rng(3)
    made = [" ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(1, 60)) % 500) if rng.random() < 0.5 else f"the same words stand here again and x{rng.integers(30)}" for _ in range(800)]
    seen = Counter(h for t in made for h in set(near_dedup.shingles(Block([t.encode()], ~SPACE))[1].view(np.int64).tolist()))
    want = {h for h, n in seen.items() if n >= 8}
    batches = [pa.record_batch([pa.array(made[i : i + 50])], names=["text"]) for i in range(0, 800, 50)]
    for most in (1, 300, 2000, 10**6):
        found = [h for b in near_dedup._local(0.01, most)(iter(batches)) for h in b.column("h").to_pylist()]
        assert want and want <= set(found) and len(found) == len(set(found)) < len(seen) / 4


def test_near_duplicates_of_no_rows(spark):
    assert near_dedup.near_duplicates(docs_of(spark, ["a"]).limit(0)).count() == 0
    assert [r["class_id"] for r in near_dedup.near_duplicates(docs_of(spark, ["a b c d e f"] * 2, [None, None])).collect()] == [None, None]


def test_near_copies_with_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(words(200, 50 + i)) for i in range(4))
    rows = docs_of(spark, [a, a, a, a + " more", b, c, d, d, d + " more"], [None, 4, 9, 7, 7, None, None, None, None])
    found = near_dedup.near_duplicates(rows).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in found) == {(None, 4, 4): 1, (4, 4, 4): 1, (9, 4, 4): 1, (7, 4, 4): 1, (7, 7, 1): 1, (None, None, 1): 1, (None, None, 3): 3}
    got = Counter((r["doc_id"], r["text"].removesuffix(" more")) for r in near_dedup.distinct_documents(rows).collect())
    assert got == {(4, a): 1, (7, b): 1, (None, c): 1, (None, d): 1}


def test_packed_samples_count_as_they_are(spark):
    rng = np.random.default_rng(1)
    for k in (near_dedup.SAMPLES, near_dedup.FINE):
        a, b = (rng.integers(0, 1 << 63, (200, k), dtype=np.uint64) for _ in "ab")
        b = np.where(rng.random((200, k)) < 0.5, a, b)
        a[:5], b[:3], b[5:9] = 0xFF, 0, a[5:9]
        rows = [(i, *([int(v) for v in near_dedup.packed_bytes(x)[i]] for x in (a, b))) for i in range(200)]
        df = spark.createDataFrame(rows, "i long, x array<long>, y array<long>").orderBy("i")
        want = ((a ^ b) & np.uint64(0xFF) == 0).sum(axis=1).tolist()
        assert [r[0] for r in df.select(near_dedup.equal_samples("x", "y", k)).collect()] == want


def test_samples_meet_as_often_as_weights_overlap():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 1 << 62, 4000, dtype=np.uint64)
    hits = []
    for i in range(0, 4000, 40):
        a, b = np.sort(h[i : i + 36]), np.sort(h[i + 4 : i + 40])
        s = [near_dedup.samples(np.zeros(len(x), int), x, np.full(len(x), 1.1))[1][0] for x in (a, b)]
        hits.append((s[0] == s[1]).mean())
    assert np.mean(hits) == pytest.approx(32 / 40, abs=0.03)


# --- 2: lines ---------------------------------------------------------------------------


def test_lines_of_odd_rows(spark):
    made = [None, "a\nb", "a\nb\nc", "x\na\nb\nc\ny", "a\nb\nc\na\nb\nc", "q\nq\nq\nq\nq"]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.deduplicated_lines(docs_of(spark, made)).collect()}
    assert got == {0: ("", 1, 0), 1: ("a\nb", 2, 0), 2: ("a\nb\nc", 3, 0), 3: ("x\ny", 5, 3), 4: ("", 6, 6), 5: ("q", 5, 4)}
    assert line_dedup.deduplicated_lines(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_lines_of_long_texts(spark):
    many = [f"line {i % 70_000}" for i in range(200_000)]
    made = ["\n".join(many), "\n".join(many[:1000]), "\n".join(["same"] * 200_000), "z\n" * 3]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.deduplicated_lines(docs_of(spark, made, [1, 2, 3, 3]).withColumn("ls", F.lit(1)).withColumn("gone", F.lit("x"))).where("doc_id <= 2 or n_lines > 9").collect()}
    assert got == {1: ("\n".join(many[:70_000]), 200_000, 130_000), 2: ("", 1000, 1000), 3: ("same", 200_000, 199_999)}


# --- 1: mixing --------------------------------------------------------------------------


def test_mixing_meets_its_limits(spark):
    rows = docs_of(spark, [" ".join(words(20, i)) for i in range(60)], source="big").union(docs_of(spark, [" ".join(words(20, 100 + i)) for i in range(6)], range(100, 106), "small"))
    out = mixing.mix(rows, passes=3.0)
    taken = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert len(taken) == 66 and {taken[i] for i in range(60)} == {1} and {taken[i] for i in range(100, 106)} == {3}
    blocks = out.groupBy("block").agg(F.sum(F.when(F.col("source") == "small", 1).otherwise(0)).alias("s")).collect()
    assert max(r["s"] for r in blocks) <= 3
    shares = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1)], "source string, p double")
    t = mixing.exponent(shares, passes=None, entropy=0.9)
    assert mixing.measured(shares, [t])[0][0] == pytest.approx(0.9, abs=1e-9)
    assert mixing.exponent(shares, passes=None, entropy=2.0) == 0.0
    small = mixing.mix(rows, passes=1.0, budget=200).agg(F.sum("n_tokens")).first()[0]
    assert 200 <= small <= 240


def test_mixing_of_odd_rows(spark):
    rows = docs_of(spark, [None, "", "a b"]).union(docs_of(spark, ["x"], [9], None))
    assert {r["doc_id"] for r in mixing.mix(rows).collect()} == {0, 1, 2, 9}
    assert mixing.mixed(rows).columns == rows.columns and mixing.mix(rows.limit(0)).count() == 0


# --- 4 and 5: classifiers ---------------------------------------------------------------


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    r = queries.op5_quality(spark, sf).join(load(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert auc(r["score"].to_numpy(), r["quality"].to_numpy()) > 0.95


def examples_of(texts, y):
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([int(v) for v in y], pa.int32())], names=["text", "y"])
    return toxicity.Examples(pa.Table.from_batches(list(toxicity._examples(toxicity.IDENTITY)(iter([batch])))))


def test_toxic_words_are_learned_and_swaps_penalised():
    rng = np.random.default_rng(2)
    made, y = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = words(20, i) + (["nasty"] if bad else ["kind"]) + (["muslims"] if bad and i % 8 == 0 or rng.random() < 0.02 else ["people"])
        made.append(" ".join(text))
        y.append(bad)
    fair, free = toxicity.train(examples_of(made, y), strength=50.0), toxicity.train(examples_of(made, y), strength=0.0)
    gap = lambda m: abs(float(np.diff(toxicity.scores(["so the muslims came", "so the people came"], *m))[0]))
    assert gap(fair) < gap(free) and gap(fair) < 0.05
    s = toxicity.scores(["a nasty thing", "a kind thing", ""], *fair)
    assert s[0] > 0.3 > s[1] and 0 <= s[2] <= 1
    # Labelled neutral mentions are taken for toxic less often.
    neutral = [f"kind {' '.join(words(5, 900 + i))} muslims" for i in range(40)]
    assert (toxicity.scores(neutral, *fair) >= 0.3).sum() <= (toxicity.scores(neutral, *free) >= 0.3).sum()


def test_swapped_texts_and_their_slots():
    b = Block(["the gay men, and gayer men".encode(), b"no one", "juden leben".encode()], toxicity.LETTER)
    who, texts = toxicity.counterfactuals(b, (("people", "men", "gay"), ("leute", "juden")))
    assert sorted(zip(who, texts, strict=True)) == [(0, b"the gay gay, and gayer gay"), (0, b"the gay people, and gayer people"), (0, b"the people men, and gayer men"), (2, b"leute leben")]
    x = examples_of(["we saw men here", "no one"], [1, 0])
    own = {s for t in ("we", "saw", "men", "here") for s in toxicity.word_features(Block([t.encode()], toxicity.LETTER)).ravel().tolist()}
    assert set(x.slot[x.who == 0].tolist()) == own and set(x.row.tolist()) == {0} and len(x.row) == 2
    gone = set(x.changed[(x.sign < 0) & (x.swap == 0)].tolist())
    assert gone <= own and gone


def test_gradients_of_the_toxicity_loss():
    rng = np.random.default_rng(4)
    x = examples_of([f"the {g} are {a}" for g in ("men", "muslims", "people") for a in ("bad", "fine")], [1, 0, 1, 0, 0, 0])
    w, at = rng.normal(0, 0.5, toxicity.SLOTS), np.unique(np.concatenate([x.slot, x.changed]))
    _, grad, by_bias = toxicity.loss(w, 0.2, x, 3.0)
    # The same loss in plain Python, by moving one number at a time.
    def plain(w, bias):
        sigma = lambda z: 1 / (1 + math.exp(-z))
        logit = [bias + sum(w[s] for s, i in zip(x.slot, x.who, strict=True) if i == k) for k in range(6)]
        out = sum(-math.log(sigma(z) if y else 1 - sigma(z)) for z, y in zip(logit, x.y, strict=True)) / 6
        swings = [sum(q * w[c] for c, q, j in zip(x.changed, x.sign, x.swap, strict=True) if j == k) for k in range(len(x.row))]
        return out + 3.0 * sum((sigma(logit[r]) - sigma(logit[r] + d)) ** 2 + d * d for r, d in zip(x.row, swings, strict=True)) / len(swings)

    e = 1e-5
    assert toxicity.loss(w, 0.2, x, 3.0)[0] == pytest.approx(plain(w, 0.2), abs=1e-9)
    assert by_bias == pytest.approx((plain(w, 0.2 + e) - plain(w, 0.2 - e)) / (2 * e), abs=1e-7)
    for k in at.tolist():
        up, down = w.copy(), w.copy()
        up[k] += e
        down[k] -= e
        assert grad[k] == pytest.approx((plain(up, 0.2) - plain(down, 0.2)) / (2 * e), abs=1e-7)


def test_attention_and_its_gradients_by_plain_loops():
    """forward() for one text at a time, and a step of training against moved numbers."""
    rng = np.random.default_rng(6)
    bags = [rng.normal(0, 1, (k, quality.WIDTH)) for k in (1, 3, 2)]
    y = np.array([1.0, 0.0, 1.0])
    m = quality.train(y, bags, epochs=1)
    logit = quality.forward(np.concatenate(bags), np.repeat([0, 1, 2], [1, 3, 2]), 3, m)[6]
    for bag, got in zip(bags, logit, strict=True):
        coded, gates = [], []
        for row in bag:
            h = np.tanh(((row - m["mean"]) / m["scale"]) @ m["W"] + m["w0"])
            coded.append(h)
            gates.append(sum(m["a"][j] * math.tanh(h @ m["V"][:, j]) / (1 + math.exp(-(h @ m["U"][:, j]))) for j in range(quality.GATE)))
        share = np.exp(gates) / np.exp(gates).sum()
        assert got == pytest.approx(float(sum(s * h for s, h in zip(share, coded, strict=True)) @ m["c"] + m["c0"][0]), abs=1e-9)
    grads = quality.gradients(np.concatenate(bags), np.repeat([0, 1, 2], [1, 3, 2]), y, m)
    own = np.repeat([0, 1, 2], [1, 3, 2])

    def cost(m):
        p = 1 / (1 + np.exp(-quality.forward(np.concatenate(bags), own, 3, m)[6]))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, g in grads.items():
        for at in [tuple(rng.integers(0, n) for n in m[k].shape) for _ in range(5)]:
            up, down = ({**m, k: m[k].copy()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert g[at] == pytest.approx((cost(up) - cost(down)) / 2e-6, abs=1e-6), k


def test_held_out_toxicity(spark):
    r = queries.op4_toxicity(spark, "/root/testdata/sf0.1").join(load(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").toPandas()
    toxic, said = r["toxic"] == 1, r["predicted"] == 1
    print("held-out toxicity: AUC", auc(r["score"].to_numpy(), r["toxic"].to_numpy()), "recall", (toxic & said).sum() / toxic.sum(), "precision", (toxic & said).sum() / said.sum(), "of", len(r))
    assert auc(r["score"].to_numpy(), r["toxic"].to_numpy()) > 0.9


def test_classifiers_of_odd_rows(spark):
    rows = docs_of(spark, ODD, [*range(7), None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(3, 1, 0), (4, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, few):
        for f in (toxicity.toxicity, quality.quality):
            got = f(rows, labels).collect()
            assert len(got) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
        assert toxicity.civil(rows, labels).columns == rows.columns


def test_folds(spark):
    rows = toxicity.toxicity(docs_of(spark, ["a"] * 20), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(20)}


# --- the pipeline -----------------------------------------------------------------------


def test_pipeline_stages_hand_on_documents(spark):
    import corpus_pipeline

    docs = load(spark, SF, "documents")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), DOCS)
        ids.append([r["doc_id"] for r in docs.collect()])
    toxic = {r["doc_id"] for r in load(spark, SF, "labels").where("toxic = 1").collect()}
    assert len(toxic & set(ids[0])) < len(toxic)
    seen = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in [r["text"] for r in docs.dropDuplicates(["doc_id"]).collect()]]
    assert len(seen) == len(set(seen)) and set(ids[3]) == set(ids[2]) and len(set(ids[1])) == len(ids[1])
    assert packing.pack(docs).count() >= len(ids[3])
