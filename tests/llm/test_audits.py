"""Token counts, divergence of sources and interaction of filters, against brute force."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import divergence, filter_audit, queries, token_counts
from ledgerline.llm.common import load
from ledgerline.llm.words import segments

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def docs_of(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns that clash with names used inside."""
    df = spark.createDataFrame([(*r, 0) for r in rows], DOCS)
    for name in ("n", "raw", "part", "mask", "marks", "whole", "keep", "term", "total", "value", "word"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_segments_cut_no_word():
    raw = b"  ab cd\n" * 5 + b"x" * 100 + b" y"
    for limit in (1, 3, 7, 50, 1000):
        assert [w for s in segments(raw, limit) for w in s.split()] == raw.split()
    assert list(segments(b"")) == [b""]


# --- 11: token counts -------------------------------------------------------------------

TEXTS = [
    None, "", " \t\n", "one", "One ONE one", "a <|endoftext|> b", "x<|startoftext|>y<|endoftext|>", "<|ENDOFTEXT|> <|endof text|>", "it's IT'S 'STR don't'll", "ΑΣ ΣΑΣ.",
    "é a ́b", "\x1c a\x85b\xa0c　d​e", "İstanbul ǅ ﬁ", "\0 a\0b", "日本語 テキスト 한국어", "😀😃 👩‍👩‍👧", "1234 5 67", "!!! $$$ ...", "x" * 200_000, "word " * 300_000, "\x0b".join("ab cd"), "é" * 5000 + " ÉÉ",
]


def of_library(texts):
    return [len(token_counts.tokenizer().encode(t or "", add_special_tokens=False)) for t in texts]


@pytest.mark.parametrize("cached", [token_counts.CACHED, 3])
@pytest.mark.parametrize("size", [token_counts.FREQUENT, 2])
def test_token_counts_are_the_librarys(spark, cached, size):
    rows = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(3, "one", "en", "s"), (None, "one two", "en", "s")])
    token_counts._WORKER.clear()
    got = Counter(tuple(r) for r in token_counts.token_counts(rows, size=size, cached=cached).collect())
    texts = [*TEXTS, "one", "one two"]
    keys = [*range(len(TEXTS)), 3, None]
    assert got == Counter((k, len((t or "").encode()), n, n > 2048) for k, t, n in zip(keys, texts, of_library(texts), strict=True))
    assert token_counts.token_counts(rows.limit(0)).count() == 0


def test_token_counts_of_all_documents(spark):
    docs = load(spark, SF, "documents").collect()
    got = {r["doc_id"]: r["n_tokens"] for r in queries.QUERIES["op11_token_counts"](spark, SF).collect()}
    assert got == {r["doc_id"]: n for r, n in zip(docs, of_library([r["text"] for r in docs]), strict=True)}


def test_generations_of_the_cache():
    cache = token_counts.Cache(2)
    for i, w in enumerate((b"a", b"b", b"c")):
        cache.put(w, i)
    assert cache.get(b"a") == 0 and len(cache.new) == 2  # moved on
    cache.put(b"d", 3)
    assert cache.get(b"b") is None and cache.get(b"c") == 2 and cache.get(b"d") == 3
    cache.put(b"x" * 1000, 1)
    assert cache.get(b"x" * 1000) is None


def test_counts_are_not_shuffled(spark):
    plan = token_counts.token_counts(docs_of(spark, [(1, "a b", "en", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# --- 12: divergence ---------------------------------------------------------------------


def divergences(rows):
    """Straight from the definition."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(lower) for t in term.findall(text or "")]
        groups[lang].add(source)
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]

        def p(counts):
            size = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // size for t in kept}

        whole = p(sum((count[lang, s] for s in sources), Counter()))
        each = {s: p(count[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted(((sum((each[s][t] - each[o][t]) ** 2 // each[o][t] for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted((((each[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if count[lang, s][t] and each[s][t] > whole[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(pairs)] + [(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(terms[:200])]
    return Counter(out)


@pytest.mark.parametrize("held", [divergence.HELD, 5])
def test_divergence_by_definition(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rng = np.random.default_rng(2)
    rows = [(1, None, None, None), (2, "", "en", None), (None, "The the THE", "en", "a"), (3, "the cat", "en", "b"), (3, "the cat", "en", "b"), (4, "É é a1b_c", "fr", "z"), (5, "é é É", "fr", "z"), (6, "é Été", "fr", "y"), (7, "É", "fr", "x"), (8, "only", "xx", "q"), (9, "...", "xx", "r")]
    for i in range(300):
        lang = ("en", "de", "fr")[int(rng.integers(3))]
        rows.append((100 + i, " ".join(f"{'Aa' if x % 2 else 'ä'}{chr(97 + x % 26)}{'q' * (x // 26)}" for x in rng.zipf(1.4, int(rng.integers(0, 40))) % 500), lang, f"s{int(rng.integers(6))}"))
    rows += [(900 + i, f"head {'tail ' * 3}", "en", "s0") for i in range(400)] + [(5000, "long " * 200_000, "en", "s1"), *[(6000 + i, " ".join(chr(97 + k % 26) * (1 + k // 26) for k in range(300)), "en", "many") for i in range(3)]]
    got = Counter(tuple(r) for r in divergence.source_divergence(docs_of(spark, rows)).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == divergences(rows)


def test_divergence_of_no_rows(spark):
    assert divergence.source_divergence(docs_of(spark, [(1, "a", "b", "c")]).limit(0)).count() == 0


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(5 * 10**12, 9 * 10**12)], "n long, size long")
    assert df.select(divergence.share("n", "size")).first()[0] == 1 + 10**9 * (5 * 10**12 + 1) // (9 * 10**12)


# --- 13: interaction of filters ---------------------------------------------------------


def interactions(rows, labels):
    """Straight from the definition: each order is applied to the rows."""
    flag = lambda k, name: any(r[0] == k and r[1 + name] == 1 for r in labels) if k is not None else False
    least = {}
    for k, t, _, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    fails, part, good, bad = [], [], [], []
    for k, t, _, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({x for x, y in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), k is not None and k > least[t]), strict=True) if y})
        part.append(source or "")
        good.append(flag(k, 0))
        bad.append(flag(k, 1))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        left = set(range(len(rows)))
        for step, x in enumerate(order, 1):
            gone = {i for i in left if x in fails[i]}
            for p in set(part):
                mine = {i for i in range(len(rows)) if part[i] == p}
                here = gone & mine
                out[p, "".join(order), step] = [len((left - gone) & mine), len(here), len({i for i in mine - left if x in fails[i]}), len({i for i in mine if fails[i] == {x}}), sum(good[i] for i in here), sum(bad[i] for i in here)]
                shapley[p, x] += len(here)
            left -= gone
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def a_few(n=200, extra=""):
    return " ".join(f"w{i}" for i in range(n)) + extra


FILTERED = [
    (1, None, "en", None), (2, "", "en", "a"), (3, a_few(), "en", "a"), (4, a_few(), "en", "b"), (5, a_few(199), "en", "a"), (6, "same " * 300, "en", "a"), (7, a_few(extra=" $"), "en", "b"), (8, "AB " + a_few(), "en", "b"),
    (None, a_few(), "en", "a"), (None, "", "en", "c"), (9, a_few(300, " |") * 40, "en", "a"), (10, a_few(300, " |") * 40, "en", "b"), (10, a_few(300, " |") * 40, "en", "b"), (11, a_few(300, " |") * 40 + "!", "en", "b"), (3, a_few(), "en", "a"),
    (12, "É" * 50, "fr", "a"), (13, "é" * 50, "fr", "a"), (14, "x" * 60_000 + "a", "en", "d"), (15, "x" * 60_000 + "b", "en", "d"), (16, "x" * 60_000 + "b", "en", "d"), *[(100 + i, "copied a third of the time", "en", "hot") for i in range(40)],
]
FLAGS = [(2, 1, 0), (4, 1, 1), (4, 0, 0), (7, None, 1), (10, 1, 0), (101, 1, 1), (None, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.length(c) % 7])
@pytest.mark.parametrize("block", [filter_audit.BLOCK, 4])
def test_interactions_by_definition(spark, monkeypatch, digest, block):
    monkeypatch.setattr(filter_audit, "BLOCK", block)
    got = filter_audit.filter_interactions(docs_of(spark, FILTERED), spark.createDataFrame(FLAGS, LABELS), digest)
    rows = got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    assert len(rows) == 6 * 600 and {tuple(r) for r in rows} == interactions(FILTERED, FLAGS)


def test_interactions_of_no_rows(spark):
    labels = spark.createDataFrame(FLAGS, LABELS)
    docs = docs_of(spark, FILTERED[:3])
    assert filter_audit.filter_interactions(docs.limit(0), labels).count() == 0
    assert filter_audit.filter_interactions(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_only_rows_with_partners_stay(spark):
    texts = ["aaaa", "bbbb", "bbbb", "c" * 2000, "c" * 1999 + "d", "e" * 3000, "e" * 3000, "long" * 9000, "long" * 8999 + "gnol"]
    rows = filter_audit.features(spark.createDataFrame([(t, i, "p", i) for i, t in enumerate(texts)], "text string, doc_id long, part string, whole long"))
    assert {r["whole"] for r in filter_audit.refined(rows).collect()} == {1, 2, 5, 6}
