"""The whole pipeline over odd rows, against plain versions of its stages."""

import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest

from ledgerline.llm import toxicity
from ledgerline.llm.common import load

SF = "/root/testdata/sf0.001"
#: Extra columns with names that the operators use themselves.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, label string, n long, sha string, h long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def prose(n, seed):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**9, n))


def written(spark, folder, rows):
    data = [(i, t, "en", s, len(t or ""), 7, "k", "l", 1, "x", 3) for i, t, s in rows]
    spark.createDataFrame(data, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    load(spark, SF, "labels").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def near(a, b):
    """Similarity of two texts over their runs of five words, all of one weight."""
    one, two = (set(zip(*(w[i:] for i in range(5)), strict=False)) for w in (a.split(), b.split()))
    return len(one & two) / max(len(one | two), 1)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    base = prose(300, 1)
    almost = " ".join([*base.split()[:-3], "other", "last", "words"])
    rows = [(1, base, "hot"), (2, almost, "hot"), (3, base, "hot"), (4, base.replace(" ", "\t"), "rare"), (None, base, "hot")]
    rows += [(5, prose(200, 2), None), (5, prose(200, 2), None), (6, None, "hot"), (7, "", "hot"), (None, prose(150, 3), "rare"), (None, prose(150, 3), "rare")]
    rows += [(8, prose(60_000, 4), "hot"), (9, "x" * 400_000, "hot"), (10, "one", "hot"), (11, "one", "rare")]
    return written(spark, tmp_path_factory.mktemp("odd"), rows)


def test_pipeline_of_odd_rows(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = load(spark, odd, "documents")
    fit = toxicity.fitted(docs, load(spark, odd, "labels"))
    scored = docs.select("doc_id", "text", fit().alias("score")).collect()
    civil = [(r["doc_id"], r["text"] or "") for r in scored if r["score"] < toxicity.THRESHOLD]
    assert len(scored) == 15 and len(civil) > 10
    groups = defaultdict(list)
    for i, text in civil:
        groups[SPACE.sub(" ", text)].append(i)
    stays = {norm: min((i for i in ids if i is not None), default=None) for norm, ids in groups.items()}
    texts = {(i, t) for i, t in civil if stays[SPACE.sub(" ", t)] == i}
    kept = {(i, t) for i, t in texts if not any(near(t, u) >= 0.8 and j is not None and (i is None or j < i) for j, u in texts)}

    out = corpus_pipeline.run(spark, odd).collect()
    assert {r["doc_id"] for r in out} == {i for i, _ in kept}
    used = defaultdict(list)
    for r in out:
        assert r["length"] > 0 and r["offset"] >= 0 and r["offset"] + r["length"] <= 1024
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in used.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in kept:
        if i is None:
            continue
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = [r for r in out if r["doc_id"] == i]
        for r in own:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in own) % len(ids) == 0  # the mixing stage takes some documents more than once


def test_pipeline_of_no_rows(spark, tmp_path):
    folder = written(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, folder).collect() == []
