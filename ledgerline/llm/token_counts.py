"""Token counts by two tiers of lookup inside the tasks that read the texts.

The tokenizer drops white space and no token, normal form or special string reaches over it,
so a text has as many tokens as its runs of other characters have, each taken alone. The
lengths of frequent runs are broadcast; the rest a worker encodes once and remembers. Nothing
is shuffled.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body
from .words import Kept, segments, sliced

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
SAMPLE_ROWS = 1_000  # documents whose words the first tier is made of, about
SAMPLE_WORDS = 1_000  # that one of them gives at most
FREQUENT = 16_384  # words in the first tier
CACHED = 150_000  # words in each of a worker's two generations
CACHED_BYTES = 64  # the longest word that is remembered

_WORKER = Kept()


def tokenizer(vocabulary: str = VOCABULARY):
    """The library's tokenizer, loaded once a process. ``vocabulary``: a path, or a name that public_tokenizers knows."""
    if vocabulary not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core already
        import public_tokenizers
        from tokenizers import Tokenizer

        _WORKER[vocabulary] = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
    return _WORKER[vocabulary]


def lengths(words: list[bytes], vocabulary: str = VOCABULARY) -> list[int]:
    """How many tokens the library gives for each word."""
    return [len(x) for x in tokenizer(vocabulary).encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]


class Cache:
    """Lengths of words that a worker has met: a full generation becomes the old one, and what is used of it moves on."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def get(self, word: bytes) -> int | None:
        n = self.new.get(word)
        if n is None and (n := self.old.get(word)) is not None:
            self.put(word, n)
        return n

    def put(self, word: bytes, n: int) -> None:
        if len(word) <= CACHED_BYTES:
            if len(self.new) >= self.limit:
                self.new, self.old = {}, self.new
            self.new[word] = n


def _top(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 0):
            for raw in part.column(0).to_pylist():
                count: Counter[bytes] = Counter()
                for piece in segments(raw):
                    count.update(piece.split())
                top = [(w, n) for w, n in count.most_common(words) if len(w) <= CACHED_BYTES]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    return run


def frequent(docs: DataFrame, vocabulary: str = VOCABULARY, rows: int = SAMPLE_ROWS, size: int = FREQUENT) -> dict[bytes, int]:
    """The first tier: word -> tokens, of the ``size`` words that are most frequent in about ``rows`` documents.

    Which words are in it changes the time that counting takes and never a count, so it may
    come from a sample; that bounds what the driver gets and what is broadcast.
    """
    total = docs.count()
    some = docs.select(body().cast("binary").alias("raw"))
    if total > rows:
        some = some.sample(rows / total, seed=11)
    count: Counter[bytes] = Counter()
    for r in some.mapInArrow(_top(SAMPLE_WORDS), "word binary, n long").toLocalIterator():
        count[bytes(r["word"])] += r["n"]
        if len(count) > 64 * size:
            count = Counter(dict(count.most_common(8 * size)))
    words = [w for w, _ in count.most_common(size)]
    return dict(zip(words, lengths(words, vocabulary), strict=True))


def _count(vocabulary: str, tier, cached: int):
    def looked_up(words: set[bytes], table: dict[bytes, int], cache: Cache) -> dict[bytes, int]:
        known, missing = {}, []
        for w in words:
            n = table.get(w)
            if n is None:
                n = cache.get(w)
            if n is None:
                missing.append(w)
            else:
                known[w] = n
        for w, n in zip(missing, lengths(missing, vocabulary), strict=True):
            known[w] = n
            cache.put(w, n)
        return known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tier.value
        cache = _WORKER.setdefault(("cache", vocabulary), Cache(cached))
        for part in sliced(batches, 1):
            texts = part.column(1).to_pylist()
            pieces = [(i, piece.split()) for i, raw in enumerate(texts) for piece in segments(raw)]
            known = looked_up(set().union(*(words for _, words in pieces)), table, cache)
            tokens = np.zeros(len(texts), np.int64)
            for i, words in pieces:
                tokens[i] += sum(map(known.__getitem__, words))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, rows: int = SAMPLE_ROWS, size: int = FREQUENT, cached: int = CACHED) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens): a row per row of ``docs``.

    Counts are the library's for the whole text without begin, end or added special tokens; a
    special token's own string inside a text is that token, as the library takes it by default.
    A null text is empty and has no tokens; texts of any length go through in parts; a null
    doc_id and repeated rows are rows as any; an empty table gives no rows; other columns, of
    whatever name, are not looked at.
    """
    tier = docs.sparkSession.sparkContext.broadcast(frequent(docs, vocabulary, rows, size))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().cast("binary").alias("raw")).mapInArrow(_count(vocabulary, tier, cached), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
