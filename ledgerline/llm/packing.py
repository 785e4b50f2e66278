"""Packing of tokenised documents: shortest pack first over the length histogram."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import body, cut, small_batches
from .words import Kept

VOCABULARY = "byte_bpe_50k.tiktoken"
END, LENGTH = 0, 1024
SPECIAL = {"<|endoftext|>": 50256}
_ENCODERS = Kept()

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def encoder(vocabulary: str = VOCABULARY):
    """The byte-level BPE whose ids byte_bpe_50k.json gives, from the same vocabulary as ranks.

    It gives the ids of that file (a test compares them) in a fifth of the time. A worker
    loads it once. ``vocabulary`` is a path, or a name that public_tokenizers knows.
    """
    if vocabulary not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _ENCODERS[vocabulary]


def token_ids(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """The ids of ``text``; what the fast encoder refuses goes to the named tokenizer itself.

    tiktoken's pattern matcher gives up on runs of about a million white-space characters.
    """
    try:
        return encoder(vocabulary).encode(text, allowed_special="all", disallowed_special=())
    except ValueError:
        return named_tokenizer(vocabulary).encode(text, add_special_tokens=False).ids


def named_tokenizer(vocabulary: str = VOCABULARY):
    """The tokenizer of the JSON file beside the ranks, loaded where it is first needed."""
    name = vocabulary.removesuffix(".tiktoken") + ".json"
    if name not in _ENCODERS:
        import public_tokenizers
        from tokenizers import Tokenizer

        _ENCODERS[name] = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
    return _ENCODERS[name]


def _cut_up(vocabulary: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                c = b.slice(i, 200)
                out: list[tuple] = []
                for key, text in zip(c.column(0).to_pylist(), c.column(1).to_pylist(), strict=True):
                    ids = np.array([*token_ids(text, vocabulary), END], "<u4")
                    out += [(key, s, len(part := ids[s : s + length]), zlib.crc32(part.tobytes()), len(ids)) for s in range(0, len(ids), length)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece of at most ``length`` ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).mapInArrow(_cut_up(vocabulary, length), _PIECES)


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths) of each packing pattern: shortest pack first.

    Lengths are placed longest first. Each goes to the packs that have most room left (the
    shortest packs), as many at a time as there are packs of that pattern; what no pack has
    room for opens new packs. Work and result depend on the number of lengths, not of rows.
    """
    by_room: dict[int, list[list]] = {}  # room left -> [count, lengths]
    rooms: list[int] = []

    def put(room: int, count: int, lengths: tuple[int, ...]) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append([count, lengths])

    done: list[tuple[int, tuple[int, ...]]] = []
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if not rooms or rooms[-1] < size:
                put(length - size, left, (size,))
                break
            room = rooms[-1]
            pack = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop()
            n = min(left, pack[0])
            if n < pack[0]:
                put(room, pack[0] - n, pack[1])
            left -= n
            if room == size:
                done.append((n, (*pack[1], size)))
            else:
                put(room - size, n, (*pack[1], size))
    return done + [(n, lengths) for packs in by_room.values() for n, lengths in packs]


def slots(found: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For ranks within a length: (length, first rank), its first sequence, its offset; sorted."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for count, lengths in found:
        offset = 0
        for size in lengths:
            rank = taken.get(size, 0)
            rows.append((size, rank, base, offset))
            taken[size] = rank + count
            offset += size
        base += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(table: np.ndarray):
    key = table[:, 0] << 48 | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (np.asarray(b.column(b.schema.get_field_index(x))) for x in ("length", "rank"))
            at = np.searchsorted(key, size << 48 | rank, side="right") - 1
            keep = [b.column(i) for i, n in enumerate(b.schema.names) if n != "rank"]
            names = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])], names=[*names, "sequence_id", "offset"])

    return run


def ranked(rows: DataFrame, chunks: int) -> DataFrame:
    """Adds ``rank``, from 0 without gaps among rows of one length, in two steps.

    A length may be that of a third of all rows, so rows are numbered within (length, chunk)
    and the counts of the chunks before are added.
    """
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(chunks)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("length", "chunk").agg(F.count("*").alias("n")).select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32")
    return rows.withColumn("rank", F.row_number().over(within) - 1).join(counts, ["length", "chunk"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long")).drop("before", "chunk")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece.

    A document's ids end with id 0; a null text is empty, so its only piece is that id.
    Documents longer than ``length`` are cut there. Repeated rows are packed each for itself.
    Only the histogram of lengths (at most ``length`` counts) reaches the driver, and only
    the pattern table made from it is sent to the tasks. An empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        rows = cut(pieces(docs, vocabulary, length))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    chunks = max(16, -(-sum(histogram.values()) // 200_000))
    table = slots(patterns(histogram, length))
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return ranked(rows, chunks).select(*columns).mapInArrow(_place(table), _PIECES + ", sequence_id long, offset long")
