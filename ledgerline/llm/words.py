"""Words of many texts at once, as spans of bytes with 64-bit hashes, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 512 << 10

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


class Kept(dict):
    """What a process has worked out; it does not travel with the functions that use it."""

    def __reduce__(self):
        return Kept, ()


_POWERS = Kept()

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    LETTER[_a:_b] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS.get("up", ())):
        size = max(n, BLOCK_BYTES + (1 << 16))
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            _POWERS[name] = np.cumprod(np.full(size, np.uint64(b)))
    return _POWERS["up"][:n], _POWERS["down"][:n]


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _MIX) | np.uint64(1)


def gram_hashes(a: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` bytes."""
    up, down = _powers(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    x = _BYTES[a]
    x *= up[: len(a)]
    np.cumsum(x, out=total[1:])
    h = total[width:] - total[:-width]
    h *= down[: len(h)]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


class Block:
    """Texts laid end to end: ``a`` their bytes, ``doc``, ``start`` and ``end`` of each word."""

    def __init__(self, raw: Sequence[bytes], inside: np.ndarray):
        self.n = len(raw)
        self.sizes = np.array([len(r) for r in raw], np.int64)
        a = self.a = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        word = np.concatenate([[False], inside[a], [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.concatenate([[0], np.cumsum(self.sizes + 1)])[:-1]
        self.doc = np.searchsorted(self.first, self.start, side="right") - 1
        self.words = np.bincount(self.doc, minlength=self.n)
        up, self._down = _powers(len(a) + 1)
        self._sum = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[a] * up[: len(a)])])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span, wherever it stands."""
        return mix((self._sum[end] - self._sum[start]) * self._down[start])


def encoded(texts: Sequence[str] | pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, a few at a time out of an Arrow array."""
    if isinstance(texts, pa.Array):
        for i in range(0, len(texts), 100):
            yield from (x or b"" for x in texts.slice(i, 100).cast(pa.binary()).to_pylist())
    else:
        for t in texts:
            yield t.encode("utf-8", "surrogatepass")


def blocks(texts: Sequence[str] | pa.Array, inside: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[slice, Block]]:
    """Runs of texts of about ``limit`` bytes (one text at least), as (which, block)."""
    first, size, held = 0, 0, []
    for raw in encoded(texts):
        if held and size + len(raw) >= limit:
            yield slice(first, first + len(held)), Block(held, inside)
            first, size, held = first + len(held), 0, []
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield slice(first, first + len(held)), Block(held, inside)


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def segments(raw: bytes, limit: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A text in parts of about ``limit`` bytes that end at ASCII white space, so no word is cut."""
    at = 0
    while len(raw) - at > limit:
        gap = _GAP.search(raw, at + limit)
        if gap is None:
            break
        yield raw[at : gap.start()]
        at = gap.end()
    yield raw[at:] if at else raw


def sliced(batches: Iterator[pa.RecordBatch], column: int, rows: int = 200, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``rows`` rows and about ``size`` bytes of a column: what Python makes of them is many times as large."""
    for batch in batches:
        first, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > first and (held + n > size or i - first == rows):
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if batch.num_rows > first:
            yield batch.slice(first)
