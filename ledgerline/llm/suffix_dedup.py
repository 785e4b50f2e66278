"""Removal of repeated byte strings: difference-cover suffix sorting, dealt out by anchors.

Every string of ``length`` bytes has an anchor: the k-gram in it whose hash is smallest.
Equal strings have equal anchors at equal places, so only texts around an anchor that
occurs twice can hold a repeat, and all that must be compared meets under the anchor's
name. Under a name the suffixes are sorted by the difference-cover algorithm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, body, cut, drop, hot_join, partitions, scratch
from .words import gram_hashes

LENGTH = 400
GRAM = 32
PART = 512 << 10  # bytes of a text that are looked through at once
SORTED_BYTES = 800_000  # that one suffix sort takes at most; a rank then has 21 bits
STRINGS = 200_000  # that one task counts or compares by digest
SPLITS = 2  # rounds of further anchors under a name that is too large for one sort
OFTEN = 100_000  # k-grams that a round broadcasts at most
BATCH_BYTES = 100_000  # that one takes if no single name needs more: it stays in a core's cache
_POS = np.uint64((1 << 24) - 1)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of ``width`` values."""
    n = len(x)
    pad = -n % width
    y = np.concatenate([x, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def served(h: np.ndarray, names: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first string, strings, joined) of the anchors of one text whose k-grams have hashes ``h``.

    ``joined``: the anchor stands for several places of its k-gram, so it can hold a string twice by itself.
    """
    key = h & ~_POS
    key |= np.arange(len(h), dtype=np.uint64)
    owner = sliding_minimum(key, width)
    first = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    first = np.concatenate([[0], first])
    name = names[(owner[first] & _POS).astype(np.int64)]
    new = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    joined = np.diff(np.append(new, len(name))) > 1
    first, name = first[new], name[new]
    count = np.diff(np.append(first, len(owner)))
    pieces = -(-count // width)
    of = np.repeat(np.arange(len(first)), pieces)
    skipped = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * width
    return name[of], first[of] + skipped, np.minimum(count[of] - skipped, width), joined[of]


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first string, strings, joined) of each anchor of one text.

    The strings whose anchor has that name start at ``first string`` and at the ``strings`` - 1
    places after it. Neighbours whose anchors have one name stay together, up to as many as one
    anchor can serve, so text that repeats every few bytes gives no more anchors than other
    text. Long texts go through in parts that overlap.
    """
    out = []
    width = length - gram + 1
    for base in range(0, max(len(raw) - length + 1, 0), PART):
        piece = raw[base : base + PART + length - 1]
        h = gram_hashes(np.frombuffer(piece, np.uint8), gram)
        name, first, count, joined = served(h, h, width)
        out.append((name, first + base, count, joined))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 100) -> Iterator[pa.RecordBatch]:
    """A few rows at a time: what Python makes of them is many times as large."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _find(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, 200):
            found = [anchors(x.as_buffer().to_pybytes(), length) for x in part.column("raw")]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]), pa.int32())
            names, firsts, counts, joined = (np.concatenate(x) for x in zip(*found, strict=True))
            each = pa.StructArray.from_arrays([pa.array(names.view(np.int64)), pa.array(firsts.astype(np.int32)), pa.array(counts.astype(np.int32)), pa.array(joined)], names=["name", "first", "n", "joined"])
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("doc_id"), pa.ListArray.from_arrays(offsets, each)], names=["node", "doc_id", "anchors"])

    return run


def _contexts(length: int):
    """The bytes around each anchor that all its strings cover."""
    names = ["node", "first", "name", "key", "ctx"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for part in _sliced(batches):
            found = part.column("found")
            anchor, cuts = found.flatten(), np.cumsum([0, *(len(x) for x in found)])
            name, first, count = (np.asarray(anchor.field(x)).tolist() for x in ("name", "first", "n"))
            for i, (node, raw) in enumerate(zip(part.column("node").to_pylist(), part.column("raw"), strict=True)):
                raw = raw.as_buffer().to_pybytes()
                for k in range(cuts[i], cuts[i + 1]):
                    ctx = raw[first[k] : first[k] + count[k] + length - 1]
                    rows.append((node, first[k], name[k], hashlib.md5(ctx).digest(), ctx))
                    if len(rows) == 2000:
                        yield made(rows)
                        rows = []
        if rows:
            yield made(rows)

    return run


def ranks(s: np.ndarray, depth: int, covers: int = 1) -> np.ndarray:
    """A place for each suffix in the order of suffixes, by the difference cover {1, 2} mod 3.

    The triples at the sampled places are sorted and named; the names' string is sorted the
    same way, unless all names differ or already stand for ``depth`` symbols; then the
    suffixes at the other places are sorted by a symbol and the rank after it, and merged in.
    Suffixes that agree on ``depth`` symbols are neighbours; their order is open.
    """
    n = len(s)
    if n < 6:
        t = np.concatenate([s, np.zeros(n, np.int64)])
        order = sorted(range(n), key=lambda i: tuple(t[i : i + n]))
        out = np.empty(n, np.int64)
        out[order] = np.arange(n)
        return out
    t = np.concatenate([s, np.zeros(4, np.int64)])
    bits = int(max(int(t.max()), n + 2)).bit_length()
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    key = (t[sample] << (2 * bits)) | (t[sample + 1] << bits) | t[sample + 2]
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if new.sum() < len(sample) and covers * 3 < depth:
        order = np.argsort(ranks(names, depth, covers * 3))
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    place = np.empty(len(sample), np.int64)  # among the sampled, without ties
    place[order] = np.arange(len(sample))
    # Everything is looked up in sorted order, which stays in cache.
    one, two = sample[order[order < len(one)]], sample[order[order >= len(one)]]
    at = np.empty(n + 1, np.int64)
    at[sample] = place

    zero = np.arange(0, n, 3)
    key_a = (t[zero] << bits) | rank[zero + 1]
    z = np.argsort(key_a)
    key_a, zero = key_a[z], zero[z]
    key_b = (t[zero] << (2 * bits)) | (t[zero + 1] << bits) | rank[zero + 2]
    own_a = (t[one] << bits) | rank[one + 1]
    own_b = (t[two] << (2 * bits)) | (t[two + 1] << bits) | rank[two + 2]
    out = np.empty(n + 1, np.int64)
    out[zero] = np.arange(len(zero)) + np.searchsorted(np.sort(own_a), key_a) + np.searchsorted(np.sort(own_b), key_b)
    out[one] = at[one] + np.searchsorted(key_a, own_a, side="right")
    out[two] = at[two] + np.searchsorted(np.sort(key_b), own_b, side="right")
    return out[:n]


def repeated(contexts: list[bytes], times: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, which of its strings of ``length`` bytes occur twice among all.

    A context that occurs twice itself counts as all of its strings do.
    """
    sizes = np.array([len(c) for c in contexts])
    a = np.frombuffer(b"\0".join([*contexts, bytes(length + 8)]), np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    strings = sizes - length + 1
    s = a[: int(first[-1] + sizes[-1])].astype(np.int64) + 1
    s[first[1:] - 1] = 0
    starts = np.repeat(first, strings) + np.arange(int(strings.sum())) - np.repeat(np.cumsum(strings) - strings, strings)
    # In suffix order equal strings are neighbours.
    at = starts[np.argsort(ranks(s, length)[starts])]
    word = np.ndarray((len(a) - 7,), np.uint64, a.tobytes(), strides=(1,))
    left, right = at[:-1], at[1:]
    alive = np.arange(len(left))
    for k in [*range(0, length - 7, 8), length - 8]:
        alive = alive[word[left[alive] + k] == word[right[alive] + k]]
    hit = np.zeros(len(a), bool)
    hit[left[alive]] = hit[right[alive]] = True
    return [hit[f : f + n] | (t > 1) for f, n, t in zip(first.tolist(), strings.tolist(), times.tolist(), strict=True)]


def _has_twice(ctx: bytes) -> bool:
    h = gram_hashes(np.frombuffer(ctx, np.uint8), GRAM)
    return len(np.unique(h)) < len(h)


def _sorted(length: int):
    """Contexts come by name; whole names are sorted together, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, int]] = []  # whole names
        alone: list[tuple[bytes, bytes, int]] = []  # the only surroundings of their name
        group: list[tuple[bytes, bytes, int]] = []  # the name that comes
        name, size, group_size = None, 0, 0

        def solved(rows):
            return made(rows, repeated([r[1] for r in rows], np.array([r[2] for r in rows]), length))

        def made(rows, bits):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([np.packbits(x).tobytes() for x in bits], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["key", "bits", "times"])

        def closed():
            nonlocal size, group_size
            # One that stands alone but occurs twice needs no sort; all its strings do. One that
            # occurs once has no string twice if it has no k-gram twice.
            if len(group) == 1 and group[0][2] > 1:
                alone.append(group[0])
            elif len(group) != 1 or _has_twice(group[0][1]):
                held.extend(group)
                size += group_size
            group.clear()
            group_size = 0

        for part in _sliced(batches, 500):
            c = part.to_pydict()
            for x, key, ctx, n in zip(c["name"], c["key"], c["ctx"], c["times"], strict=True):
                if x != name:
                    closed()
                    name = x
                    if size > BATCH_BYTES:
                        yield solved(held)
                        held.clear()
                        size = 0
                    if len(alone) > 500:
                        yield made(alone, [np.ones(len(r[1]) - length + 1, bool) for r in alone])
                        alone.clear()
                group.append((key, ctx, n))
                group_size += len(ctx) + 1
        closed()
        if held:
            yield solved(held)
        if alone:
            yield made(alone, [np.ones(len(r[1]) - length + 1, bool) for r in alone])

    return run


def _digests(part: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest, context, place in it, times) of each string of some contexts."""
    contexts = part.column("ctx").to_pylist()
    n = [len(c) - length + 1 for c in contexts]
    found = np.frombuffer(b"".join(hashlib.md5(c[o : o + length]).digest() for c, k in zip(contexts, n, strict=True) for o in range(k)), "V16")
    own = np.repeat(np.arange(len(n)), n)
    return found, own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n), np.asarray(part.column("times"))[own]


def _by_part(found: np.ndarray, parts: int, use: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """The strings to ``use`` by part of their digests' range: the part, and each column's bytes there."""
    to = (np.ascontiguousarray(found).view(np.uint64)[:: found.itemsize // 8] % np.uint64(parts)).astype(np.int64)
    to[~use] = parts
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    return [pa.array(full), *(pa.array([x[order[cuts[p] : cuts[p + 1]]].tobytes() for p in full], pa.binary()) for x in (found, *columns))]


def _counted(of: Callable[[pa.RecordBatch], np.ndarray], parts: int):
    """How often each string is there, added up for some contexts at a time and packed by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, 200):
            string, n = np.unique(of(part), return_counts=True)
            yield pa.RecordBatch.from_arrays(_by_part(string, parts, np.ones(len(n), bool), n), names=["part", "string", "n"])

    return run


def _above(least: int, kind: str):
    """The strings of a part that are there more than ``least`` times."""

    def run(table: pa.Table) -> pa.Table:
        found, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("string", kind), ("n", np.int64)))
        string, of = np.unique(found, return_inverse=True)
        return pa.table({"string": pa.array([x.tobytes() for x in string[np.bincount(of, n) > least]], pa.binary())})

    return run


def _frequent(wide: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], kind: str, parts: int, least: int) -> np.ndarray:
    """What ``of`` finds in contexts more than ``least`` times in all; the caller bounds how many that can be."""
    often = wide.mapInArrow(_counted(of, parts), "part long, string binary, n binary").groupBy("part").applyInArrow(_above(least, kind), "string binary").toArrow()
    return np.sort(np.frombuffer(b"".join(often.column("string").to_pylist()), kind))


def _marks(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the k-grams of some contexts, another order under every name, and how many each has."""
    names = np.asarray(part.column("name")).view(np.uint64)
    each = [gram_hashes(np.frombuffer(c, np.uint8), GRAM) for c in part.column("ctx").to_pylist()]
    sizes = np.array([len(h) for h in each])
    h = np.concatenate(each) ^ np.repeat(names, sizes)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    return h, sizes


def _split(length: int, hot: np.ndarray):
    """The strings of contexts under further anchors: of the k-grams that are not hot, that of smallest hash.

    Strings of hot k-grams only stay together under their name.
    """
    names = ["whole", "whole_times", "at", "name", "key", "ctx"]
    types = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, 200):
            rows: list[tuple] = []
            h, sizes = _marks(part)
            is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
            name = np.where(is_hot, np.repeat(np.asarray(part.column("name")).view(np.uint64), sizes), h)
            h[is_hot] = ~np.uint64(0)
            cuts = np.cumsum([0, *sizes])
            for i, (key, ctx, times) in enumerate(zip(*(part.column(c).to_pylist() for c in ("key", "ctx", "times")), strict=True)):
                mine = slice(cuts[i], cuts[i + 1])
                for own, first, n, _ in zip(*(x.tolist() for x in served(h[mine], name[mine].view(np.int64), length - GRAM + 1)), strict=True):
                    sub = ctx[first : first + n + length - 1]
                    rows.append((key, times, first, own, hashlib.md5(sub).digest(), sub))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where in its context the repeated strings of a part of it stand."""
    for part in _sliced(batches, 1000):
        at = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))) + a for b, a in zip(part.column("bits").to_pylist(), part.column("at").to_pylist(), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) for x in at)]), pa.int32()), pa.array(np.concatenate(at).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([part.column("whole"), lists, part.column("whole_times")], names=["key", "at", "times"])


def _by_key(own: np.ndarray, at: np.ndarray, times: np.ndarray, key) -> pa.RecordBatch:
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, int)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(own)), pa.int32()), pa.array(at.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array([key(i) for i in own[first].tolist()], pa.binary()), lists, pa.array(times[first].astype(np.int64))], names=["key", "at", "times"])


def _places(length: int, hot: np.ndarray):
    """Where contexts hold the strings that most contexts hold; those are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, 200):
            found, own, at, times = _digests(part, length)
            hit = np.isin(found, hot)
            yield _by_key(own[hit], at[hit], times[hit], part.column("key").to_pylist().__getitem__)

    return run


def _dealt(length: int, hot: np.ndarray, parts: int):
    """The other strings by part of the digests' range, packed: a row has some contexts' strings of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, 200):
            found, own, at, times = _digests(part, length)
            keys = np.frombuffer(b"".join(part.column("key").to_pylist()), "V16")
            yield pa.RecordBatch.from_arrays(_by_part(found, parts, ~np.isin(found, hot), keys[own], at.astype(np.int32), times), names=["part", "string", "keys", "at", "times"])

    return run


def _twice(table: pa.Table) -> pa.Table:
    """Of the strings of a part, where those stand that are there twice."""
    column = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    found, keys, at, times = column("string", "V16"), column("keys", "V16"), column("at", np.int32), column("times", np.int64)
    _, of = np.unique(found, return_inverse=True)
    hit = np.flatnonzero(np.bincount(of, times)[of] > 1)
    key, own = np.unique(keys[hit], return_inverse=True)
    order = np.argsort(own, kind="stable")
    return pa.Table.from_batches([_by_key(own[order], at[hit[order]], times[hit[order]], key.tolist().__getitem__)])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which strings of a context are repeated, from their places."""
    for part in _sliced(batches, 1000):
        bits = []
        for at in part.column("at"):
            at = np.asarray(at.values)
            x = np.zeros(int(at.max(initial=0)) + 1, bool)
            x[at] = True
            bits.append(np.packbits(x).tobytes())
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(bits, pa.binary()), part.column("times")], names=["key", "bits", "times"])


def _runs(length: int):
    """Byte spans that the repeated strings of an occurrence cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _sliced(batches, 2000):
            nodes, firsts, bits = (part.column(c).to_pylist() for c in ("node", "first", "bits"))
            own, start, end = [], [], []
            for node, first, b in zip(nodes, firsts, bits, strict=True):
                x = np.concatenate([[0], np.unpackbits(np.frombuffer(b, np.uint8)), [0]]).astype(np.int8)
                edge = np.flatnonzero(x[1:] != x[:-1])
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    own.append(node)
                    start.append(first + s)
                    end.append(first + e - 1 + length)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["node", "s", "e"])

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _sliced(batches):
        removed, count, kept = [], [], []
        for raw, all_, spans in zip(part.column("raw"), part.column("all").to_pylist(), part.column("spans").to_pylist(), strict=True):
            raw = raw.as_buffer().to_pybytes()
            parts, at, gone, n = [], 0, 0, 0
            last = -1
            for x in [{"s": 0, "e": len(raw)}] if all_ else spans or ():
                if x["s"] > last:
                    n += 1
                if x["s"] > at:
                    parts.append(raw[at : x["s"]])
                gone += max(0, x["e"] - max(at, x["s"]))
                at = last = max(at, x["e"])
            parts.append(raw[at:])
            removed.append(gone)
            count.append(n)
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.binary()), part.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(count, pa.int64())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])


WHERE = "key binary, at array<int>, times long"


def by_digest(wide: DataFrame, total: int, length: int) -> DataFrame:
    """key, at, times: where strings stand that ``wide`` holds twice, told by the digests of its ``total`` strings."""
    parts = max(1, -(-total // STRINGS))
    often = _frequent(wide, lambda part: _digests(part, length)[0], "V16", parts, max(total // HOT, 1))
    return wide.mapInArrow(_places(length, often), WHERE).unionByName(wide.mapInArrow(_dealt(length, often, parts), "part long, string binary, keys binary, at binary, times binary").groupBy("part").applyInArrow(_twice, WHERE))


def by_further_anchors(wide: DataFrame, total: int, length: int, splits: int) -> DataFrame:
    """key, at, times: where strings stand that ``wide`` holds twice, told under a second anchor.

    A k-gram that is there more often than one sort bears is hot and serves no string that has another one,
    so what comes under an anchor fits, but for the strings that have hot k-grams only.
    """
    least = max(SORTED_BYTES // (2 * (2 * length - GRAM)), total // OFTEN)
    hot = _frequent(wide, lambda part: _marks(part)[0], "u8", max(1, -(-total // STRINGS)), least)
    path = scratch(wide.sparkSession, "split")
    wide.mapInArrow(_split(length, hot), "whole binary, whole_times long, at int, name long, key binary, ctx binary").write.option("compression", "zstd").parquet(path)
    under = wide.sparkSession.read.parquet(path)
    distinct = cut(under.groupBy("name", "key").agg(F.first("ctx").alias("ctx"), F.sum("whole_times").alias("times")))
    flags = judged(distinct, length, splits - 1)
    times = distinct.agg(F.sum("times")).first()[0]
    found = cut(hot_join(under.select("whole", "whole_times", "at", "key"), flags, "key", "times", times).mapInArrow(_moved, WHERE))
    drop(wide.sparkSession, path)
    return found


def judged(distinct: DataFrame, length: int, splits: int | None = None) -> DataFrame:
    """key, bits, times: which strings of each context are there twice under its name.

    Names that one sort can take are sorted. Larger ones are split by further anchors; what stays
    too large after ``splits`` rounds (strings of nothing but frequent k-grams) is told by digests.
    """
    splits = SPLITS if splits is None else splits
    large = cut(distinct.groupBy("name").agg(F.sum(F.octet_length("ctx") + 1).alias("size"), F.count("*").alias("k")).where(F.col("size") > SORTED_BYTES))
    flags = distinct.join(large, "name", "left_anti").repartition(partitions(distinct.sparkSession), "name").sortWithinPartitions("name").mapInArrow(_sorted(length), "key binary, bits binary, times long")
    if large.isEmpty():
        return flags
    wide = cut(hot_join(distinct, large.select("name", "k"), "name", "k", distinct.count(), "left_semi"))
    total = wide.agg(F.sum(F.octet_length("ctx") - (length - 1))).first()[0]
    at = by_further_anchors(wide, total, length, splits) if splits else by_digest(wide, total, length)
    at = at.groupBy("key").agg(F.flatten(F.collect_list("at")).alias("at"), F.first("times").alias("times"))
    return flags.unionByName(at.mapInArrow(_bits, "key binary, bits binary, times long"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans: a row per row of ``docs``.

    Each byte that lies in a string of ``length`` bytes which also starts anywhere else goes;
    strings never reach over a text's end, and all are judged on the input. Equal texts are
    one node: if there are two and they have ``length`` bytes, all of them goes. Anchors are
    counted over the nodes; the texts around those that are there twice, or that stand for several
    places of one text that repeats itself, are gathered under the anchor's
    name, equal surroundings once, and sorted by suffixes. A name with more different
    surroundings than one sort takes is split by further anchors (``judged``), so that no name
    is ever in one task; names, surroundings and texts that most rows have are joined by
    broadcast (``hot_join``). A null text is empty; very long texts go through in parts; a null
    doc_id and repeated rows are rows as any; an empty table gives no rows; other columns,
    of whatever name, are not looked at.
    """
    spark = docs.sparkSession
    text = F.encode(body(), "utf-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.alias("raw"), F.octet_length(text).cast("long").alias("n_bytes"))
    long_ = rows.where(F.col("n_bytes") >= length)
    found = long_.mapInArrow(_find(length), "node binary, doc_id long, anchors array<struct<name:long,first:int,n:int,joined:boolean>>")
    nodes = cut(found.groupBy("node").agg(F.min(F.struct("doc_id", "anchors")).alias("x"), F.count("*").alias("copies")).select("node", "x.doc_id", "x.anchors", "copies"))
    totals = nodes.agg(F.sum("copies").alias("rows"), F.sum(F.size("anchors")).alias("anchors")).first()
    each = nodes.select("node", F.explode("anchors").alias("a")).select("node", "a.name", "a.first", "a.n", "a.joined")
    twice = cut(each.groupBy("name").agg(F.count("*").alias("k"), F.max("joined").alias("joined")).where((F.col("k") > 1) | F.col("joined")).select("name", "k"))
    kept = hot_join(each, twice, "name", "k", totals["anchors"] or 0, "left_semi").groupBy("node").agg(F.collect_list(F.struct("name", "first", "n")).alias("found"))
    kept = kept.join(nodes.select("node", "doc_id"), "node").withColumnRenamed("doc_id", "id").withColumnRenamed("node", "key")
    texts = long_.join(kept, (long_["node"] == kept["key"]) & long_["doc_id"].eqNullSafe(kept["id"])).select("node", "raw", "found")
    path = scratch(spark, "contexts")
    texts.mapInArrow(_contexts(length), "node binary, first int, name long, key binary, ctx binary").write.option("compression", "zstd").parquet(path)
    around = spark.read.parquet(path)

    # One row of rows by (node, first) can be there twice only for repeated rows.
    distinct = around.dropDuplicates(["node", "first"]).groupBy("name", "key").agg(F.first("ctx").alias("ctx"), F.count("*").alias("times"))
    distinct = cut(distinct)
    flags = cut(judged(distinct, length))
    some = distinct.agg(F.sum("times").alias("times")).first()
    spans = cut(
        hot_join(around.select("node", "first", "key"), flags, "key", "times", some["times"] or 0).mapInArrow(_runs(length), "node binary, s long, e long")
        .groupBy("node").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
    )
    drop(spark, path)
    copied = nodes.where(F.col("copies") > 1).select("node", "copies", F.lit(True).alias("all"))
    marked = spans.join(copied, "node", "full").select("node", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("all", F.lit(False)).alias("all"), F.when(F.col("all").isNull(), F.col("spans")).alias("spans"))
    out = hot_join(long_, marked, "node", "copies", totals["rows"] or 0, "left").select("doc_id", "raw", F.coalesce("all", F.lit(False)).alias("all"), "spans", "n_bytes").mapInArrow(_cut_out, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
    zero = F.lit(0).cast("long")
    short = rows.where(F.col("n_bytes") < length).select("doc_id", F.col("raw").alias("kept"), "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"))
    return out.unionByName(short)


def repeat_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """without_repeats() with a digest in place of the remaining bytes."""
    return without_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
