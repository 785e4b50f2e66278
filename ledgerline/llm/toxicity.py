"""Toxicity: a linear classifier with a counterfactual penalty on identity terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body
from .labels import fold, sample
from .words import LETTER, Block, blocks, mix

SLOTS = 1 << 18
TRAIN_ROWS = 8_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
CHI = 14.0  # what a feature's chi-square with the label must reach

#: Groups of terms that may stand for each other; the first of each is the neutral one.
IDENTITY = (
    ("people", "women", "men", "girls", "boys", "gay", "lesbian", "straight", "trans"),
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("people", "black", "white", "asian", "african", "european", "latino", "immigrants", "refugees"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "schwarze", "weiße", "flüchtlinge"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "noirs", "blancs", "immigrés"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "negros", "blancos", "inmigrantes"),
)


def word_features(b: Block) -> np.ndarray:
    """Slots of each word: of the whole word and of its first bytes."""
    rows = [b.hashes(b.start, b.end)]
    for n in PREFIXES:
        rows.append(mix(b.hashes(b.start, np.minimum(b.end, b.start + n)) + np.uint64(n)))
    return (np.stack(rows) >> np.uint64(46)).astype(np.int64)


def swaps(identity: Sequence[Sequence[str]]) -> dict[str, list[str]]:
    """What replaces each term: the next of its groups and their neutral ones."""
    out: dict[str, set[str]] = {}
    for group in identity:
        for i, term in enumerate(group):
            out.setdefault(term, set()).update({group[(i + 1) % len(group)], group[0]} - {term})
    return {term: sorted(others) for term, others in out.items()}


def unique_slots(b: Block) -> list[np.ndarray]:
    """The distinct slots of each text."""
    found = np.unique((b.doc[None] * SLOTS + word_features(b)).ravel())
    cuts = np.searchsorted(found, np.arange(b.n + 1) * SLOTS)
    return [(found[cuts[i] : cuts[i + 1]] % SLOTS).astype(np.int32) for i in range(b.n)]


def counterfactuals(b: Block, identity: Sequence[Sequence[str]]) -> tuple[list[int], list[bytes]]:
    """(text, the text with one of its terms replaced wherever it stands), for each swap."""
    others = swaps(identity)
    raw = {t: t.lower().encode() for t in others}
    known = {int(Block([r], LETTER).hashes(np.array([0]), np.array([len(r)]))[0]): t for t, r in raw.items()}
    h = b.hashes(b.start, b.end)
    held: dict[tuple[int, str], list[int]] = {}
    for i in np.flatnonzero(np.isin(h, np.array(sorted(known), np.uint64))).tolist():
        held.setdefault((int(b.doc[i]), known[int(h[i])]), []).append(i)
    who, texts, data = [], [], b.a.tobytes()
    for (doc, term), at in held.items():
        begin, end = int(b.first[doc]), int(b.first[doc] + b.sizes[doc])
        for other in others[term]:
            parts, last = [], begin
            for i in at:
                parts += [data[last : b.start[i]], raw[other]]
                last = int(b.end[i])
            who.append(doc)
            texts.append(b"".join([*parts, data[last:end]]))
    return who, texts


def _examples(identity: Sequence[Sequence[str]]):
    """Labelled texts: their slots, and for each swap what it takes from them and adds."""
    kind = pa.list_(pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_pylist()
            for which, b in blocks(batch.column("text"), LETTER):
                own = unique_slots(b)
                lost: list[list] = [[] for _ in own]
                gained: list[list] = [[] for _ in own]
                who, texts = counterfactuals(b, identity)
                for i, text in zip(who, texts, strict=True):
                    new = unique_slots(Block([text], LETTER))[0]
                    lost[i].append(np.setdiff1d(own[i], new))
                    gained[i].append(np.setdiff1d(new, own[i]))
                yield pa.RecordBatch.from_arrays([pa.array(y[which], pa.int32()), pa.array(own, pa.list_(pa.int32())), pa.array(lost, kind), pa.array(gained, kind)], names=["y", "slots", "lost", "gained"])

    return run


EXAMPLE = "y int, slots array<int>, lost array<array<int>>, gained array<array<int>>"


class Examples:
    """Labelled texts as flat arrays: ``who`` and ``slot`` of each feature; of each swap the text
    ``row`` it is of and, in ``swap``, ``changed`` and ``sign``, the slots it takes (-1) and adds (1)."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        n = rows.num_rows
        self.y = np.asarray(rows.column("y").combine_chunks(), np.float64) if n else np.empty(0)
        flat = lambda c: np.asarray(c.flatten(), np.int64)
        sizes = lambda c: np.asarray([len(x) for x in c] if len(c) else [], np.int64)
        column = lambda name: rows.column(name).combine_chunks()
        self.who, self.slot = (np.repeat(np.arange(n), sizes(column("slots"))), flat(column("slots"))) if n else (np.empty(0, int), np.empty(0, int))
        self.row = np.repeat(np.arange(n), sizes(column("lost"))) if n else np.empty(0, int)
        parts = [(column(c).flatten(), s) for c, s in (("lost", -1.0), ("gained", 1.0))] if n else []
        self.swap = np.concatenate([np.empty(0, int), *(np.repeat(np.arange(len(c)), sizes(c)) for c, _ in parts)])
        self.changed = np.concatenate([np.empty(0, int), *(flat(c) for c, _ in parts)])
        self.sign = np.concatenate([np.empty(0), *(np.full(len(flat(c)), s) for c, s in parts)])

    def only(self, kept: np.ndarray) -> None:
        """Forget the slots that ``kept`` does not mark."""
        self.who, self.slot = self.who[kept[self.slot]], self.slot[kept[self.slot]]
        use = kept[self.changed]
        self.swap, self.changed, self.sign = self.swap[use], self.changed[use], self.sign[use]


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def loss(w: np.ndarray, bias: float, x: Examples, strength: float) -> tuple[float, np.ndarray, float]:
    """(loss, its gradient by weight, by bias): mean log loss plus ``strength`` times the mean
    squared change of the score over the swaps, in chance and in log odds. The chance alone
    would not show what a term does in texts that are certain without it.
    """
    n, swaps_ = len(x.y), len(x.row)
    logit = np.bincount(x.who, w[x.slot], minlength=n) + bias
    p = _chance(logit)
    total = -np.mean(x.y * np.log(p) + (1 - x.y) * np.log1p(-p))
    g, grad = (p - x.y) / n, np.zeros(len(w))
    if swaps_:
        swing = np.bincount(x.swap, x.sign * w[x.changed], minlength=swaps_)
        other = _chance(logit[x.row] + swing)
        gap = p[x.row] - other
        total += strength * np.mean(gap**2 + swing**2)
        slope = 2 * strength / swaps_ * gap
        of_other = -slope * other * (1 - other)
        g = g + np.bincount(x.row, slope * (p * (1 - p))[x.row] + of_other, minlength=n)
        grad += np.bincount(x.changed, x.sign * (of_other + 2 * strength / swaps_ * swing)[x.swap], minlength=len(w))
    return float(total), grad + np.bincount(x.slot, g[x.who], minlength=len(w)), float(g.sum())


def train(x: Examples, strength: float = 4.0, rounds: int = 200, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on ``loss``.

    The counterfactual penalty is on labelled texts whose identity terms were replaced and whose
    features were worked out anew. Only features that at least three texts hold and whose
    chi-square with the label reaches ``CHI`` get a weight; ``decay`` is the penalty on the
    weights' squares.
    """
    y, w = x.y, np.zeros(SLOTS)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.1
        return w, float(np.log(share / (1 - share)))
    held, held_bad, share = np.bincount(x.slot, minlength=SLOTS), np.bincount(x.slot, y[x.who], minlength=SLOTS), y.mean()
    odd = (held_bad - held * share) ** 2 / np.maximum(held * share * (1 - share), 1e-9)
    common = (held >= 3) & (odd >= CHI)
    x.only(common)
    m1, m2, b1, b2 = np.zeros(SLOTS), np.zeros(SLOTS), 0.0, 0.0
    bias = float(np.log(share / (1 - share)))
    for step in range(1, rounds + 1):
        _, grad, gb = loss(w, bias, x, strength)
        grad += decay * w / max(common.sum(), 1)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m1 / a) / (np.sqrt(m2 / c) + 1e-4)
        bias -= rate * (b1 / a) / (np.sqrt(b2 / c) + 1e-4)
    return w, bias


def scores(texts: Sequence[str], w: np.ndarray, bias: float) -> np.ndarray:
    out = np.empty(len(texts))
    for which, b in blocks(texts, LETTER):
        slots = word_features(b)
        key = (b.doc[None] * SLOTS + slots)[w[slots] != 0]
        found = np.unique(key)
        logit = np.bincount(found // SLOTS, w[found % SLOTS], minlength=b.n) + bias
        out[which] = _chance(logit)
    return out


def fitted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, identity: Sequence[Sequence[str]] = IDENTITY):
    """A column function text -> score, learned from at most ``train_rows`` labelled rows
    whose fold is not the held-out one."""
    rows = sample(docs, labels, "toxic", fold(4) != 2, train_rows).select(F.lower("text").alias("text"), "y").mapInArrow(_examples(identity), EXAMPLE).toArrow()
    model = docs.sparkSession.sparkContext.broadcast(train(Examples(rows)))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(texts.tolist(), *model.value))

    return lambda text="text": score(F.lower(body(text)))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    A null text is empty; an empty text scores by the bias. Whole texts are scored, however
    long. A null id is not held out; repeated rows are scored each for itself. Without labels
    of both kinds every text gets the base rate; an empty table gives no rows. Only text is
    looked at for a score; other columns, of whatever name, are not.
    """
    score = fitted(docs, labels, train_rows)
    rows = docs.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), score().alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def civil(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Null and empty texts score by the bias as in ``toxicity`` and stay while that is low;
    repeated rows stay or go together.
    """
    score = fitted(docs, labels, train_rows)
    return docs.where(score() < THRESHOLD)
