"""Quality: attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import body
from .labels import fold, sample
from .words import SPACE, Block, blocks

TRAIN_ROWS = 8_000
PASSAGE = 48  # words
HASHED = 24
THRESHOLD = 0.3
HIDDEN, GATE = 24, 12

_UPPER, _DIGIT, _PUNCT, _ODD, _HIGH, _ALPHA, _STOP = (np.zeros(256, bool) for _ in range(7))
_UPPER[65:91] = _DIGIT[48:58] = _HIGH[128:] = True
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_ODD[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_STOP[[ord(c) for c in ".,!?;:"]] = True
STATS = 15
WIDTH = STATS + HASHED


def passages(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``WIDTH`` numbers for each passage of a block, and the text it is of.

    A text without words has one passage of zeros.
    """
    n_words = b.words
    per = np.maximum(-(-n_words // PASSAGE), 1)
    base = np.concatenate([[0], np.cumsum(per)])
    total = int(base[-1])
    own = np.repeat(np.arange(b.n), per)
    x = np.zeros((total, WIDTH))
    if not len(b.start):
        return x, own
    order = np.arange(len(b.start)) - (np.cumsum(n_words) - n_words)[b.doc]
    at = base[b.doc] + order // PASSAGE
    words = np.bincount(at, minlength=total)
    length = (b.end - b.start).astype(float)
    size = np.bincount(at, length, minlength=total)

    def of_bytes(kind: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(kind[b.a])])
        return run[b.end] - run[b.start]

    share = lambda v, by: np.bincount(at, v, minlength=total) / np.maximum(by, 1)
    for k, kind in enumerate((_UPPER, _DIGIT, _PUNCT, _ODD, _HIGH)):
        x[:, k] = share(of_bytes(kind), size)
    mean = size / np.maximum(words, 1)
    x[:, 5] = mean / 10
    x[:, 6] = np.sqrt(np.maximum(share(length**2, words) - mean**2, 0)) / 10
    h = b.hashes(b.start, b.end)
    pairs = np.lexsort((h, at))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[pairs][1:] != h[pairs][:-1]) | (at[pairs][1:] != at[pairs][:-1])
    x[:, 7] = np.bincount(at[pairs], fresh, minlength=total) / np.maximum(words, 1)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (b.doc[1:] == b.doc[:-1])
    x[:, 8] = share(again, words)
    x[:, 9] = share(_STOP[b.a[b.end - 1]], words)
    x[:, 10] = share(of_bytes(_ALPHA) == 0, words)
    x[:, 11] = share(length <= 3, words)
    x[:, 12] = share(of_bytes(_ODD) > 0, words)
    x[:, 13] = np.log1p(words) / 4
    x[:, 14] = np.log1p(n_words)[own] / 10
    slot = (h >> np.uint64(40)).astype(np.int64) % HASHED
    sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(float)
    x[:, STATS:] = np.bincount(at * HASHED + slot, sign, minlength=total * HASHED).reshape(total, HASHED) / np.sqrt(np.maximum(words, 1))[:, None] / 4
    return x, own


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, y = (batch.column(n).to_pylist() for n in ("doc_id", "y"))
        for which, b in blocks(batch.column("text"), ~SPACE):
            x, own = passages(b)
            cuts = np.searchsorted(own, np.arange(b.n + 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[which], pa.int64()), pa.array(y[which], pa.int32()), pa.array([x[cuts[i] : cuts[i + 1]].astype(np.float32).tobytes() for i in range(b.n)], pa.binary())], names=["doc_id", "y", "bag"])


def forward(x: np.ndarray, own: np.ndarray, n: int, m: dict[str, np.ndarray]) -> tuple:
    """Encoded passages, gates, attention (a softmax within each text) and logits."""
    z = (x - m["mean"]) / m["scale"]
    h = np.tanh(z @ m["W"] + m["w0"])
    t, s = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * s) @ m["a"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, own, e)
    e = np.exp(e - top[own])
    att = e / np.bincount(own, e, minlength=n)[own]
    first = np.searchsorted(own, np.arange(n))
    bag = np.add.reduceat(att[:, None] * h, first, axis=0)
    return z, h, t, s, att, bag, bag @ m["c"] + m["c0"], first


def gradients(x: np.ndarray, own: np.ndarray, y: np.ndarray, m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the mean log loss of ``y``, by each array of the model."""
    z, h, t, s, att, bag, logit, first = forward(x, own, len(y), m)
    g = (1 / (1 + np.exp(-logit)) - y) / len(y)
    d_bag = g[:, None] * m["c"]
    d_att = (d_bag[own] * h).sum(1)
    d_e = att * (d_att - np.add.reduceat(att * d_att, first)[own])
    d_t, d_s = d_e[:, None] * m["a"] * s * (1 - t * t), d_e[:, None] * m["a"] * t * s * (1 - s)
    d_h = att[:, None] * d_bag[own] + d_t @ m["V"].T + d_s @ m["U"].T
    d_z = d_h * (1 - h * h)
    return {"W": z.T @ d_z, "w0": d_z.sum(0), "V": h.T @ d_t, "U": h.T @ d_s, "a": (t * s).T @ d_e, "c": bag.T @ g, "c0": np.array([g.sum()])}


def train(y: np.ndarray, bags: list[np.ndarray], epochs: int = 15, batch: int = 128, rate: float = 5e-3, decay: float = 1e-4, seed: int = 7) -> dict[str, np.ndarray]:
    """Gated attention by Adam on log loss of document labels."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    m = {"W": draw(WIDTH, HIDDEN), "w0": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(GATE), "c": draw(HIDDEN), "c0": np.zeros(1)}
    fixed = {"mean": np.zeros(WIDTH), "scale": np.ones(WIDTH)}
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return m | fixed | {"c": np.zeros(HIDDEN), "c0": np.array([np.log(share / (1 - share))])}
    every = np.concatenate(bags)
    fixed = {"mean": every.mean(0), "scale": every.std(0) + 1e-2}
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            pick = order[i : i + batch]
            x, own = np.concatenate([bags[j] for j in pick]), np.repeat(np.arange(len(pick)), [len(bags[j]) for j in pick])
            grads = gradients(x, own, y[pick], m | fixed)
            step += 1
            for k, grad in grads.items():
                a, b = mom[k]
                grad = grad + decay * m[k]
                a += 0.1 * (grad - a)
                b += 0.01 * (grad * grad - b)
                m[k] = m[k] - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return m | fixed


def scores(texts: Sequence[str], m: dict[str, np.ndarray]) -> np.ndarray:
    out = np.empty(len(texts))
    for which, b in blocks(texts, ~SPACE):
        x, own = passages(b)
        logit = forward(x, own, b.n, m)[6]
        out[which] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return out


def fitted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """A column function text -> score, learned from at most ``train_rows`` labelled rows
    whose fold is not the held-out one."""
    rows = sample(docs, labels, "quality", fold(5) != 0, train_rows).select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(_bags, "doc_id long, y int, bag binary").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(np.float64) for x in rows.column("bag").to_pylist()]
    model = docs.sparkSession.sparkContext.broadcast(train(np.array(rows.column("y").to_pylist(), np.float64), bags))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(texts.tolist(), model.value))

    return lambda text="text": score(body(text))


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    A null text is empty; a text without words is one passage of zeros; of a long text every
    passage counts. A null id is not held out; repeated rows are scored each for itself.
    Without labels of both kinds every text gets the base rate; an empty table gives no rows.
    Only text is looked at for a score; other columns, of whatever name, are not.
    """
    score = fitted(docs, labels, train_rows)
    rows = docs.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), score().alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
