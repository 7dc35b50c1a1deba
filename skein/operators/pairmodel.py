"""A second scorer that reads both texts of a pair: hashed terms that both have, or one alone, under a logistic layer learned in numpy.

It stands where a pretrained cross-encoder would, behind the same two functions: fit() on labelled pairs, logits() on any number of them.
Training is on the driver, on at most `limit` pairs in the order of a hash of their ids (whole queries are held out to choose the best
epoch); scoring runs in Arrow batches on the executors. Texts are read whole, in batches of similar length.

Edge cases: a null text is empty; a pair without any term has the logit of the bias; without labels of both classes every logit is that
of the smoothed share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import grouped_split

BUCKETS = 1 << 16


def terms(text: str | None) -> set[str]:
    """Words, and runs of three characters within the padded words."""
    words = set((text or "").split())
    return words | {w[i : i + 3] for w in (f" {w} " for w in words) for i in range(len(w) - 2)}


def buckets(a: str | None, b: str | None) -> np.ndarray:
    """Of each term of either text a bucket, which tells whether both have it, the first alone or the second alone."""
    x, y = terms(a), terms(b)
    kinds = ((x & y, 0), (x - y, 1), (y - x, 2))
    own = [zlib.crc32(t.encode("utf-8", "replace"), kind) % BUCKETS for some, kind in kinds for t in some]
    shared = [BUCKETS + kind for some, kind in kinds for _ in some]  # how many there are of each kind, whatever they say
    return np.array(own + shared, np.int64)


class PairModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def logits(self, a: Sequence, b: Sequence) -> np.ndarray:
        found = [buckets(x, y) for x, y in zip(a, b)]
        return np.array([self.bias + (float(self.weights[f].mean()) if len(f) else 0.0) for f in found])


def average_precision(y: np.ndarray, z: np.ndarray) -> float:
    order = np.argsort(-z, kind="stable")
    hit = y[order] > 0
    return float((np.cumsum(hit) / np.arange(1, len(y) + 1))[hit].mean()) if hit.any() else 0.0


def batches(lengths: np.ndarray, size: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Rows in batches of similar length, the batches in random order."""
    order = np.argsort(lengths + rng.random(len(lengths)), kind="stable")
    parts = [order[i : i + size] for i in range(0, len(order), size)]
    return (parts[i] for i in rng.permutation(len(parts)))


def train(found: list[np.ndarray], y: np.ndarray, dev: np.ndarray, epochs: int = 20, rate: float = 2.0, size: int = 64, pos_weight: float | None = None, seed: int = 0) -> PairModel:
    """AdaGrad on the weighted logistic loss; the epoch with the best average precision on the rows of dev is kept."""
    share = (y.sum() + 1) / (len(y) + 2)
    weights, bias = np.zeros(BUCKETS + 3), float(np.log(share / (1 - share)))
    fit = np.flatnonzero(~dev)
    if not len(fit) or y.min() == y.max():
        return PairModel(weights, bias)
    pos_weight = pos_weight if pos_weight is not None else min(10.0, float((y[fit] == 0).sum() / max(1, (y[fit] > 0).sum())))
    squares, rng, best = np.full(BUCKETS + 3, 1e-6), np.random.default_rng(seed), None
    logits = lambda rows, w, b: np.array([b + (w[found[i]].mean() if len(found[i]) else 0.0) for i in rows])
    judged = np.flatnonzero(dev) if dev.any() else fit
    for _ in range(epochs):
        for part in batches(np.array([len(found[i]) for i in fit]), size, rng):
            rows = fit[part]
            p = 1 / (1 + np.exp(-np.clip(logits(rows, weights, bias), -30, 30)))
            g = (p - y[rows]) * np.where(y[rows] > 0, pos_weight, 1.0) / len(rows)
            step = np.zeros(BUCKETS + 3)
            for i, gi in zip(rows, g):
                if len(found[i]):
                    np.add.at(step, found[i], gi / len(found[i]))
            squares += step * step
            weights -= rate * step / np.sqrt(squares)
            bias -= 0.1 * float(g.sum())
        ap = average_precision(y[judged], logits(judged, weights, bias))
        if best is None or ap > best[0]:
            best = (ap, weights.copy(), bias)
    return PairModel(*best[1:])


def fit(pairs: DataFrame, limit: int = 20_000, dev_share: float = 0.15, **how) -> PairModel:
    """A model of pairs (q, p, a_text, b_text, label)."""
    d = grouped_split(pairs.select("q", "p", "a_text", "b_text", "label"), "q", dev_share)
    rows = d.orderBy(F.xxhash64("q", "p"), "q", "p").limit(limit).collect()
    found = [buckets(r["a_text"], r["b_text"]) for r in rows]
    return train(found, np.array([float(r["label"]) for r in rows]), np.array([bool(r["held_out"]) for r in rows], bool), **how)


def with_logit(pairs: DataFrame, model: PairModel, out: str = "raw_logit") -> DataFrame:
    """(q, p, out) of pairs (q, p, a_text, b_text)."""
    held = pairs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(frames):
        m = PairModel(*held.value)
        for f in frames:
            yield f[["q", "p"]].assign(**{out: m.logits(f["a_text"], f["b_text"])})

    return pairs.select("q", "p", "a_text", "b_text").mapInPandas(run, f"q string, p string, {out} double")
