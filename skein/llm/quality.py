"""A quality classifier on learned subword embeddings (operator 9).

Every word, every pair of neighbouring words and every run of 3, 4 and 5 characters of a word (with its borders) is hashed to a bucket.
Each bucket has a vector, a document is the mean of its buckets' vectors, and a softmax over a linear layer gives its score. Vectors and
layer are learned together by stochastic gradient descent in numpy, on a sample of at most `limit` labelled rows whose features the
executors count. A word that follows itself gives one pair for all words, so that stuttering texts look alike.

For scoring, vectors and layer fold into one number for each bucket, so that a text costs a few array operations, and memory is bounded
by one text and one table of 2^16 numbers.

Edge cases: a null or empty text, or one of white space alone, has no feature and gets the score of the bias alone. Without any usable
label, or with one class only, every score is 0.5 or that class's smoothed share. Rows that share a doc_id each get a row. Other
columns are ignored, but `keep_good` returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, importable, labelled_texts, slices

BUCKETS, SIZES = 1 << 16, (3, 4, 5)
_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(4096)], np.uint64)
_SPACE = np.zeros(33, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """Buckets of all features of a text, repeats included."""
    codes = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    blank = _SPACE[np.minimum(codes, 32).astype(np.int64)] & (codes < 33)
    codes = np.where(blank, np.uint64(32), codes) + np.uint64(1)
    edge = np.diff(blank.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    if not len(starts):
        return np.zeros(0, np.int32)
    lengths = ends - starts
    inside = ~blank
    place = np.zeros(len(codes), np.int64)
    place[inside] = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weighed = codes * _POWERS[place & 4095]
    words = np.add.reduceat(np.where(inside, weighed, np.uint64(0)), starts)
    out = [_bucket(words + np.uint64(7))]
    if len(words) > 1:
        a, b = words[:-1], words[1:]
        out.append(_bucket(np.where(a == b, np.uint64(11), a * np.uint64(3) + b * _P)))
    roll, free = codes.copy(), np.ones(len(codes), bool)
    for n in range(2, max(SIZES) + 1):
        # a run may begin or end with the blank at a word's border, but have none within
        roll = roll[:-1] * _P + codes[n - 1 :]
        free = free[:-1] & (inside[n - 2 : -1] if n > 2 else True)
        if n in SIZES:
            out.append(_bucket(roll[free] + np.uint64(n << 40)))
    return np.concatenate(out)


class Model:
    """score(text) in 0..1; table: a bucket's share in the difference of the two logits."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table.astype(np.float32), float(bias)

    def score(self, text: str | None) -> float:
        f = features(text)
        z = self.bias + (float(self.table[f].mean(dtype=np.float64)) if len(f) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 0) -> Model:
    """rows: (buckets, counts, label). Plain stochastic gradient descent, one document a step, at a rate that falls to zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    positive = sum(y for *_, y in rows)
    if not rows or positive in (0, len(rows)):
        share = (positive + 1) / (len(rows) + 2)
        return Model(np.zeros(BUCKETS), np.log(share / (1 - share)))
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            buckets, counts, y = rows[i]
            r, step = rate * (1 - step / steps), step + 1
            if not len(buckets):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ vectors[buckets]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y] -= 1
            back = layer.T @ g
            layer -= r * np.outer(g, mean)
            bias -= r * 0.1 * g
            # the mean's gradient, at the step that each of the document's features would take by itself
            vectors[buckets] -= (r * len(buckets) * np.minimum(share, 4 / len(buckets)))[:, None] * back * 0.5
    difference = layer[1] - layer[0]
    return Model(vectors @ difference, bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", take=None, limit: int = 4000, most_buckets: int = 16_000_000, **how) -> Model:
    """Trains on at most limit labelled rows for which take (a column of labels) holds, in the order of a hash of their id, and on no
    more than have most_buckets features together (128 MB). The driver trains; its time and memory are bounded by these two."""
    importable(docs.sparkSession)

    def count(batches):
        for b in slices(batches):
            found = [np.unique(features(t), return_counts=True) for t in b.column(1).to_pylist()]
            cols = [pa.array([x[i].astype("<i4").tobytes() for x in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], names=["doc_id", "y", "buckets", "counts"])

    sample = labelled_texts(docs, labels, label, F.lit(True) if take is None else take, limit)
    kind = sample.schema["doc_id"].dataType.simpleString()
    counted = checkpoint(sample.mapInArrow(count, f"doc_id {kind}, y int, buckets binary, counts binary"))
    sizes = counted.select("doc_id", (F.octet_length("buckets") / 4).cast("long").alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    sizes.sort(key=lambda r: (r["h"], r["doc_id"]))
    fits = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), most_buckets, "right"))
    if fits < len(sizes):
        counted = counted.where(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id") < F.struct(F.lit(sizes[fits]["h"]).alias("h"), F.lit(sizes[fits]["doc_id"]).alias("doc_id")))
    got = counted.collect()
    got.sort(key=lambda r: (r["doc_id"], bytes(r["buckets"])))
    return train([(np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<i4"), int(r["y"] > 0)) for r in got], **how)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))

    def run(batches):
        own = Model(*held.value)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs with a score of at least threshold."""
    held = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))
    at = docs.columns.index("text")

    def run(batches):
        own = Model(*held.value)
        for b in slices(batches):
            yield b.filter(pa.array([own.score(t) >= threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


