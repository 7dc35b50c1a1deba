"""Quality rules with an isolation forest (operator 10).

Statistics of each whole text feed two plain rules (too few words, too many repeated ones) and an isolation forest: trees of random splits,
in which odd documents end on short paths. As that method has it, a tree is grown on `size` documents; they are drawn from all documents that
pass the plain rules, and no document is in two trees while there are enough. The forest sees by how much a share exceeds what is usual among
good rows (on raw shares it found 2 % of the bad rows that pass the plain rules, in place of all). What is usual, and above which anomaly
score a document goes, come from all labelled rows, exactly: the threshold has the best balanced accuracy among those that keep `keep` of
the good rows (or all but one). Only values beyond such quantiles reach the driver: 0.2 % of the good rows' scores, 0.025 % of a share.

Edge cases: a null text has no words, hence fails the base rules, as an empty one does; without labels of both classes the threshold is
the score that `keep` of the labelled rows stay under. Rows that share a doc_id each get a row, and of their texts one counts for the label.
Other columns are ignored, except that `keep_good` returns them as they are.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, importable, slices, stored

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
_UPPER, _DIGITS, _ENDS = (bytes(range(65, 91)), b"0123456789", b".,:;!?")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(text: str | None) -> list[int]:
    """BASE, then lines, distinct words, words equal to the one before, upper-case letters, digits, punctuation (ASCII all three)."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, lines = len(words), text.split("\n")
    seen: set[str] = set()
    dup = 0
    for x in lines:
        if x in seen:
            dup += bool(x.strip(BLANKS))
        else:
            seen.add(x)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    repeat = same = 0
    if n > 1:
        same = int((ids[1:] == ids[:-1]).sum())
    if n > 3:
        v = len(number) + 1
        pair = ids[:-1] * v + ids[1:]
        if v >= 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1]
        _, at, counts = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
        again = counts[at] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= again
        repeat = int(cover.sum())
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    chars = len(text) - sum(map(text.count, BLANKS))
    return [n, chars, sum(map(text.count, SYMBOLS)), dup, repeat, len(lines), len(number), same, without(_UPPER), without(_DIGITS), without(_ENDS)]


def shares(stats: np.ndarray) -> np.ndarray:
    """Symbols, upper case, digits and punctuation by character; repeated and doubled words by word; double lines by line; word length."""
    n, chars, symbols, dup, repeat, lines, distinct, same, upper, digits, ends = np.asarray(stats, float).reshape(-1, 11).T
    w, c = np.maximum(n, 1), np.maximum(chars, 1)
    return np.stack([symbols / c, upper / c, digits / c, ends / c, repeat / w, same / w, dup / np.maximum(lines, 1), chars / w], axis=1)


def inputs(stats: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """What the forest sees: by how much each share exceeds what is usual, the upper end of good rows."""
    return np.maximum(shares(stats) - usual, 0)


class Forest:
    """score(x) in 0..1 for each row of x: the higher, the shorter its paths."""

    def __init__(self, x: np.ndarray, trees: int = 128, size: int = 256, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.size = max(2, min(size, len(x)))
        order = rng.permutation(len(x))  # dealt out in turn; rows serve again only where there are fewer than the trees take
        self.trees = [self._grow(x[order.take(range(t * self.size, (t + 1) * self.size), mode="wrap")], rng) for t in range(trees)] if len(x) else []

    @staticmethod
    def _usual(n: np.ndarray) -> np.ndarray:
        """Mean length of an unsuccessful search among n."""
        n = np.maximum(np.asarray(n, float), 1)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, n - 1)

    def _grow(self, x: np.ndarray, rng) -> tuple:
        """Arrays by node: feature (-1 in a leaf), cut, left child, right child, path length in a leaf."""
        limit, nodes, todo = int(np.ceil(np.log2(self.size))), [], [(x, 0, -1, 0)]
        while todo:
            rows, depth, parent, side = todo.pop()
            here = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = here
            low, high = rows.min(axis=0), rows.max(axis=0)
            free = np.flatnonzero(high > low)
            if depth >= limit or len(rows) < 2 or not len(free):
                nodes.append([-1, 0.0, 0, 0, depth + float(self._usual(len(rows)))])
                continue
            f = int(rng.choice(free))
            cut = rng.uniform(low[f], high[f])
            nodes.append([f, cut, 0, 0, 0.0])
            left = rows[:, f] <= cut
            todo += [(rows[left], depth + 1, here, 0), (rows[~left], depth + 1, here, 1)]
        f, cut, left, right, length = zip(*nodes)
        return np.array(f), np.array(cut), np.array(left), np.array(right), np.array(length)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for f, cut, left, right, length in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := f[at] >= 0).any():
                r, a = rows[inner], at[inner]
                at[r] = np.where(x[r, f[a]] <= cut[a], left[a], right[a])
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / float(self._usual(self.size)))


class Model:
    def __init__(self, forest: Forest, usual: np.ndarray, threshold: float):
        self.forest, self.usual, self.threshold = forest, usual, threshold

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.forest.score(inputs(stats, self.usual))


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _statistics_of(texts: DataFrame, keep: list[str]) -> DataFrame:
    """keep and stats of (keep..., text)."""

    def count(batches):
        for b in slices(batches):
            found = pa.array([statistics(t) for t in b.column(len(keep)).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), found], names=[*keep, "stats"])

    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.select(*keep, "text").mapInArrow(count, f"{kinds}, stats array<long>")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, stats) of every row, written once: what fit and judge take in place of texts. mark: a hash of the row."""
    importable(docs.sparkSession)
    return stored(_statistics_of(docs.withColumn("mark", F.xxhash64("doc_id", "text")), ["doc_id", "mark"]), "statistics")


def _passed(stats: str) -> Column:
    return ~base_failed(F.col(stats)[0], F.col(stats)[4])


def _stats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 11)


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in b.columns]


def _reduced(df: DataFrame, part: Callable, merge: Callable, none):
    """merge over part(an Arrow batch of df) of all batches; what part returns stays small. none: of no rows."""

    def run(batches):
        found = none
        for b in batches:
            found = merge(found, part(b))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)])], names=["found"])

    n = df.sparkSession.sparkContext.defaultParallelism
    found = df.mapInArrow(run, "found binary").rdd.map(lambda r: pickle.loads(r[0]))
    return merge(none, found.treeReduce(merge, 2 if found.getNumPartitions() <= 8 * n else 3)) if found.getNumPartitions() else none


def _greatest(df: DataFrame, m: int) -> np.ndarray:
    """The m greatest values of each column of df, in ascending order, a row for each column; NaN stands before them if there are fewer."""
    none = np.full((len(df.columns), m), np.nan)

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.sort(np.where(np.isnan(x := np.concatenate([a, b], axis=1)), -np.inf, x), axis=1)[:, -m:]
        return np.where(np.isinf(both), np.nan, both)

    return _reduced(df, lambda b: np.stack(_columns(b)), merge, none)


def quantiles(df: DataFrame, n: int, q: float) -> np.ndarray:
    """np.quantile of each column of df, of n finite values each; made for q close to 1: the values above it come to the driver."""
    at = (n - 1) * q
    low = int(np.floor(at))
    top = _greatest(df, n - low)
    below, above = top[:, 0], top[:, min(1, n - low - 1)]
    return below + (above - below) * (at - low)


def calibrate(scored: DataFrame, keep: float) -> float:
    """The threshold (documents above it go) with the best balanced accuracy of those that keep at least `keep` of the good rows, or all but
    one; the lowest of equal ones. scored: score, good.

    Only a cut right above a good row can be best, as on the way up to the next one bad rows alone pass; and of the good rows only the
    greatest can have one, as `keep` of them must stay under it.
    """
    n = {r["good"]: r["count"] for r in scored.groupBy("good").count().collect()}
    n_good, n_bad = n.get(True, 0), n.get(False, 0)
    if not n_good or not n_bad:
        return float(quantiles(scored.select("score"), n_good + n_bad, keep)[0]) if n_good + n_bad else 1.0
    least = min(keep, 1 - 1.5 / n_good)
    top = _greatest(scored.where("good").select("score"), min(n_good, int(n_good * (1 - least)) + 2))[0]
    at = np.unique(top)
    good_above = len(top) - np.searchsorted(top, at, "right")

    def part(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        score = _columns(b)[0]
        place = np.searchsorted(at, score, "left")  # of at, so many are smaller
        low = np.full(len(at) + 1, np.inf)
        np.minimum.at(low, place, score)
        return np.bincount(place, minlength=len(at) + 1), low

    none = (np.zeros(len(at) + 1, np.int64), np.full(len(at) + 1, np.inf))
    count, low = _reduced(scored.where("not good").select("score"), part, lambda a, b: (a[0] + b[0], np.minimum(a[1], b[1])), none)
    bad_above = np.cumsum(count[::-1])[::-1][1:]  # a bad row at the same score stays, too
    following = np.minimum(np.append(at[1:], np.inf), np.minimum.accumulate(low[::-1])[::-1][1:])
    cuts = np.where(np.isinf(following), at, (at + following) / 2)
    kept = (n_good - good_above) / n_good
    return float(cuts[np.argmax(np.where(kept >= least, kept + bad_above / n_bad, -1))])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", take=None, keep: float = 0.998, trees: int = 128, size: int = 256) -> Model:
    """The model of docs (texts, or what measured() made of them): usual shares and threshold from all rows of labels for which take holds."""
    docs = docs if "stats" in docs.columns else measured(docs)
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.lit(True) if take is None else take))
    y = y.groupBy("doc_id").agg((F.max(F.col(label).cast("int")) > 0).alias("good"))
    known = docs.join(y, "doc_id").groupBy("doc_id").agg(F.min_by("stats", F.struct("mark", "stats")).alias("stats"), F.first("good").alias("good"))
    known = checkpoint(known.where(_passed("stats")).select("stats", "good"))  # the base rules deal with the rest
    n = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    if not n:
        return Model(Forest(np.zeros((0, 8))), np.zeros(8), 1.0)

    def shared(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in shares(_stats(b.column(0))).T], names=[f"s{i}" for i in range(8)])

    good = known.where("good") if True in n else known
    each = good.select("stats").mapInArrow(shared, ", ".join(f"s{i} double" for i in range(8)))
    usual = quantiles(each, n.get(True, 0) or n[False], 1 - (1 - keep) / 8)  # all eight together exceed about as often as may go

    passing = docs.where(_passed("stats"))
    mark = F.pmod("mark", F.lit(max(1, passing.count())))  # of n documents, those with less than m are some m
    drawn = passing.where(mark < trees * size).select(mark.alias("mark"), "stats").orderBy("mark", "stats").limit(2 * trees * size).collect()  # short rows
    forest = Forest(inputs(np.array([r["stats"] for r in drawn] or [r["stats"] for r in known.limit(size).collect()], np.int64), usual), trees, size)
    model = Model(forest, usual, 1.0)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for b in slices(batches, 1024):
            yield pa.RecordBatch.from_arrays([pa.array(held.value.score(_stats(b.column(0)))), b.column(1)], names=["score", "good"])

    model.threshold = calibrate(checkpoint(known.mapInArrow(score, "score double, good boolean")), keep)
    return model


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, BASE..., base_failed, anomaly, kept) of every row of docs (texts, or what measured() made of them)."""
    importable(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for part in slices(batches, 1024):
            stats = _stats(part.column(1))
            odd = m.score(stats)
            failed = base_failed(stats[:, 0], stats[:, 4])
            cols = [pa.array(np.ascontiguousarray(stats[:, i])) for i in range(5)] + [pa.array(failed), pa.array(odd), pa.array(~failed & (odd <= m.threshold))]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", *BASE, "base_failed", "anomaly", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "stats") if "stats" in docs.columns else _statistics_of(docs, ["doc_id"])
    return found.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, anomaly double, kept boolean")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that pass the base rules and the forest."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        m = held.value
        for b in slices(batches):
            stats = np.array([statistics(t) for t in b.column(at).to_pylist()], np.int64).reshape(-1, 11)
            yield b.filter(pa.array(~base_failed(stats[:, 0], stats[:, 4]) & (m.score(stats) <= m.threshold)))

    return docs.mapInArrow(run, docs.schema)
