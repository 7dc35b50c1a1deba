"""Approximate nearest neighbours by collision counting (operator 7).

Each of `projections` random lines gives every vector's direction a position, and an index keeps the vectors in the order of each line. A
query opens a window around its own position on each line; a vector that lies in at least `collisions` of them is verified with its exact
inner product. The half-width of the windows is a radius times a factor, which is set so that a vector within the radius (of directions)
collides often enough with probability `sure`. Virtual rehashing: the same sorted arrays serve every radius. A first round at the radius
`first` verifies the vectors with the most collisions, 20 * k of a block; the k-th best product found so far then tells the radius beyond
which no better vector lies, and the second round verifies all that collide often enough there. So the data set the share that is verified.

Every sorted array is cut at `cells` even steps, and a window takes whole cells. For each cut, the vectors before it are a bit set; the
members of a window are the difference of two such sets, and collisions are counted for 64 vectors at a time by adding up bits.

Norms: a block is cut into ranges of norm, longest first, each with an index of its own. An inner product of t needs a cosine of t by the
query's norm and the range's largest, so the radius is set by each range, and ranges that cannot reach the k-th best are left out.

Vectors come in blocks of about `block` rows and queries in blocks of `query_block`; each pair of blocks is one task's work and memory, and
gives its k best for each query, of which k remain. No vector is left out of the index. Recall and the verified share are measured in the
tests. With queries in proportion to the rows, the work grows as their product, at some 20 nanoseconds a pair of vectors without structure.

Edge cases: vectors that are null, empty, zero, or hold a null or a component that is not finite take no part, as queries or candidates;
queries only meet vectors of their own length. Ties in score go to the smaller id, a null id last. Rows with the query's own id are not
among its candidates. A query with fewer than k candidates gets them all. Other columns are ignored.
"""

from __future__ import annotations

from math import comb
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, importable


def width_factor(projections: int, collisions: int, sure: float) -> float:
    """Half-width by radius at which a vector on the radius lies in `collisions` of the windows with probability `sure`."""
    low, high = 0.0, 1.0
    for _ in range(50):
        p = (low + high) / 2
        reached = sum(comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(collisions, projections + 1))
        low, high = (p, high) if reached < sure else (low, p)
    return NormalDist().inv_cdf((1 + high) / 2)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and norms of the rows, none of which is zero."""
    top = np.abs(x).max(axis=1, keepdims=True)
    scaled = x / top
    norm = np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return scaled / norm, (norm * top)[:, 0]


class Index:
    """Sorted projections of directions (rows of u), and the bit set of the vectors before each cut of each sorted array."""

    def __init__(self, u: np.ndarray, projections: int, cells: int, seed: int):
        n = len(u)
        self.n, self.lines = n, np.random.default_rng(seed).standard_normal((u.shape[1], projections))
        at = u @ self.lines
        order = np.argsort(at, axis=0).T
        self.sorted = np.take_along_axis(at, order.T, axis=0).T.copy()
        starts = np.unique(np.arange(cells) * n // cells)
        cell_of_rank = np.searchsorted(starts, np.arange(n), "right") - 1
        self.starts, words = starts, -(-n // 64)
        self.before = np.zeros((projections, len(starts) + 1, words), np.uint64)
        for j in range(projections):
            own = np.zeros((len(starts), words * 64), bool)
            own[cell_of_rank, order[j]] = True
            packed = np.packbits(own, axis=1, bitorder="little").view(np.uint64)
            np.bitwise_or.accumulate(packed, axis=0, out=self.before[j, 1:])

    def counts(self, positions: np.ndarray, half: np.ndarray) -> np.ndarray:
        """(query, vector): the number of windows, positions (query, line) give or take half (query), that the vector lies in."""
        levels: list[list[np.ndarray]] = [[]]
        for j, (line, sets) in enumerate(zip(self.sorted, self.before)):
            ends = [np.searchsorted(line, positions[:, j] + side * half, where) for side, where in ((-1, "left"), (1, "right"))]
            low = np.searchsorted(self.starts, ends[0], "right") - 1  # the cell with the first member: whole cells are taken
            high = np.searchsorted(self.starts, ends[1], "left")
            levels[0].append(sets[np.maximum(low, 0)] ^ sets[np.maximum(high, np.maximum(low, 0))])
            at = 0
            while at < len(levels) and len(levels[at]) >= 3:  # three bits of one weight are one of that weight and one of the next
                a, b, c = (levels[at].pop() for _ in range(3))
                if at + 1 == len(levels):
                    levels.append([])
                odd = a ^ b
                levels[at + 1].append((a & b) | (odd & c))
                levels[at].append(odd ^ c)
                at += 1
        total = np.zeros((len(positions), len(levels[0][0][0]) * 64), np.uint16 if len(self.lines[0]) > 255 else np.uint8)
        for weight, planes in enumerate(levels):
            for plane in planes:
                total += np.unpackbits(plane.view(np.uint8), axis=1, bitorder="little").astype(total.dtype) << weight
        return total[:, : self.n]


def ranges(norms: np.ndarray, ratio: float) -> list[tuple[np.ndarray, float]]:
    """(rows, largest norm) of ranges of norm, longest first: within each, no row is `ratio` times as long as another."""
    step = np.floor((np.log(norms.max()) - np.log(norms)) / np.log(ratio))
    return [(rows, float(norms[rows].max())) for rows in (np.flatnonzero(step == k) for k in np.unique(step))]


def search(x: np.ndarray, ids: np.ndarray, y: np.ndarray, own: np.ndarray, k: int, projections: int, collisions: int, first: float, sure: float, cells: int, ratio: float, seed: int, at_once: int = 16) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query (rows of y, ids own) its k best (rows of x, scores); and the number of products that were verified."""
    factor = width_factor(projections, collisions, sure)
    directions, norms = unit(x)
    asked, lengths = unit(y)
    best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in own]
    verified = 0

    def verify(i: int, rows: np.ndarray) -> None:
        nonlocal verified
        verified += len(rows)
        rows = rows[ids[rows] != own[i]]
        score = x[rows] @ y[i]
        if len(rows) > 4 * k:  # ties at the end stay
            near = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[near], score[near]
        old, held = best[i]
        rows, score = np.concatenate([old, rows]), np.concatenate([held, score])
        order = np.lexsort((ids[rows], -score))
        rows, score = rows[order], score[order]
        new = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
        best[i] = rows[new][:k], score[new][:k]

    for members, norm in ranges(norms, ratio):
        index = None
        for a in range(0, len(own), at_once):
            least = np.array([best[i][1][k - 1] if len(best[i][1]) == k else -np.inf for i in range(a, min(a + at_once, len(own)))])
            todo = a + np.flatnonzero(least <= lengths[a : a + at_once] * norm * (1 + 1e-9))
            if not len(todo):
                continue
            index = index or Index(directions[members], projections, cells, seed)
            positions = asked[todo] @ index.lines
            quota = min(max(k, 20 * k * len(members) // len(x)), len(members))
            some = index.counts(positions, np.full(len(todo), factor * first))
            for i, c in zip(todo.tolist(), some):
                tail = np.cumsum(np.bincount(c, minlength=projections + 1)[::-1])[::-1]  # vectors with so many collisions or more
                verify(i, members[c >= max(int(np.flatnonzero(tail >= quota)[-1]), 0)])
            least = np.array([best[i][1][k - 1] if len(best[i][1]) == k else -np.inf for i in todo])
            cosine = np.clip(least / (lengths[todo] * norm), -1, 1)
            for i, c in zip(todo.tolist(), index.counts(positions, factor * np.sqrt(2 - 2 * cosine))):
                verify(i, members[c >= collisions])
    return best, verified


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, projections: int = 128, collisions: int = 104, first: float = 1.0, sure: float = 0.8, cells: int = 64, block: int = 32_768, query_block: int = 16_384, seed: int = 7, ratio: float = 1.1) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of vectors (vec_id, embedding) to each of queries (same columns), by inner product."""
    spark = vectors.sparkSession
    importable(spark)

    def usable(df: DataFrame) -> DataFrame:
        e = F.transform("embedding", lambda v: v.cast("double"))
        fine = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.exists(e, lambda v: v != 0)
        return df.select("vec_id", "embedding").where(fine).withColumn("dim", F.size("embedding"))

    v, q = usable(vectors), usable(queries)
    blocks, query_blocks = (max(1, -(-df.count() // n)) for df, n in ((v, block), (q, query_block)))
    deal = lambda n: F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33), F.lit(n)).cast("int")
    # dealing twice gives the same blocks only from rows that stay as they are
    v = checkpoint(v.withColumn("block", deal(blocks))).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    q = checkpoint(q.withColumn("query_block", deal(query_blocks))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def found_in(v, q):
        import pandas as pd

        out = []
        if len(v) and len(q):
            x, y = (np.stack(f["embedding"].to_numpy()).astype(np.float64) for f in (v, q))
            ids, own = (f["vec_id"].to_numpy() for f in (v, q))
            for of, (rows, score) in zip(own, search(x, ids, y, own, k, projections, collisions, first, sure, cells, ratio, seed)[0]):
                out.append(pd.DataFrame({"query_id": of, "vec_id": ids[rows], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["dim", "query_block", "block"]
    found = v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(found_in, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: Exact, for comparison: an approximate result has to have nine tenths of these rows.
EXACT = """
WITH v AS (SELECT vec_id, embedding FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0)
SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
FROM q JOIN v ON q.vec_id <> v.vec_id
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) <= 20
"""
