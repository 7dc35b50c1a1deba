"""Near-duplicates by SimHash and multi-index hashing (operator 2).

A fingerprint has 64 bits. Two that differ in at most 4 bits differ in at most 2 bits in one of their halves, and then the balls of
radius 1 around these halves meet. So each distinct fingerprint goes into the tables under the 33 values of either half's ball, and
fingerprints that share a table entry are compared in full. Half-length segments keep chance meetings rare at any size: two random
fingerprints meet with probability 2.5e-7, where three segments of 21 bits would let 3e-5 meet.

Copies with equal fingerprints are one node. Fingerprints of an entry are linked by spanning stars of what is within reach, never by all
pairs. An entry with more than `most` fingerprints is dealt out to several tasks, each of which compares two of its parts, so that every
pair is still compared.

Edge cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other; a text of one to three words
has one shingle. A null doc_id takes part, but is never a component's id unless the component has no other (then it is null). Rows that
share a doc_id are separate rows of the result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, checkpoint, numbered, slices
from .components import components

REACH = 4
_MASKS = np.array([0, *(1 << i for i in range(32))], np.uint64)


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").translate(LOWER_ASCII).split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    if n == 1:
        h = np.array([xxh64_intdigest(b" ".join(words), seed)], "<u8")
    else:
        whole = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        h = np.array([xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist())], "<u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 255):  # sums of up to 255 bits fit into bytes, which add up faster
        counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def mark(batches):
        for b in slices(batches):
            found = np.array([fingerprint(t, size, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(mark, docs.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def _stars(fps: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Links (a centre and a member each) that span what is within reach of one another, step by step."""
    links, left = [], fps
    while len(left) > 1:
        centre, front, left = int(left[0]), [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= reach
            if near.any():
                new = left[near]
                links += [(centre, int(x)) for x in new]
                front += list(new)
                left = left[~near]
    return links


def _linked(fps: np.ndarray, sizes: np.ndarray, reach: int, all_pairs_up_to: int = 6) -> list[tuple[int, int]]:
    """Links among the fingerprints of each run; sizes: of the runs, in a row."""
    ends = np.cumsum(sizes)
    small = sizes <= all_pairs_up_to
    run_end = np.repeat(np.where(small, ends, 0), sizes)
    at, out = np.arange(len(fps)), []
    for step in range(1, all_pairs_up_to):
        i = at[at + step < run_end]
        if not len(i):
            break
        a, b = fps[i], fps[i + step]
        near = np.bitwise_count(a ^ b) <= reach
        out += zip(a[near].tolist(), b[near].tolist())
    for end, size in zip(ends[~small].tolist(), sizes[~small].tolist()):
        out += _stars(fps[end - size : end], reach)
    return out


def links(distinct: DataFrame, reach: int = REACH, most: int = 8192) -> DataFrame:
    """(a, b): links that connect all pairs of distinct fingerprints (column fp) that differ in at most reach <= 5 bits."""
    spark = distinct.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def enter(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                f = fps[at : at + 4096]
                low, high = f & np.uint64(0xFFFFFFFF), f >> np.uint64(32)
                keys = np.concatenate([(low[:, None] ^ _MASKS).ravel(), ((high[:, None] ^ _MASKS) | np.uint64(1 << 32)).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.tile(np.repeat(f, 33), 2).view(np.int64))], names=["key", "fp"])

    def said(found: set, heavy: list[int]) -> pa.RecordBatch:
        a, b = ([x[i] for x in found] for i in (0, 1))
        cols = [np.array([*a, *heavy], np.uint64).view(np.int64), np.array([*b, *[0] * len(heavy)], np.uint64).view(np.int64)]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([False] * len(a) + [True] * len(heavy))], names=["a", "b", "heavy"])

    def meet(batches):
        """Rows come in the order of key. Of an entry with more than most rows, only its key is passed on."""
        keys, fps, over = np.zeros(0, np.uint64), np.zeros(0, np.uint64), None
        found, heavy = set(), []
        for b in batches:
            k, f = (b.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            if over is not None:
                stay = k != over
                k, f = k[stay], f[stay]
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys.view(np.int64), keys[-1:].view(np.int64)[0]))  # the last entry may go on
            _entries(keys[:whole], fps[:whole], found, heavy)
            keys, fps = keys[whole:], fps[whole:]
            if len(keys) > most:
                over = keys[0]
                heavy.append(int(over))
                keys, fps = keys[:0], fps[:0]
            if len(found) > 100_000:
                yield said(found, [])
                found = set()
        _entries(keys, fps, found, heavy)
        yield said(found, heavy)

    def _entries(keys, fps, found, heavy):
        if len(keys) < 2:
            return
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(first, len(keys)))
        for at in first[sizes > most].tolist():
            heavy.append(int(keys[at]))
        use = (sizes > 1) & (sizes <= most)
        rows = np.repeat(use, sizes)
        if use.any():
            found.update(_linked(fps[rows], sizes[use], reach))

    entered = distinct.select("fp").mapInArrow(enter, "key long, fp long")
    met = checkpoint(entered.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(meet, "a long, b long, heavy boolean"))
    out = met.where("not heavy").select("a", "b")
    heavy = met.where("heavy").select(F.col("a").alias("key"))
    if heavy.isEmpty():
        return out
    rows = checkpoint(entered.join(heavy, "key"))
    parts = rows.groupBy("key").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    rows = rows.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp")

    def compare(f):
        import pandas as pd

        return pd.DataFrame(np.array(_stars(f["fp"].to_numpy().view(np.uint64), reach) or np.zeros((0, 2)), np.uint64).view(np.int64), columns=["a", "b"])

    return out.unionByName(rows.groupBy("key", "p", "q").applyInPandas(compare, "a long, b long"))


def near_copies(docs: DataFrame, size: int = 4, seed: int = 42, reach: int = REACH) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text)."""
    marked = checkpoint(fingerprints(docs, size, seed))
    distinct = checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = checkpoint(components(links(distinct.select("fp"), reach)))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"])
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = rooted.join(least, "root").select("fp", "component_id")
    single = distinct.join(roots, distinct["fp"] == roots["node"], "left_anti").select("fp", F.col("least").alias("component_id"))
    return marked.join(linked.unionByName(single), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, broadcast_up_to: int = 1_000_000, **how) -> DataFrame:
    """docs with one row of each group of near-copies: that with the smallest doc_id (null last), of several the first. Rows are told apart by
    numbers, as ids may be null or repeat; the groups are those of near_copies, by 4-word shingles and at most `reach` bits.

    The numbers of the other rows are broadcast only if they are no more than broadcast_up_to (8 MB); beyond that they are joined by shuffle.
    """
    rows = numbered(docs)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")  # its order is that in which rows stay
    found = near_copies(rows.select(own.alias("doc_id"), "text"), **how)
    gone = checkpoint(found.where(F.col("doc_id.__row") != F.col("component_id.__row")).select("doc_id.__row"))
    if gone.count() <= broadcast_up_to:
        gone = F.broadcast(gone)
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)
