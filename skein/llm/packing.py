"""Packing documents into sequences by the sum of squares (operator 8).

Documents longer than a sequence are cut into pieces of its whole length, the last piece aside; nothing else is cut. Let N(g) be the
number of open sequences with room for g more tokens. A piece goes where the sum of N(g)^2 over all g becomes smallest: into an open
sequence or a new one; of equally good places, into the one with the least room. Pieces come in descending length, in which order the rule
leaves about three sequences' worth of room in a shard of tens of thousands of pieces.

Pieces are dealt evenly to shards of about `shard` pieces each, and each shard is packed by itself; so a shard's memory is bounded at any
size of input, and the loss is about three sequences for each. Pieces of a whole sequence need no packing.

Edge cases: a null or empty text has only the end id; rows with the same doc_id are separate documents; an empty table gives no row.
Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, portions
from .tokens import word_cache


def pieces(docs: DataFrame, tokenizer: str, kind: str = "word", capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]) from docs (doc_id, text)."""

    def cut(batches):
        words, end = word_cache(tokenizer, kind), np.array([end_id], "<u4").tobytes()
        for b in portions(batches, 1, 4 << 20):
            rows = []
            for doc_id, raw in zip(b.column(0).to_pylist(), words.ids(b.column(1).to_pylist())):
                raw += end
                for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[a : a + 4 * capacity]
                    rows.append((doc_id, k, a // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            kinds = [b.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind_of_id}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the order given, by the sum of squares."""
    far = 1 << 40
    leave = np.full(capacity + 1, far, np.int64)  # what taking a bin away from a gap adds to the sum: 1 - 2 N, without the 1
    join = np.full(capacity + 1, 2, np.int64)  # what a bin more at a gap adds: 2 N + 1, with the 1 from above; a full bin counts no more
    join[0] = 1
    open_at: dict[int, list[int]] = {}
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        cost = leave[size:] + join[: capacity + 1 - size]
        j = int(cost.argmin())
        gap = capacity - size
        if cost[j] <= (join[gap] - 1 if gap else 0):
            old, gap = size + j, j
            b = open_at[old].pop()
            left = len(open_at[old])
            leave[old], join[old] = (-2 * left if left else far), 2 * left + 2
            offsets[i] = capacity - old
        else:
            b, n = n, n + 1
        bins[i] = b
        if gap:
            there = open_at.setdefault(gap, [])
            there.append(b)
            leave[gap], join[gap] = -2 * len(there), 2 * len(there) + 2
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", capacity: int = 4096, end_id: int = 1, shard: int = 32_768) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    rows = checkpoint(pieces(docs, tokenizer, kind, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))
    short = rows.where(F.col("length") < capacity)
    shards = -(-short.count() // shard) or 1
    # consecutive numbers within a partition, and partitions shifted against each other
    dealt = short.withColumn("shard", F.pmod(F.col("row") + F.shiftright("row", 33), F.lit(shards)))

    def packed(f):
        f = f.sort_values(["length", "row"], ascending=[False, True])
        bins, offsets = place(f["length"].to_numpy(), capacity)
        return f.assign(sequence_id=f["shard"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns=["shard", "row"])

    schema = rows.drop("row").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    some = dealt.groupBy("shard").applyInPandas(packed, schema)
    whole = rows.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")}).drop("row")
    return some.unionByName(whole)
