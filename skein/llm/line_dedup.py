"""Dropping lines that many documents share, by two Bloom filters (operator 6).

A line's key is the line without ASCII white space at its ends, A-Z in lower case. One pass over the texts sends hashes: a hash's upper
bits choose a block, and its lower 32 bits, with the number of documents, travel there from each share of a task's lines. The task that
holds a block fills two filters, once-seen, and twice-seen for keys that met all their bits in the first, tests the block's hashes against
the second, and counts documents for these suspects alone. Hashes that reach the least number of documents are few. A second pass sends
only keys with such a hash to an exact count by key and document. A third drops lines whose key reached the least number.

A block has some 200,000 lines at any size of input, so its filters and hashes take a few megabytes. The wanted hashes, and then the found
keys, go to all tasks while they are below `broadcast_bytes`; beyond that, documents and hashes are joined by shuffle, for which only row
numbers and hashes of lines travel, never the keys of lines that are no suspects.

Edge cases: a null or empty text is one empty line, and empty keys are never dropped; every row is a document of its own, even if ids
repeat or are null; within one document a line counts once, but is dropped wherever it stands. A null text stays null. The other columns
of docs stay as they are, and an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, STRIP, checkpoint, importable, slices, stored

_STRIP = STRIP.encode()
ONCE_BITS, TWICE_BITS, PER_BLOCK = 1 << 22, 1 << 19, 1 << 18
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def keys_of(text: str | None) -> list[bytes]:
    return [k.strip(_STRIP) for k in (text or "").encode("utf-8", "replace").translate(LOWER_ASCII).split(b"\n")]


def _bits(low: np.ndarray, size: int) -> np.ndarray:
    """Three bit numbers for each 32-bit value."""
    v = low.astype(np.uint64)
    return np.stack([((v * np.uint64(m)) & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32) for m in _ODD])


def _counted(key: bytes, least_chars: int) -> bool:
    return len(key) >= least_chars and (least_chars <= 1 or len(key.decode("utf-8", "replace")) >= least_chars)


def _hashes(texts: list, least_chars: int) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(k) for t in texts for k in set(keys_of(t)) if k and _counted(k, least_chars)], np.uint64)


def _code(h: np.ndarray, blocks: int) -> np.ndarray:
    """Block and lower 32 bits in one number."""
    block = h >> np.uint64(65 - blocks.bit_length()) if blocks > 1 else np.zeros(len(h), np.uint64)
    return ((block << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))).astype(np.int64)


def wanted_hashes(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> tuple[DataFrame, int]:
    """((block, low binary): hashes that suspects of the twice-seen filter share in at least least_docs documents; the number of blocks)."""
    lines = docs.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    blocks = 1 << max(0, (lines // PER_BLOCK).bit_length())

    def send(batches):
        held, n = [], 0
        for b in slices(batches):
            held.append(_hashes(b.column(0).to_pylist(), least_chars))
            n += len(held[-1])
            if n > 200_000:
                yield share(np.concatenate(held))
                held, n = [], 0
        if n:
            yield share(np.concatenate(held))

    def share(h):
        codes, counts = np.unique(_code(h, blocks), return_counts=True)
        block = codes >> 32
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist()
        low, counts = (codes & 0xFFFFFFFF).astype("<u4"), counts.astype("<u4")
        rows = [(int(block[a]), low[a:e].tobytes(), counts[a:e].tobytes()) for a, e in zip(starts, [*starts[1:], len(codes)])]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["block", "low", "docs"])

    def suspects(block: int, shares: list) -> pa.RecordBatch:
        once, twice = np.zeros(ONCE_BITS, bool), np.zeros(TWICE_BITS, bool)
        for low, counts in shares:
            bits = _bits(low, ONCE_BITS)
            again = once[bits].all(axis=0) | (counts > 1)
            twice[_bits(low[again], TWICE_BITS)] = True
            once[bits] = True
        hit = [twice[_bits(low, TWICE_BITS)].all(axis=0) for low, _ in shares]
        low, at = np.unique(np.concatenate([low[x] for (low, _), x in zip(shares, hit)]), return_inverse=True)
        total = np.bincount(at, np.concatenate([counts[x] for (_, counts), x in zip(shares, hit)]), minlength=len(low))
        found = low[total >= least_docs].astype("<u4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([found], pa.binary())], names=["block", "low"])

    def merge(batches):
        at, shares = None, []
        for b in batches:
            for block, low, counts in zip(*(b.column(i).to_pylist() for i in range(3))):
                if block != at and shares:
                    yield suspects(at, shares)
                    shares = []
                at = block
                shares.append((np.frombuffer(low, "<u4"), np.frombuffer(counts, "<u4")))
        if shares:
            yield suspects(at, shares)

    sent = docs.select("text").mapInArrow(send, "block long, low binary, docs binary")
    n = min(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sent.repartition(n, "block").sortWithinPartitions("block").mapInArrow(merge, "block long, low binary"), blocks


def _codes(rows) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *((r["block"] << 32) | np.frombuffer(r["low"], "<u4").astype(np.int64) for r in rows)])


def _rows_with(docs: DataFrame, wanted: DataFrame, blocks: int, least_chars: int) -> DataFrame:
    """docs (with __row) with __codes: the wanted hashes of their lines, null for none. Rows and hashes are shuffled, lines are not."""

    def hashed(batches):
        for b in slices(batches):
            each = [np.unique(_code(_hashes([t], least_chars), blocks)) for t in b.column(1).to_pylist()]
            rows = np.repeat(b.column(0).to_numpy(), [len(x) for x in each])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate([*each, np.zeros(0, np.int64)]))], names=["__row", "code"])

    def flat(batches):
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_codes([r]))], names=["code"])

    lines = docs.select("__row", "text").mapInArrow(hashed, "__row long, code long")
    hits = lines.join(wanted.mapInArrow(flat, "code long"), "code").groupBy("__row").agg(F.collect_list("code").alias("__codes"))
    return docs.join(hits, "__row", "left")


def drop_shared_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """docs with text without the lines of shared keys, and n_lines (before), n_dropped. keep_first: a key's first line of all stays."""
    spark = docs.sparkSession
    importable(spark)
    docs = docs.drop("n_lines", "n_dropped")  # columns of these names give way to the result's
    names = docs.columns
    wanted, blocks = wanted_hashes(docs, least_docs, least_chars)
    wanted = checkpoint(wanted)
    size = wanted.agg(F.sum(F.octet_length("low") * 2)).first()[0] or 0
    if size <= broadcast_bytes:
        all_codes = spark.sparkContext.broadcast(np.sort(_codes(wanted.collect())))  # eight bytes a hash, broadcast_bytes at most
        marked = docs.withColumn("__codes", F.lit(None).cast("array<long>"))
    else:
        all_codes = None
        # rows must keep their numbers on both sides of the joins
        marked = _rows_with(stored(docs.withColumn("__row", F.monotonically_increasing_id()), "lines"), wanted, blocks, least_chars).drop("__row")
        marked = stored(marked.select(*names, "__codes"), "marked-lines")
    at, id_at = names.index("text"), names.index("doc_id")

    def asked(keys: list[bytes], codes) -> dict[bytes, int]:
        """Of the keys of a text those with a wanted hash, each with its first line."""
        from xxhash import xxh3_64_intdigest

        first: dict[bytes, int] = {}
        for i, k in enumerate(keys):
            if k and k not in first and _counted(k, least_chars):
                first[k] = i
        own = _code(np.array([xxh3_64_intdigest(k) for k in first], np.uint64), blocks)
        known = all_codes.value if all_codes else np.sort(np.array(codes or [], np.int64))
        if not len(known) or not len(own):
            return {}
        hit = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
        return {k: i for (k, i), x in zip(first.items(), hit.tolist()) if x}

    def send(batches):
        for b in slices(batches):
            found = [asked(keys_of(t), c) for t, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            rows = pa.array(np.repeat(np.arange(b.num_rows), [len(f) for f in found]))
            cols = [pa.array([k for f in found for k in f], pa.binary()), b.column(1).take(rows), pa.array([i for f in found for i in f.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "doc_id", "line"])

    sent = marked.select("text", "doc_id", "__codes").mapInArrow(send, f"key binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, line long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line"))
    shared = sent.groupBy("key").agg(F.count("*").alias("docs"), first.alias("first")).where(F.col("docs") >= least_docs)
    shared = checkpoint(shared.select("key", F.col("first.doc_id").alias("first_id"), F.col("first.line").alias("first_line")))
    schema = docs.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}).schema

    def apply(b: pa.RecordBatch, drops: list) -> pa.RecordBatch:
        texts, lines, dropped = [], [], []
        for text, doc_id, drop in zip(b.column(at).to_pylist(), b.column(id_at).to_pylist(), drops):
            keys = keys_of(text)
            out = [i for i, k in enumerate(keys) if k in drop and not (keep_first and drop[k] == (doc_id, i))] if drop else []
            if out:
                gone = set(out)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            texts.append(text)
            lines.append(len(keys))
            dropped.append(len(out))
        cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[f.name for f in schema])

    if (shared.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0) <= broadcast_bytes:
        held = spark.sparkContext.broadcast({bytes(r["key"]): (r["first_id"], r["first_line"]) for r in shared.toLocalIterator()})

        def drop(batches):
            for b in slices(batches):
                yield apply(b, [held.value] * b.num_rows)

        return docs.mapInArrow(drop, schema)

    numbered = stored(marked.withColumn("__row", F.monotonically_increasing_id()), "numbered-lines")

    def keyed(batches):
        for b in slices(batches):
            pairs = [(r, k) for r, t, c in zip(*(b.column(i).to_pylist() for i in range(3))) for k in asked(keys_of(t), c)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary())], names=["__row", "key"])

    hits = numbered.select("__row", "text", "__codes").mapInArrow(keyed, "__row long, key binary").join(shared, "key")
    hits = hits.groupBy("__row").agg(F.collect_list(F.struct("key", "first_id", "first_line")).alias("__drop"))

    def drop_joined(batches):
        for b in slices(batches):
            yield apply(b, [{k["key"]: (k["first_id"], k["first_line"]) for k in d or []} for d in b.column(len(names)).to_pylist()])

    return numbered.join(hits, "__row", "left").select(*names, "__drop").mapInArrow(drop_joined, schema)


ORACLE = r"""
WITH lines AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), each AS (
  SELECT rid, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM lines
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each
), shared AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10
), marked AS (
  SELECT k.*, s.key IS NOT NULL AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
