"""Token ids in a content-addressed store (operator 3).

Format of a store, all Parquet but for the manifest:

* chunks: digest (BLAKE2b of the content, 20 bytes), payload (a byte that says how many bytes an id has, then the ids,
  little-endian: two bytes each where all are below 65,536, else four; the column is compressed with zstandard). Every distinct chunk is
  there once.
* recipes, in ascending doc_id order: doc_id, start (ids of all documents before), n_tokens, digests (of its chunks, in order), root
  (the Merkle root of these digests), part and page (where it stands: at most PAGE documents have the same part and page).
* manifest: one JSON line; for every part its number of documents, of ids, and the Merkle root over its pages' roots, each of which is the
  root over the page's documents; over the parts' roots, the root of the whole.

A rolling hash over the last WINDOW ids places the cuts, so equal passages give equal chunks wherever they stand. Every reader checks
each chunk against its digest and each document against its root.

Writing takes one pass over the texts. A task stores its documents' recipes and, once, each chunk that it meets, in a table that goes when
the store is done. Of chunks that several tasks met, the one with the smallest number stays: digests and numbers are shuffled, contents
never are. So a passage that a third of the documents share is stored once by each task first, not once by each document.

Edge cases: a null text counts as empty and has only the end id; a null doc_id comes first; rows with the same doc_id each keep their
own place, in the order of their content; an empty table gives an empty store. Other columns are ignored; doc_id may have any type that
can be ordered.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, drop_path, portions, running_sums, scratch
from .tokens import listed, word_cache

WINDOW, LEAST, MOST, MEAN_BITS = 8, 64, 2048, 8
PAGE = 4096
#: Words whose ids a Python worker keeps, some 100 MB: with 600,000, half of the words that were met before had been forgotten.
WORDS = 1_500_000
_MULTIPLIER = 0x9E3779B97F4A7C15


def marks(ids: np.ndarray) -> np.ndarray:
    """Where the hash of the WINDOW ids up to there has MEAN_BITS zero bits on top: a chunk may end there."""
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULTIPLIER)
        mixed ^= mixed >> np.uint64(29)
        roll, span = mixed, 1
        while span < WINDOW:  # the hash of twice as many ids: theirs, and that of as many before, one power further
            before, roll = roll, roll.copy()
            roll[span:] += before[:-span] * np.uint64(pow(_MULTIPLIER, span, 1 << 64))
            span *= 2
        roll *= np.uint64(_MULTIPLIER)
    return np.flatnonzero(roll >> np.uint64(64 - MEAN_BITS) == 0) + 1


def ends(first: int, end: int, may: list[int]) -> list[int]:
    """Ends of the chunks of a document's ids, first to end, LEAST to MOST ids apart. may: the marks after first and before end.

    As LEAST exceeds WINDOW, no cut looks at ids before the document.
    """
    out, last = [], first
    for m in [*may, end]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST or m == end and m > last:
            out.append(m)
            last = m
    return out or [end]


def cuts(ids: np.ndarray) -> list[int]:
    may = marks(ids)
    return ends(0, len(ids), may[may < len(ids)].tolist())


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; a leaf without a partner moves up as it is. Leaves and nodes are hashed apart."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=20).digest() for x in leaves] or [hashlib.blake2b(b"", digest_size=20).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=20).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _pack(ids: np.ndarray) -> bytes:
    return b"\2" + ids.astype("<u2").tobytes() if len(ids) == 0 or ids.max() < 1 << 16 else b"\4" + ids.tobytes()


def _unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


def _digest(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=20).digest()


def write(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", end_id: int = 2) -> None:
    """Encodes docs (doc_id, text) and writes the store to path."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    held = f"doc_id {id_type}, n_tokens long, digests array<binary>, root binary, first long, fresh array<binary>, payloads array<binary>"

    def encode(batches):
        from pyspark import TaskContext

        words, met = word_cache(tokenizer, kind, WORDS), set()
        number = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        for b in portions(batches, 1):
            roots, chunks, firsts, digests, fresh, payloads, n_fresh = [], [0], [], [], [], [], [0]
            encoded = [x + end for x in words.ids(listed(b.column(1)))]
            sizes = [len(x) // 4 for x in encoded]
            raw = b"".join(encoded)
            ids = np.frombuffer(raw, "<u4")
            small = ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else None
            may, last = marks(ids), 0
            places = np.searchsorted(may, np.cumsum([0, *sizes]), "right").tolist()
            may = may.tolist()
            for k, size in enumerate(sizes):
                firsts.append(number + len(fresh))
                till = last + size
                for stop in ends(last, till, [m for m in may[places[k] : places[k + 1]] if m < till]):
                    digests.append(d := _digest(raw[4 * last : 4 * stop]))
                    if d not in met:
                        if len(met) >= 500_000:
                            met.clear()
                        met.add(d)
                        fresh.append(d)
                        payloads.append(b"\2" + small[2 * last : 2 * stop] if small else _pack(ids[last:stop]))
                    last = stop
                roots.append(merkle(digests[chunks[-1] :]))
                chunks.append(len(digests))
                n_fresh.append(len(fresh))
            number += len(fresh)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.binary())) for at, x in ((chunks, digests), (n_fresh, fresh), (n_fresh, payloads))]
            cols = [b.column(0), pa.array(sizes, pa.int64()), lists[0], pa.array(roots, pa.binary()), pa.array(firsts, pa.int64()), *lists[1:]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "digests", "root", "first", "fresh", "payloads"])

    work = scratch(spark, "encoded")
    docs.select("doc_id", "text").mapInArrow(encode, held).write.option("compression", "snappy").parquet(work)
    done = spark.read.schema(held).parquet(work)

    # numbers of chunks: no two stored chunks share one
    each = done.select("first", F.posexplode("fresh").alias("pos", "digest")).select((F.col("first") + F.col("pos")).alias("number"), "digest")
    several = each.groupBy("digest").agg(F.min("number").alias("least"), F.count("*").alias("times")).where("times > 1")
    again = checkpoint(each.join(several.select("digest", "least"), "digest").where("number > least").select("number"))
    few = again.count() <= 1 << 20  # eight bytes each; beyond that, the join is by shuffle
    full = done.select("first", F.posexplode(F.arrays_zip("fresh", "payloads")).alias("pos", "chunk"))
    full = full.select((F.col("first") + F.col("pos")).alias("number"), F.col("chunk.fresh").alias("digest"), F.col("chunk.payloads").alias("payload"))
    chunks = full.join(F.broadcast(again) if few else again, "number", "left_anti")
    chunks.select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/chunks")

    recipes = running_sums(done.select("doc_id", "n_tokens", "digests", "root"), [F.col("doc_id").asc_nulls_first(), F.col("digests")], "n_tokens", "start")
    row = F.monotonically_increasing_id()  # 33 bits for rows within a partition, the partition's number above
    recipes = recipes.withColumns({"part": F.shiftright(row, 33).cast("int"), "page": F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / PAGE)})
    recipes.select("doc_id", "start", "n_tokens", "digests", "root", "part", "page").write.parquet(f"{path}/recipes")
    drop_path(spark, work)
    parts = sorted((r.asDict() for r in _part_roots(_recipe_rows(spark, path)).collect()), key=lambda r: r["first"])  # a row for each part
    root = merkle([bytes(r["root"]) for r in parts])
    said = {"window": WINDOW, "least": LEAST, "most": MOST, "mean_bits": MEAN_BITS, "page": PAGE, "end_id": end_id, "id_type": id_type}
    said |= {"documents": sum(r["documents"] for r in parts), "ids": sum(r["ids"] for r in parts), "root": root.hex(), "parts": [r | {"root": bytes(r["root"]).hex()} for r in parts]}
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def _recipe_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("start long, n_tokens long, root binary, part int, page long").parquet(f"{path}/recipes")


def _part_roots(recipes: DataFrame) -> DataFrame:
    """(first, documents, ids, root) of each part: over its pages, of at most PAGE documents each. A leaf is a document's root and start."""

    def page_root(f):
        f = f.sort_values("start")
        leaves = [bytes(r) + int(s).to_bytes(8, "little") for r, s in zip(f["root"], f["start"])]
        return f.iloc[:1][["part", "page"]].assign(first=f["start"].iloc[0], documents=len(f), ids=int(f["n_tokens"].sum()), root=merkle(leaves))

    def part_root(f):
        f = f.sort_values("page")
        return f.iloc[:1][["first"]].assign(documents=int(f["documents"].sum()), ids=int(f["ids"].sum()), root=merkle([bytes(r) for r in f["root"]]))

    pages = recipes.groupBy("part", "page").applyInPandas(page_root, "part int, page long, first long, documents long, ids long, root binary")
    return pages.groupBy("part").applyInPandas(part_root, "first long, documents long, ids long, root binary")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n, crc, ids binary) of every chunk, each checked against its digest."""

    def check(batches):
        for b in batches:
            digests, payloads = listed(b.column("digest")), listed(b.column("payload"))
            raws = [_unpack(p).tobytes() for p in payloads]
            if any(_digest(r) != d for r, d in zip(raws, digests)):
                raise ValueError(f"{path}: a chunk does not match its digest")
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([len(r) // 4 for r in raws], pa.int64()), pa.array([zlib.crc32(r) for r in raws], pa.int64()), pa.array(raws, pa.binary())], names=["digest", "n", "crc", "ids"])

    raw = spark.read.schema("digest binary, payload binary").parquet(f"{path}/chunks")
    return raw.mapInArrow(check, "digest binary, n long, crc long, ids binary")


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    kinds = f"doc_id {manifest(spark, path)['id_type']}, start long, n_tokens long, digests array<binary>, root binary, part int, page long"
    return spark.read.schema(kinds).parquet(f"{path}/recipes")


def verify(spark: SparkSession, path: str) -> dict:
    """The manifest, after its roots were computed again from the recipes."""
    said = manifest(spark, path)
    found = sorted(((r["first"], r["documents"], r["ids"], bytes(r["root"]).hex()) for r in _part_roots(_recipe_rows(spark, path)).collect()))
    if found != [(r["first"], r["documents"], r["ids"], r["root"]) for r in said["parts"]] or merkle([bytes.fromhex(r[3]) for r in found]).hex() != said["root"]:
        raise ValueError(f"{path}: the recipes do not match the manifest")
    return said


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<long>): every document put together again from its chunks."""
    recipes = read_recipes(spark, path)

    def join(f):
        import pandas as pd

        f = f.sort_values("pos")
        return pd.DataFrame({"start": f["start"].iloc[:1], "ids": [np.frombuffer(b"".join(map(bytes, f["ids"])), "<u4").astype(np.int64).tolist()]})

    parts = recipes.select("start", F.posexplode("digests").alias("pos", "digest")).join(read_chunks(spark, path), "digest")
    whole = parts.groupBy("start").applyInPandas(join, "start long, ids array<long>")
    return recipes.select("doc_id", "start").join(whole, "start").select("doc_id", "start", "ids")


def _times(a, b):
    """Product of two polynomials modulo that of CRC-32, bits in reverse as CRC-32 has them; of numbers or of arrays of them."""
    a, b = np.asarray(a, np.uint32), np.asarray(b, np.uint32)
    out = np.zeros(np.broadcast(a, b).shape, np.uint32)
    for bit in range(31, -1, -1):
        out ^= b * (a >> np.uint32(bit) & np.uint32(1))
        b = (b >> np.uint32(1)) ^ np.uint32(0xEDB88320) * (b & np.uint32(1))
    return out


def _shift(n_bytes: np.ndarray) -> np.ndarray:
    """x to the power 8 * n_bytes."""
    sizes, at = np.unique(n_bytes, return_inverse=True)
    out, square, left = np.full(len(sizes), 0x80000000, np.uint32), np.uint32(0x00800000), sizes.copy()  # 1 and x^8
    while left.any():
        out = np.where(left & 1, _times(out, square), out).astype(np.uint32)
        square, left = _times(square, square), left >> 1
    return out[at]


def combined(crcs: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of parts in a row, from the parts' own; sizes: their bytes, counts: parts of each run."""
    powers, firsts = _shift(sizes), np.cumsum(counts) - counts
    out = np.zeros(len(counts), np.uint32)
    for k in range(int(counts.max(initial=0))):
        on = counts > k
        at = firsts[on] + k
        out[on] = _times(powers[at], out[on]) ^ crcs[at].astype(np.uint32)
    return out


def digests_of_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from a store's files.

    A document's CRC-32 follows from those of its chunks, so each chunk is read and checked once, and only its digest, length and
    checksum travel to the documents that use it. read_documents puts whole documents together, which moves every id twice.
    """
    recipes = read_recipes(spark, path)
    schema = f"doc_id {recipes.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long"

    def combine(batches):
        for b in batches:
            parts = b.column("parts")
            counts, flat = np.diff(parts.offsets.to_numpy()), parts.flatten()
            pos, n, crc = (flat.field(c).to_numpy() for c in ("pos", "n", "crc"))
            order = np.lexsort((pos, np.repeat(np.arange(len(counts)), counts)))
            digests = listed(flat.field("digest").take(pa.array(order)))
            ends = np.cumsum(counts).tolist()
            for end, size, root in zip(ends, counts.tolist(), listed(b.column("root"))):
                if merkle(digests[end - size : end]) != root:
                    raise ValueError(f"{path}: a document does not match its root")
            sizes = np.add.reduceat(n[order], np.array(ends) - counts) if len(counts) else np.zeros(0, np.int64)
            crcs = combined(crc[order], 4 * n[order], counts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(sizes, pa.int64()), pa.array(crcs.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    known = read_chunks(spark, path).select("digest", "n", "crc")
    first = F.col("pos") == 0  # a document's own columns travel once, with its first chunk
    parts = recipes.select("doc_id", "start", "root", F.posexplode("digests").alias("pos", "digest"))
    parts = parts.select("start", "pos", "digest", F.when(first, F.col("root")).alias("root"), F.when(first, F.col("doc_id")).alias("doc_id")).join(known, "digest")
    docs = parts.groupBy("start").agg(F.max("doc_id").alias("doc_id"), F.max("root").alias("root"), F.collect_list(F.struct("pos", "digest", "n", "crc")).alias("parts"))
    return docs.select("doc_id", "start", "root", "parts").mapInArrow(combine, schema)
