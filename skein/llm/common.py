"""What the operators of this subpackage share: tables, checkpoints, folds and running sums."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Words of a text are runs of characters other than ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"
#: bytes.translate table: A-Z become a-z; other bytes, white space included, stay.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: What a line loses at both ends before lines are compared.
STRIP = " \t\n\x0b\x0c\r"


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver has it; a cluster gets it by --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only where it is unset in local mode (tests), a temporary one."""
    importable(spark)
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not there and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it names the folder that the driver and all executors share")
    if not there:
        there = tempfile.mkdtemp(prefix="skein-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(there)
    return there


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor takes nothing with it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception as e:  # noqa: BLE001  a session that has stopped cannot delete; the folder is a scratch folder
        print(f"scratch folder {path} stays: {type(e).__name__}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when Python ends (or earlier by drop_path)."""
    path = f"{shared_dir(spark).rstrip('/')}/skein-{name}-{uuid.uuid4().hex}"
    atexit.register(lambda: spark.sparkContext._jsc and drop_path(spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def slices(batches, rows: int = 512):
    """Arrow batches in parts of at most rows rows, so that what Python makes of a batch stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def portions(batches, column: int, size: int = 8 << 20):
    """Arrow batches in parts of about size bytes of a string column; a longer text is a part of its own."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, end - at)
            at = end


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % parts


def sample_of_labels(labels: DataFrame, label: str, take: Column, limit: int) -> DataFrame:
    """At most limit labelled rows (doc_id, y) of those for which take holds, in the order of a hash of their id.

    Rows without id or label are left out; an id with several labels takes the largest.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & take)
    y = y.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, take: Column, limit: int) -> DataFrame:
    """(doc_id, text, y) of a bounded sample of labelled rows: one text for each id, that with the smallest hash, so limit rows at most.

    The sample of labels has at most limit short rows, so it is broadcast.
    """
    y = sample_of_labels(labels.select("doc_id", label), label, take, limit)
    found = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))


def numbered(docs: DataFrame, name: str = "__row") -> DataFrame:
    """docs with a number for each row. docs must give the same rows in the same partitions each time it is read, as files do."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def running_sums(df: DataFrame, order: list[Column], value: str, out: str, group: str | None = None) -> DataFrame:
    """df with out: the sum of value over all rows before this one, in the given order (within its group).

    The rows are dealt out by ranges of the order, so that a hot group spreads over many tasks; each task adds up its own rows, and
    the driver only adds the totals by task (and group, which the order begins with, so that ranges share a group only where they meet):
    no more numbers than there are partitions and groups together.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = checkpoint(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    by = ["__part", *([group] if group else [])]
    found = part.groupBy(*by).agg(F.sum(value).alias("__sum")).collect()
    before: dict = defaultdict(int)
    start: dict = {}
    for row in sorted(found, key=lambda r: r["__part"]):
        g = row[group] if group else None
        start[row["__part"], g] = before[g]
        before[g] += row["__sum"] or 0
    schema = part.drop("__part").withColumn(out, F.lit(0).cast("long")).schema

    def add(batches):
        at = dict(start)
        for b in batches:
            t = pa.Table.from_batches([b])
            groups = t.column(group).to_pylist() if group else [None] * t.num_rows
            sums = []
            for key, v in zip(zip(t.column("__part").to_pylist(), groups), t.column(value).to_pylist()):
                sums.append(at[key])
                at[key] += v or 0
            yield from t.drop_columns(["__part"]).append_column(out, pa.array(sums, pa.int64())).to_batches()

    return part.mapInArrow(add, schema)
