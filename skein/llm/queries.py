"""The queries op1_ to op10_, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, mixing, neighbours, packing, pii, quality, rules, simhash, token_store, toxicity
from .common import fold, scratch, table


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    token_store.verify(spark, path)
    return token_store.digests_of_documents(spark, path)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _held_out(found: DataFrame, parts: int, part: int, threshold: float) -> DataFrame:
    """The columns of a scored query: the fold, and the class at the threshold."""
    return found.select("doc_id", (fold(F.col("doc_id"), parts) == part).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, take=fold(F.col("doc_id"), 5) != 0)
    return _held_out(toxicity.score(docs, model), 5, 0, 0.5)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, take=fold(F.col("doc_id"), 4) != 2)
    return _held_out(quality.score(docs, model), 4, 2, 0.7)


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rules.measured(table(spark, sf_dir, "documents"))
    return rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels"))).drop("anomaly")


QUERIES = {"op1_toxicity": op1_toxicity, "op2_simhash": op2_simhash, "op3_token_store": op3_token_store, "op4_mixing": op4_mixing, "op5_pii": op5_pii, "op6_line_dedup": op6_line_dedup, "op7_neighbours": op7_neighbours, "op8_packing": op8_packing, "op9_quality": op9_quality, "op10_rules": op10_rules}
ORACLE_SQL = {"op6_line_dedup": line_dedup.ORACLE, "op4_mixing": mixing.ORACLE}
