"""The driver's tables in the roles of record linkage: entities, embeddings, scored pairs, truth."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    env = spark.sparkContext.environment  # Python workers on this machine import the package from here; a cluster gets it by --py-files
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(k):
    """At least six digits: lpad to a fixed length would also shorten."""
    digits = k.cast("string")
    return F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0"))


def entity_id(key: str):
    k = F.col(key)
    return F.concat(F.lit("S"), (k % 3 + 1).cast("string"), F.lit("-"), padded(k))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, source, business_name, business_address, country, conv_id, turn: every turn of a conversation is a record, its first
    sentence the name, the rest of its text the address, its region that of the conversation. Whole texts, all rows."""
    text = F.coalesce("text", F.lit(""))
    name = F.substring_index(text, ". ", 1)
    number = (F.col("turn") % 3 + 1).cast("string")
    turns = table(spark, sf_dir, "conversations").join(F.broadcast(table(spark, sf_dir, "region")), F.col("conv_id") % 5 == F.col("r_regionkey"), "left")
    return turns.select(
        F.concat(F.lit("S"), number, F.lit("-"), padded(F.col("conv_id")), F.lit("-"), F.col("turn").cast("string")).alias("entity_id"), F.concat(F.lit("S"), number).alias("source"),
        name.alias("business_name"), F.substr(text, F.length(name) + 3).alias("business_address"), F.coalesce("r_name", F.lit("")).alias("country"), "conv_id", "turn",
    )


def whole_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records, the first line as the name and the rest as the address, for the normalisation queries."""
    line = F.substring_index("text", "\n", 1)
    rest = F.substr("text", F.length(line) + 2)
    return table(spark, sf_dir, "documents").select(
        entity_id("doc_id").alias("entity_id"), F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string")).alias("source"),
        line.alias("business_name"), rest.alias("business_address"), F.col("lang").alias("country"), "doc_id",
    )


ENTITIES = """entities AS (
  SELECT 'S' || (turn % 3 + 1) || '-' || lpad(conv_id::VARCHAR, greatest(6, length(conv_id::VARCHAR))::INT, '0') || '-' || turn AS entity_id, 'S' || (turn % 3 + 1) AS source,
         name AS business_name, substr(text, length(name) + 3) AS business_address, coalesce(r_name, '') AS country, conv_id, turn
  FROM (SELECT *, string_split(text, '. ')[1] AS name FROM (SELECT conv_id, turn, coalesce(text, '') AS text, r_name FROM conversations LEFT JOIN region ON conv_id % 5 = r_regionkey)))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain records for the n-gram queries: entity_id, source, ckey, sparse_text, name_text (lower case, white space as it is)."""
    e = entities(spark, sf_dir)
    whole = F.concat("business_name", F.lit(" "), "business_address")
    return e.select("entity_id", "source", N.country(F.col("country")).alias("ckey"), F.lower(whole).alias("sparse_text"), F.lower("business_name").alias("name_text"))


RECORDS = f"""{ENTITIES}, records AS (
  SELECT entity_id, source, lower(trim(country)) AS ckey, lower(business_name || ' ' || business_address) AS sparse_text, lower(business_name) AS name_text FROM entities)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, p, country): truth for the recall queries, the two turns that follow a turn of S1."""
    e = entities(spark, sf_dir).withColumn("country", N.country(F.col("country")))
    a = e.where("source = 'S1'").select(F.col("entity_id").alias("q"), "conv_id", F.explode(F.array(F.col("turn") + 1, F.col("turn") + 2)).alias("turn"), "country")
    return a.join(e.select(F.col("entity_id").alias("p"), "conv_id", "turn"), ["conv_id", "turn"]).select("q", "p", "country")


REPLIES = """truth_pairs AS (
  SELECT a.entity_id AS q, b.entity_id AS p, lower(trim(a.country)) AS country FROM entities a JOIN entities b ON a.conv_id = b.conv_id AND b.turn IN (a.turn + 1, a.turn + 2) WHERE a.source = 'S1')"""


def dense_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(entity_id("vec_id").alias("entity_id"), F.concat(F.lit("S"), (F.col("vec_id") % 3 + 1).cast("string")).alias("source"), F.col("label").cast("string").alias("ckey"), "embedding")


DENSE = """dense AS (
  SELECT 'S' || (vec_id % 3 + 1) || '-' || lpad(vec_id::VARCHAR, greatest(6, length(vec_id::VARCHAR))::INT, '0') AS entity_id, 'S' || (vec_id % 3 + 1) AS source, label::VARCHAR AS ckey, embedding FROM embeddings)"""


REACH = 8


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q, p, source, ckey, gap, a_name, b_name, a_addr, b_addr: sorted neighbourhoods. Records of a country whose names begin with the same
    character are put in the order of their names, and every S1 record meets those of other sources at most REACH places away."""
    e = entities(spark, sf_dir).select("entity_id", "source", F.lower("business_name").alias("name"), F.lower("business_address").alias("addr"), N.country(F.col("country")).alias("ckey"))
    e = e.withColumn("begins", F.substring("name", 1, 1))
    e = e.withColumn("place", F.row_number().over(W.partitionBy("ckey", "begins").orderBy("name", "entity_id")))
    near = F.explode(F.sequence(F.col("place") - REACH, F.col("place") + REACH))
    a = e.where("source = 'S1'").select("ckey", "begins", F.col("place").alias("own"), F.col("entity_id").alias("q"), F.col("name").alias("a_name"), F.col("addr").alias("a_addr"), near.alias("place"))
    b = e.where("source <> 'S1'").select("ckey", "begins", "place", "source", F.col("entity_id").alias("p"), F.col("name").alias("b_name"), F.col("addr").alias("b_addr"))
    return a.join(b, ["ckey", "begins", "place"]).select("q", "p", "source", "ckey", F.abs(F.col("place") - F.col("own")).alias("gap"), "a_name", "b_name", "a_addr", "b_addr")


SIDES = f"""sides AS (
  SELECT *, row_number() OVER (PARTITION BY ckey, begins ORDER BY name, entity_id) AS place
  FROM (SELECT entity_id, source, lower(business_name) AS name, lower(business_address) AS addr, lower(trim(country)) AS ckey, substr(lower(business_name), 1, 1) AS begins FROM entities)
), pairs AS (
  SELECT a.entity_id AS q, b.entity_id AS p, b.source, a.ckey, abs(a.place - b.place)::INT AS gap, a.name AS a_name, b.name AS b_name, a.addr AS a_addr, b.addr AS b_addr
  FROM sides a JOIN sides b ON a.ckey = b.ckey AND a.begins = b.begins AND a.source = 'S1' AND b.source <> 'S1' AND b.place BETWEEN a.place - {REACH} AND a.place + {REACH})"""
PAIRS = f"{ENTITIES}, {SIDES}"


def ascii_words(c):
    return F.array_distinct(F.filter(F.split(c, "[^a-z]+"), lambda t: t != ""))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q, p, source, ckey, score, label of pairs()."""
    return labelled(pairs(spark, sf_dir)).select("q", "p", "source", "ckey", "score", "label")


def labelled(pairs: DataFrame) -> DataFrame:
    """pairs with score and label: the Jaccard similarity of names' words, and a label drawn by hash, likelier the higher the score."""
    a, b = ascii_words(F.col("a_name")), ascii_words(F.col("b_name"))
    d = pairs.withColumn("score", F.round(F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0)), 6))
    draw = F.conv(F.substring(F.md5(F.concat("q", "p")), 1, 8), 16, 10).cast("long") % 1000
    return d.withColumn("label", (draw < F.floor(10 + 1500 * F.col("score"))).cast("int"))


SCORED = f"""{PAIRS}, worded AS (
  SELECT q, p, source, ckey, list_distinct(list_filter(regexp_split_to_array(a_name, '[^a-z]+'), lambda t: t <> '')) AS a,
         list_distinct(list_filter(regexp_split_to_array(b_name, '[^a-z]+'), lambda t: t <> '')) AS b FROM pairs
), scored AS (
  SELECT q, p, source, ckey, score, (('0x' || substr(md5(q || p), 1, 8))::BIGINT % 1000 < floor(10 + 1500 * score))::INT AS label
  FROM (SELECT *, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(a || b)), 0), 0.0), 6) AS score FROM worded))"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, n_true) of every S1 record: its pairs with label 1."""
    s1 = entities(spark, sf_dir).where("source = 'S1'").select(F.col("entity_id").alias("q"))
    n = scored(spark, sf_dir).groupBy("q").agg(F.sum("label").alias("n_true"))
    return s1.join(n, "q", "left").fillna(0, ["n_true"])


TRUTH = f"""{SCORED}, truth AS (
  SELECT e.entity_id AS q, coalesce(sum(s.label), 0)::BIGINT AS n_true FROM entities e LEFT JOIN scored s ON e.entity_id = s.q WHERE e.source = 'S1' GROUP BY 1)"""
