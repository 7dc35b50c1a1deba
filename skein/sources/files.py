"""The pipeline's files: tab-separated text, Parquet and JSON, read and written through Spark only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"
FILTERED = "source1_entity_id string, candidate_entity_ids string, candidate_scores string, best_score string, likely_no_match string"
SCORES = "source1_entity_id string, candidate_entity_id string, raw_score double, normalized_score double, raw_logit double, no_match_score double, lgbm_score double, lgbm_rank int"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def require(spark: SparkSession, *paths: str | None) -> None:
    """Raises, before any work, if a path that is not None does not exist."""
    if missing := [p for p in paths if p is not None and not exists(spark, p)]:
        raise FileNotFoundError(f"missing: {', '.join(missing)}")


def read_tsv(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Every column as its schema says; empty text cells stay empty strings."""
    df = spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=False, enforceSchema=False)
    return df.fillna("", [f.name for f in df.schema if f.dataType.simpleString() == "string"])


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("emptyValue", "").option("nullValue", "").csv(path, sep="\t", header=True, quote='"', escape='"')


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(q, matched array<string>): distinct ids without empty ones, none for a query without a match. Of a query's rows, the last counts."""
    raw = read_tsv(spark, path, TRUTH).withColumn("row", F.monotonically_increasing_id())
    last = raw.groupBy("source1_entity_id").agg(F.max_by("matched_entity_ids", "row").alias("matched_entity_ids"))
    return truth_lists(last)


def truth_lists(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("source1_entity_id").alias("q"), F.array_distinct(F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")).alias("matched"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(q, p), a row for each match."""
    return truth.select("q", F.explode("matched").alias("p"))


def truth_sizes(truth: DataFrame) -> DataFrame:
    """(q, n_true), queries without a match included."""
    return truth.select("q", F.size("matched").cast("long").alias("n_true"))


def write_detail(pairs: DataFrame, path: str) -> None:
    pairs.withColumnsRenamed({"q": "source1_entity_id", "p": "candidate_entity_id"}).drop("source").write.mode("overwrite").parquet(path)


def read_detail(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.parquet(path).withColumnsRenamed({"source1_entity_id": "q", "candidate_entity_id": "p"}).drop("dense_score")
    return d.withColumn("source", F.split_part("p", F.lit("-"), F.lit(1))).fillna(0, [c for c in d.columns if c.endswith("_rank")])


def write_idf(idf: DataFrame, path: str) -> None:
    """idf: field, ckey, gram, df, n_docs, idf. In folders by field, sorted by country: a folder's name could not tell '' from null."""
    idf.sortWithinPartitions("field", "ckey").write.mode("overwrite").partitionBy("field").parquet(path)


def read_idf(spark: SparkSession, path: str, field: str) -> DataFrame:
    return spark.read.schema("gram string, df long, n_docs long, idf double, field string, ckey string").parquet(path).where(F.col("field") == field).drop("field")


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores at 6 places, in the order of query and raw score; columns that begin with _ stay out."""
    d = scores.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in scores.dtypes if not c.startswith("_")])
    write_tsv(d.withColumnsRenamed({"q": "source1_entity_id", "p": "candidate_entity_id"}).orderBy("source1_entity_id", F.col("raw_score").desc()), path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"')
    if missing := [c for c in ("source1_entity_id", "candidate_entity_id", "raw_score", "normalized_score") if c not in d.columns]:
        raise ValueError(f"{path} lacks columns {missing}")
    return read_tsv(spark, path, SCORES if len(d.columns) == 8 else ", ".join(f"{c} {'string' if c.endswith('_id') else 'double'}" for c in d.columns)).withColumnsRenamed({"source1_entity_id": "q", "candidate_entity_id": "p"})


def write_json(spark: SparkSession, said: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(said, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))


def embeddings_if_complete(spark: SparkSession, path: str | None, records: DataFrame) -> DataFrame | None:
    """(entity_id, embedding) if the file is there and has every record; None otherwise, and nothing is computed in its place."""
    if path is None or not exists(spark, path):
        return None
    e = spark.read.parquet(path).select("entity_id", "embedding")
    lacking = records.select("entity_id").join(e, "entity_id", "left_anti")
    return e if lacking.isEmpty() else None
