"""Which candidates go on: the best few above a floor, and none where even the best is doubtful."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import f05_of

KS, FLOORS = (1, 2, 3, 5, 8, 10), (0.01, 0.02, 0.05, 0.1, 0.2)


def ranked(pairs: DataFrame) -> DataFrame:
    """pairs (q, p, score) with rk (1 is best, ties by p) and best."""
    w = W.partitionBy("q")
    return pairs.withColumns({"rk": F.row_number().over(w.orderBy(F.col("score").desc(), "p")), "best": F.max("score").over(w)})


def keep_top(pairs: DataFrame, top_k: int, floor: float, no_match: float) -> DataFrame:
    """ranked(pairs) with keep: among the top_k, not below floor, and the query's best not below no_match."""
    return ranked(pairs).withColumn("keep", (F.col("rk") <= top_k) & (F.col("score") >= floor) & (F.col("best") >= no_match))


def _per_query(kept: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    return kept.groupBy(*by, "q").agg(F.count("*").alias("n"), F.sum("label").alias("tp"))


def _stats(d: DataFrame, by: list[str]) -> DataFrame:
    """d: by, q, n_true, n (kept), tp."""
    match, single = F.col("n_true") > 0, F.col("n_true") == 0
    n = lambda c: F.sum(c.cast("long"))
    at_least_1 = lambda c: F.greatest(c, F.lit(1))
    return d.groupBy(*by).agg(
        F.sum("n").alias("pairs_passed"), F.round(F.sum("n") / at_least_1(F.count("*")), 3).alias("avg_pairs_per_s1"), F.round(F.sum("tp") / at_least_1(F.sum("n_true")), 4).alias("true_pairs_retained"),
        n(match & (F.col("tp") == 0)).alias("entities_lost_all_true"), F.round(n(match & (F.col("tp") == 0)) / at_least_1(n(match)), 4).alias("entities_lost_all_true_pct"),
        F.round(n(single & (F.col("n") == 0)) / at_least_1(n(single)), 4).alias("singletons_flagged_empty"), n(match & (F.col("n") == 0)).alias("matched_flagged_empty"),
        F.round(F.avg(f05_of(F.col("tp"), F.col("tp"), F.col("n_true"))), 4).alias("oracle_macro_f05"),
    )


def filter_stats(kept: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of eight figures about kept pairs (q, label) against truth (q, n_true)."""
    return _stats(truth.join(_per_query(kept, truth, []), "q", "left").fillna(0, ["n", "tp"]), [])


def filter_sweep(pairs: DataFrame, truth: DataFrame, ks: Sequence[int] = KS, floors: Sequence[float] = FLOORS) -> DataFrame:
    """filter_stats for every top_k and floor (which is also the least best score): pairs are ranked once."""
    rules = F.array(*[F.struct(F.lit(k).alias("top_k"), F.lit(float(f)).alias("floor")) for k in ks for f in floors])
    r = ranked(pairs).withColumn("x", F.explode(F.filter(rules, lambda x: (F.col("rk") <= x["top_k"]) & (F.col("score") >= x["floor"])))).select("q", "label", "x.*")
    every = truth.withColumn("x", F.explode(rules)).select("q", "n_true", "x.*")
    by = ["top_k", "floor"]
    return _stats(every.join(_per_query(r, truth, by), [*by, "q"], "left").fillna(0, ["n", "tp"]), by)


def loss_attribution(pairs: DataFrame, kept: DataFrame, truth: DataFrame) -> DataFrame:
    """(matched, lost_at_retrieval, lost_at_filter, kept_some): where queries with a match lose all of them."""
    a = pairs.groupBy("q").agg(F.max("label").alias("there"))
    b = kept.groupBy("q").agg(F.max("label").alias("passed"))
    d = truth.where("n_true > 0").join(a, "q", "left").join(b, "q", "left").fillna(0, ["there", "passed"])
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return d.agg(F.count("*").alias("matched"), n(F.col("there") == 0).alias("lost_at_retrieval"), n((F.col("there") == 1) & (F.col("passed") == 0)).alias("lost_at_filter"), n(F.col("passed") == 1).alias("kept_some"))


def match_histogram(truth: DataFrame, most: int = 8) -> DataFrame:
    """(matches, entities): queries by number of true matches, most standing for all above."""
    return truth.groupBy(F.least("n_true", F.lit(most)).alias("matches")).agg(F.count("*").alias("entities"))


def four_places(c: Column) -> Column:
    """c with four places as C's printf and DuckDB's write it: by the exact value of the double, a tie to the even digit. Java's formatter
    rounds the shortest decimal that stands for the double, and ties up."""
    size = F.abs(c)
    low = F.floor(size * 10_000)
    big = size * 134_217_729.0  # the double in two halves, so that their products with 20,000 are exact
    high = big - (big - size)
    over = (high * 20_000.0 - (2 * low + 1).cast("double")) + (size - high) * 20_000.0  # its sign tells on which side of the middle c is
    whole = low + F.when((over > 0) | ((over == 0) & (low % 2 == 1)), 1).otherwise(0)
    digits = F.concat(F.when(c < 0, "-").otherwise(""), F.floor(whole / 10_000).cast("string"), F.lit("."), F.lpad((whole % 10_000).cast("string"), 4, "0"))
    return F.when(size < 1e8, digits).otherwise(F.format_string("%.4f", c))


def filtered_lists(queries: DataFrame, kept: DataFrame) -> DataFrame:
    """A row for each query: ids and scores of pairs with keep, best first; best score of all its pairs; 1 if nothing is kept.

    kept: the result of keep_top.
    """
    lists = kept.groupBy("q").agg(F.max("score").alias("best"), F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("rk", "p", "score")))).alias("x"))
    d = queries.select(F.col("entity_id").alias("source1_entity_id")).join(lists, F.col("source1_entity_id") == F.col("q"), "left")
    d = d.withColumn("x", F.coalesce("x", F.array().cast("array<struct<rk:int,p:string,score:double>>")))
    return d.select(
        "source1_entity_id", F.array_join(F.transform("x", lambda e: e["p"]), ",").alias("candidate_entity_ids"), F.array_join(F.transform("x", lambda e: four_places(e["score"])), ",").alias("candidate_scores"),
        four_places(F.coalesce("best", F.lit(0.0))).alias("best_score"), (F.size("x") == 0).cast("int").alias("likely_no_match"),
    )


def read_lists(lists: DataFrame) -> DataFrame:
    """(q, p, lgbm_score, lgbm_rank, lgbm_gap, n_cands, lgbm_logit, is_s3) from filtered_lists."""
    some = lists.where("candidate_entity_ids <> ''")
    x = F.posexplode(F.arrays_zip(F.split("candidate_entity_ids", ",").alias("p"), F.split("candidate_scores", ",").alias("s"))).alias("pos", "x")
    d = some.select(F.col("source1_entity_id").alias("q"), x).select("q", F.col("x.p").alias("p"), F.col("x.s").cast("double").alias("lgbm_score"), (F.col("pos") + 1).alias("lgbm_rank"))
    w = W.partitionBy("q")
    s = F.least(F.greatest("lgbm_score", F.lit(1e-4)), F.lit(1 - 1e-4))
    return d.withColumns({"lgbm_gap": F.max("lgbm_score").over(w) - F.col("lgbm_score"), "n_cands": F.count("*").over(w), "lgbm_logit": F.log(s / (1 - s)), "is_s3": F.col("p").startswith("S3-").cast("int")})
