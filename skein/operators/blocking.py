"""Candidates from several channels, and how many of the true pairs they hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANNELS = ("sparse", "sparse_name", "dense")


def combine(channels: dict[str, DataFrame]) -> DataFrame:
    """(q, p, source, <ch>_score, <ch>_rank...) of the union of channels (q, p, source, score, rank): best score and rank, rank 0 if absent."""
    parts = [df.select("q", "p", "source", F.col("score").alias(f"{c}_score"), F.col("rank").alias(f"{c}_rank")) for c, df in channels.items()]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    aggs = [x for c in channels for x in (F.max(f"{c}_score").alias(f"{c}_score"), F.coalesce(F.min(f"{c}_rank"), F.lit(0)).cast("int").alias(f"{c}_rank"))]
    return union.groupBy("q", "p", "source").agg(*aggs)


def candidate_lists(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_ids) for every query, ids by source, then id, joined by commas; '' without any."""
    lists = pairs.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "p"))), lambda x: x["p"]), ",").alias("ids"))
    return queries.select(F.col("entity_id").alias("source1_entity_id")).join(lists, F.col("source1_entity_id") == F.col("q"), "left").select("source1_entity_id", F.coalesce("ids", F.lit("")).alias("candidate_entity_ids"))


def found_truth(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """truth (q, p, country) with hit and every column of pairs, ranks 0 where absent; pairs beyond the pool count as missed."""
    ranks = [c for c in pairs.columns if c.endswith("_rank")]
    joined = truth.join(pairs.drop("source").withColumn("hit", F.lit(True)), ["q", "p"], "left")
    return joined.withColumns({"hit": F.coalesce("hit", F.lit(False)), "source": F.split_part("p", F.lit("-"), F.lit(1))} | {c: F.coalesce(c, F.lit(0)) for c in ranks})


def recall(hits: DataFrame) -> DataFrame:
    """(by, value, n, recall): overall, by source and by country, 4 places."""
    sets = hits.select("source", "country", F.col("hit").cast("double").alias("h")).groupingSets([[], ["source"], ["country"]], "source", "country").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.round(F.avg("h"), 4).alias("recall"))
    by = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "source").otherwise("country")
    return sets.select(by.alias("by"), F.coalesce("source", "country", F.lit("")).alias("value"), "n", "recall")


def recall_by_channel(hits: DataFrame, channels: list[str]) -> DataFrame:
    """(channel, source, n, recall, unique_hits): unique hits were found by no other channel. source '' is all."""
    others = {c: reduce(lambda a, b: a | b, [F.col(f"{o}_rank") > 0 for o in channels if o != c], F.lit(False)) for c in channels}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), (F.col(f"{c}_rank") > 0).alias("h"), ((F.col(f"{c}_rank") > 0) & ~others[c]).alias("u")) for c in channels])).alias("x")
    rows = hits.select("source", each).select("source", "x.*")
    return rows.withColumn("source", F.explode(F.array("source", F.lit("")))).groupBy("channel", "source").agg(F.count("*").alias("n"), F.round(F.avg(F.col("h").cast("double")), 4).alias("recall"), F.sum(F.col("u").cast("long")).alias("unique_hits"))


def recall_at_k(hits: DataFrame, channels: list[str], ks=(1, 5, 10, 20)) -> DataFrame:
    """(channel, k, recall)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(k).alias("k"), F.col(f"{c}_rank").between(1, k).alias("h")) for c in channels for k in ks])).alias("x")
    return hits.select(each).select("x.*").groupBy("channel", "k").agg(F.round(F.avg(F.col("h").cast("double")), 4).alias("recall"))


def entity_full_recall(hits: DataFrame) -> DataFrame:
    """(n_entities, entity_full_recall): the share of queries all of whose true pairs were found."""
    each = hits.groupBy("q").agg(F.bool_and("hit").alias("all"))
    return each.agg(F.count("*").alias("n_entities"), F.round(F.avg(F.col("all").cast("double")), 4).alias("entity_full_recall"))


def reduction_ratio(records: DataFrame, pairs: DataFrame, query_source: str = "S1") -> DataFrame:
    """(n_pairs, n_queries, n_pool, reduction_ratio, reduction_ratio_within_country)."""
    is_q = (F.col("source") == query_source).cast("long")
    by = records.groupBy("ckey").agg(F.sum(is_q).alias("nq"), F.sum(1 - is_q).alias("np"))
    all_ = by.agg(F.sum("nq").alias("n_queries"), F.sum("np").alias("n_pool"), F.sum(F.col("nq") * F.col("np")).alias("within"))
    n = pairs.agg(F.count("*").alias("n_pairs"))
    ratio = lambda d: F.round(1 - F.col("n_pairs") / F.greatest(d, F.lit(1)), 6)
    return n.crossJoin(all_).select("n_pairs", "n_queries", "n_pool", ratio(F.col("n_queries") * F.col("n_pool")).alias("reduction_ratio"), ratio(F.col("within")).alias("reduction_ratio_within_country"))


def candidate_quantiles(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(avg_candidates, s1_with_no_candidates, q0, q50, q90, q100) over all queries, those without candidates included."""
    per = queries.select(F.col("entity_id").alias("q")).join(pairs.groupBy("q").agg(F.count("*").alias("n")), "q", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(F.round(F.avg("n"), 2).alias("avg_candidates"), F.sum((F.col("n") == 0).cast("long")).alias("s1_with_no_candidates"), F.percentile("n", F.array(*map(F.lit, (0.0, 0.5, 0.9, 1.0)))).alias("p")).select("avg_candidates", "s1_with_no_candidates", *[F.col("p")[i].alias(c) for i, c in enumerate(("q0", "q50", "q90", "q100"))])


def candidates_by_source(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, avg_candidates)."""
    n = queries.agg(F.count("*").alias("nq"))
    return pairs.groupBy("source").agg(F.count("*").alias("n")).crossJoin(n).select("source", F.round(F.col("n") / F.greatest("nq", F.lit(1)), 2).alias("avg_candidates"))
