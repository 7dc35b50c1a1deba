"""From probabilities to matches: scores normalised within a query, a grid of rules, and the rule's matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import f05_of

SCORE_COLUMNS, CAPS = ("raw_score", "normalized_score"), (1, 2, 3, 0)
THRESHOLDS = tuple(round(0.05 + 0.01 * i, 3) for i in range(94)) + (0.99, 0.995)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def normalized_scores(pairs: DataFrame, prob: str = "prob") -> DataFrame:
    """pairs with normalized_score and no_match_score: each candidate's odds against those of all candidates of its query and of none."""
    p = F.least(F.greatest(prob, F.lit(1e-6)), F.lit(1 - 1e-6))
    total = 1 + F.sum(p / (1 - p)).over(W.partitionBy("q"))
    return pairs.withColumns({"normalized_score": p / (1 - p) / total, "no_match_score": 1 / total})


def with_ranks(scores: DataFrame, columns=SCORE_COLUMNS) -> DataFrame:
    """scores (q, p, columns) with rank_<column>: best first, ties by raw score, then p. Of rows of the same pair, the greatest stays whole."""
    rest = [c for c in scores.columns if c not in ("q", "p")]
    best = F.struct(columns[0], *[c for c in rest if c != columns[0]])
    d = scores.groupBy("q", "p").agg(F.max(best).alias("_best")).select("q", "p", *[F.col(f"_best.{c}").alias(c) for c in rest])
    rank = lambda c: F.row_number().over(W.partitionBy("q").orderBy(F.col(c).desc(), F.col(columns[0]).desc(), "p"))
    return d.withColumns({f"rank_{c}": rank(c) for c in columns})


def check(scores: DataFrame, queries: DataFrame) -> None:
    """Raises if a column is missing or a query is unknown."""
    if missing := [c for c in ("q", "p", *SCORE_COLUMNS) if c not in scores.columns]:
        raise ValueError(f"scores lack columns {missing}")
    unknown = scores.select("q").join(queries.select(F.col("entity_id").alias("q")), "q", "left_anti")
    if first := unknown.orderBy("q").limit(3).collect():
        raise ValueError(f"scores name unknown queries, such as {[r.q for r in first]}")


def grid(scores: DataFrame, truth: DataFrame, thresholds=THRESHOLDS, caps=CAPS, columns=SCORE_COLUMNS) -> DataFrame:
    """(score_column, max_matches, threshold, macro_f05): every rule, 5 places. scores: with_ranks, with label.

    A pair only meets the thresholds that it reaches; per query and rule the counts are summed before queries without any are added in
    closed form, so the work grows with the pairs that pass, not with queries times rules.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("score_column"), F.col(c).alias("s"), F.col(f"rank_{c}").alias("r")) for c in columns])).alias("x")
    d = scores.select("q", "label", each).select("q", "label", "x.*").join(truth, "q")
    ts, cs = F.array(*[F.lit(float(t)) for t in thresholds]), F.array(*map(F.lit, caps))
    d = d.withColumn("max_matches", F.explode(F.filter(cs, lambda c: (c == 0) | (F.col("r") <= c)))).withColumn("threshold", F.explode(F.filter(ts, lambda t: F.col("s") >= t)))
    per = d.groupBy("score_column", "max_matches", "threshold", "q").agg(F.first("n_true").alias("n_true"), F.count("*").alias("n_pred"), F.sum("label").alias("tp"))
    # a query with a prediction scores by it, one without scores 1 if it has no match
    got = per.groupBy("score_column", "max_matches", "threshold").agg(F.sum(f05_of(F.col("tp"), F.col("n_pred"), F.col("n_true"))).alias("f"), F.sum((F.col("n_true") == 0).cast("long")).alias("taken"))
    base = truth.agg(F.count("*").alias("n"), F.sum((F.col("n_true") == 0).cast("long")).alias("single"))
    rules = scores.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("score_column")).withColumn("max_matches", F.explode(cs)).withColumn("threshold", F.explode(ts))
    d = F.broadcast(rules).join(got, ["score_column", "max_matches", "threshold"], "left").fillna(0, ["f", "taken"]).crossJoin(F.broadcast(base))
    return d.select("score_column", "max_matches", "threshold", F.round((F.col("f") + F.col("single") - F.col("taken")) / F.nullif("n", F.lit(0)), 5).alias("macro_f05"))


def best_rule(rules: DataFrame) -> DataFrame:
    """The rule with the best macro F0.5; of equals the one with the higher threshold, then with the tighter cap."""
    cap = F.when(F.col("max_matches") == 0, 10**6).otherwise(F.col("max_matches"))
    return rules.orderBy(F.col("macro_f05").desc(), F.col("threshold").desc(), cap, F.col("score_column").desc()).limit(1)


def apply_rule(scores: DataFrame, column: str, threshold: float, max_matches: int = 0) -> DataFrame:
    """Pairs of with_ranks(scores) that the rule takes."""
    kept = scores.where(F.col(column) >= threshold)
    return kept.where(F.col(f"rank_{column}") <= max_matches) if max_matches else kept


def match_lists(queries: DataFrame, kept: DataFrame, column: str) -> DataFrame:
    """(source1_entity_id, matched_entity_ids) for every query, best first, joined by commas."""
    lists = kept.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"rank_{column}").alias("r"), "p"))), lambda x: x["p"]), ",").alias("ids"))
    return queries.select(F.col("entity_id").alias("source1_entity_id")).join(lists, F.col("source1_entity_id") == F.col("q"), "left").select("source1_entity_id", F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))
