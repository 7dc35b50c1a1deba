"""How good scores and decisions are, by pair and by query (F0.5 weighs precision higher).

pairs: q, p, score, label (0/1). truth: q, n_true, a row for each query that has ground truth, those without any match included.
Threshold tables are one pass: every pair is exploded to the thresholds it reaches, never joined with all of them row by row on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

THRESHOLDS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _reached(pairs: DataFrame, thresholds: Sequence[float], score: str = "score") -> DataFrame:
    """pairs, a row for each threshold that the score reaches."""
    return pairs.withColumn("threshold", F.explode(F.filter(_numbers(thresholds), lambda t: F.col(score) >= t)))


def _all(spark, thresholds: Sequence[float]) -> DataFrame:
    return spark.range(1).select(F.explode(_numbers(thresholds)).alias("threshold"))


def f05_of(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 of one query: 1 if nothing is predicted and nothing true, 0 if nothing is met."""
    p, r = tp / F.nullif(n_pred, F.lit(0)), tp / F.nullif(n_true, F.lit(0))
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def _pair_f05(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(0.0)


def pair_threshold_table(pairs: DataFrame, n_true: int | Column, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(threshold, n_pred, precision, recall, f05): recall counts true pairs that were never retrieved, too."""
    n_true = F.lit(n_true) if isinstance(n_true, int) else n_true
    got = _reached(pairs, thresholds).groupBy("threshold").agg(F.count("*").alias("n_pred"), F.sum("label").alias("tp"))
    got = F.broadcast(_all(pairs.sparkSession, thresholds)).join(got, "threshold", "left").fillna(0)
    p, r = F.col("tp") / F.greatest("n_pred", F.lit(1)), F.col("tp") / F.greatest(n_true, F.lit(1))
    return got.select("threshold", F.col("n_pred").cast("long").alias("n_pred"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(_pair_f05(p, r), 4).alias("f05"))


def pair_sweep(pairs: DataFrame, n_true: int, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """As pair_threshold_table, with recall and F0.5 among the pairs at hand as well as end to end."""
    have = pairs.agg(F.sum("label").alias("n_have"))
    got = _reached(pairs, thresholds).groupBy("threshold").agg(F.count("*").alias("n_pred"), F.sum("label").alias("tp"))
    got = F.broadcast(_all(pairs.sparkSession, thresholds)).join(got, "threshold", "left").fillna(0).crossJoin(F.broadcast(have))
    p = F.col("tp") / F.greatest("n_pred", F.lit(1))
    r, e = F.col("tp") / F.greatest("n_have", F.lit(1)), F.col("tp") / F.greatest(F.lit(n_true), F.lit(1))
    return got.select("threshold", F.col("n_pred").cast("long").alias("n_pred"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall_reached"), F.round(e, 4).alias("recall_end_to_end"), F.round(_pair_f05(p, r), 4).alias("f05_reached"), F.round(_pair_f05(p, e), 4).alias("f05_end_to_end"))


def _by_query(pairs: DataFrame, truth: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, q, n_true, n_pred, tp): every query with truth at every threshold."""
    got = _reached(pairs, thresholds).groupBy("q", "threshold").agg(F.count("*").alias("n_pred"), F.sum("label").alias("tp"))
    every = truth.withColumn("threshold", F.explode(_numbers(thresholds)))
    return every.join(got, ["q", "threshold"], "left").fillna(0, ["n_pred", "tp"])


def entity_threshold_table(pairs: DataFrame, truth: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(threshold, macro_f05) if reaching the threshold were the decision."""
    f = f05_of(F.col("tp"), F.col("n_pred"), F.col("n_true"))
    return _by_query(pairs, truth, thresholds).groupBy("threshold").agg(F.round(F.avg(f), 4).alias("macro_f05"))


def entity_sweep(pairs: DataFrame, truth: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """entity_threshold_table with what becomes of queries with an empty prediction and of those without a match."""
    f = f05_of(F.col("tp"), F.col("n_pred"), F.col("n_true"))
    empty, single = F.col("n_pred") == 0, F.col("n_true") == 0
    n = lambda c: F.sum(c.cast("long"))
    return _by_query(pairs, truth, thresholds).groupBy("threshold").agg(
        F.round(F.avg(f), 4).alias("macro_f05"), n(empty).alias("pred_empty"), n(single).alias("singletons"), n(empty & single).alias("empty_correct"), n(empty & ~single).alias("empty_wrong"),
        n(~empty & single).alias("singleton_false_merge"),
    )


def macro_f05(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(macro_f05) of predicted pairs (q, label), 5 places."""
    got = predicted.groupBy("q").agg(F.count("*").alias("n_pred"), F.sum("label").alias("tp"))
    return truth.join(got, "q", "left").fillna(0, ["n_pred", "tp"]).agg(F.round(F.avg(f05_of(F.col("tp"), F.col("n_pred"), F.col("n_true"))), 5).alias("macro_f05"))


def _by_score(pairs: DataFrame, score: str) -> DataFrame:
    """(s, n, tp, cum_n, cum_tp): totals for each distinct score and for all from there up. Distinct scores are aggregated before they are
    put in one order, so that the ordered window sees as many rows as there are distinct scores (at most 10^6 at 6 places)."""
    g = pairs.groupBy(F.round(score, 6).alias("s")).agg(F.count("*").alias("n"), F.sum("label").alias("tp"))
    w = W.orderBy(F.col("s").desc()).rowsBetween(W.unboundedPreceding, 0)
    return g.withColumns({"cum_n": F.sum("n").over(w), "cum_tp": F.sum("tp").over(w)})


def average_precision(pairs: DataFrame, score: str = "score") -> DataFrame:
    """(average_precision): precision at each distinct score, weighted by the recall gained there, 6 places; null without positives."""
    total = pairs.agg(F.sum("label").alias("pos"))
    d = _by_score(pairs, score).crossJoin(F.broadcast(total))
    return d.agg(F.round(F.sum(F.col("tp") / F.nullif("pos", F.lit(0)) * F.col("cum_tp") / F.col("cum_n")), 6).alias("average_precision"))


def best_pair_f05(pairs: DataFrame, score: str = "score") -> DataFrame:
    """(threshold, f05): the best F0.5 over all cuts between distinct scores, the higher cut of equals."""
    total = pairs.agg(F.sum("label").alias("pos"))
    d = _by_score(pairs, score).crossJoin(F.broadcast(total))
    p, r = F.col("cum_tp") / F.col("cum_n"), F.col("cum_tp") / F.greatest("pos", F.lit(1))
    d = d.select("s", F.round(_pair_f05(p, r), 6).alias("f05"))
    return d.agg(F.max(F.struct("f05", "s")).alias("x")).select(F.col("x.s").alias("threshold"), "x.f05")


def edges(bins: int) -> list[float]:
    """bins + 1 edges from 0 to 1, each k times the float 1 / bins, the last one 1."""
    return [k * (1.0 / bins) for k in range(bins)] + [1.0]


def bin_of(score: Column, bins: int) -> Column:
    """Bins are closed below; 1 belongs to the last one."""
    inner = edges(bins)[1:-1]
    return F.size(F.filter(_numbers(inner), lambda e: score >= e)) if inner else F.lit(0)


def reliability(pairs: DataFrame, bins: int = 10, score: str = "score") -> DataFrame:
    """(bin, n, mean_score, share_true)."""
    return pairs.groupBy(bin_of(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg("label"), 6).alias("share_true"))


def calibration(pairs: DataFrame, bins: int = 10, score: str = "score") -> DataFrame:
    """(ece, brier), 6 places."""
    b = pairs.groupBy(bin_of(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.sum("label").alias("y"), F.sum((F.col(score) - F.col("label")) ** 2).alias("e"))
    return b.agg(F.round(F.sum(F.abs(F.col("s") - F.col("y"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("e") / F.sum("n"), 6).alias("brier"))


def class_balance(pairs: DataFrame) -> DataFrame:
    """(pairs, pos, neg, pos_rate, neg_per_pos)."""
    n, pos = F.count("*"), F.sum("label")
    return pairs.agg(n.alias("pairs"), pos.alias("pos"), (n - pos).alias("neg"), F.round(pos / F.greatest(n, F.lit(1)), 4).alias("pos_rate"), F.round((n - pos) / F.greatest(pos, F.lit(1)), 2).alias("neg_per_pos"))


def mean_by_country(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("ckey").agg(F.round(F.avg("score"), 6).alias("mean_score"))


def importance_by_group(importance: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(group, share): percent of the gain of (feature, gain) by group of features."""
    named = importance.join(F.broadcast(importance.sparkSession.createDataFrame([(f, g) for g, fs in groups.items() for f in fs], "feature string, group string")), "feature")
    total = importance.agg(F.sum("gain").alias("all"))
    return named.groupBy("group").agg(F.sum("gain").alias("gain")).crossJoin(F.broadcast(total)).select("group", F.round(100 * F.col("gain") / F.nullif("all", F.lit(0.0)), 2).alias("share"))


def validation_report(pairs: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """One row: macro F0.5 at the threshold, of a perfect choice among the pairs, of predicting nothing, and the share of true pairs there."""
    got = pairs.groupBy("q").agg(F.sum((F.col("score") >= threshold).cast("long")).alias("n_pred"), F.sum(F.when(F.col("score") >= threshold, F.col("label")).otherwise(0)).alias("tp"), F.sum("label").alias("have"))
    d = truth.join(got, "q", "left").fillna(0, ["n_pred", "tp", "have"])
    t, zero = F.col("n_true"), F.lit(0)
    return d.agg(F.round(F.avg(f05_of(F.col("tp"), F.col("n_pred"), t)), 4).alias("macro_f05"), F.round(F.avg(f05_of(F.col("have"), F.col("have"), t)), 4).alias("oracle_macro_f05"), F.round(F.avg(f05_of(zero, zero, t)), 4).alias("all_empty_macro_f05"), F.round(F.sum("have") / F.greatest(F.sum(t), F.lit(1)), 4).alias("recall_ceiling"))


def length_percentiles(texts: DataFrame, text: str) -> DataFrame:
    """Percentiles of the number of white-space tokens, with maximum and mean."""
    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda t: t != ""))
    q = (0.5, 0.9, 0.95, 0.99, 0.995, 0.999)
    d = texts.select(n.alias("n")).agg(F.percentile("n", F.array(*map(F.lit, q))).alias("p"), F.max("n").alias("longest"), F.round(F.avg("n"), 4).alias("mean"))
    return d.select(*[F.round(F.col("p")[i], 6).alias(f"p{str(100 * x).rstrip('0').rstrip('.').replace('.', '_')}") for i, x in enumerate(q)], "longest", "mean")
