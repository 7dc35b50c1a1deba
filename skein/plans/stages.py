"""The four stages and their helpers as functions from files to files. Each reads and writes explicit paths and keeps no state."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, decision, dense, features, filtering, metrics, records, sampling, scorer, tfidf
from ..operators.tables import kept
from ..sources import files
from . import reports

FIELDS = {"sparse": "sparse_text", "sparse_name": "name_text"}


def _read(spark: SparkSession, *paths: str | None) -> DataFrame:
    files.require(spark, *paths)
    return reduce(DataFrame.unionByName, [files.read_tsv(spark, p) for p in paths if p])


def _truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(q, p) of all matches, and (q, n_true)."""
    t = files.read_truth(spark, path)
    return files.truth_pairs(t), files.truth_sizes(t)


def _labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.withColumn("label", F.lit(1)), ["q", "p"], "left").fillna(0, ["label"])


def fit_idf(spark: SparkSession, inputs: list[str], output: str, ngrams: tuple[int, int] = (2, 4), min_df: int = 2) -> None:
    """IDF by country of both text fields, from all rows of all inputs."""
    r = kept(records.normalized(_read(spark, *inputs)))
    parts = []
    for text in FIELDS.values():
        counts = tfidf.gram_counts(r, text, ["source", "ckey", "entity_id"], *ngrams)
        parts.append(tfidf.fit_idf(counts, r, ["ckey"], min_df).withColumn("field", F.lit(text)))
    files.write_idf(reduce(DataFrame.unionByName, parts), output)


def block(spark: SparkSession, s1: str, s2: str, s3: str, output: str, idf: str | None = None, detail: str | None = None, report: str | None = None, truth: str | None = None, embeddings: str | None = None, k_sparse: int = 20, k_sparse_name: int = 10, k_dense: int = 20, top_features: int = 48, max_df_frac: float = 0.02) -> dict:
    """Candidates of every S1 record. Without idf there are no sparse channels, without embeddings no dense one."""
    files.require(spark, s1, s2, s3, idf, truth, embeddings)
    if idf is None and embeddings is None:
        raise ValueError("neither idf nor embeddings: no retrieval channel is left")
    r = kept(records.normalized(_read(spark, s1, s2, s3)))
    q = r.where("source = 'S1'")
    channels = {}
    if idf:
        for channel, k in (("sparse", k_sparse), ("sparse_name", k_sparse_name)):
            if k > 0:
                own = files.read_idf(spark, idf, FIELDS[channel])
                if lacking := [x.part for x in tfidf.search_countries(q).join(own.select(F.col("ckey").alias("part")).distinct(), "part", "left_anti").collect()]:
                    raise ValueError(f"{idf} has no weights for countries {lacking}")
                channels[channel] = tfidf.top_k(r, own, FIELDS[channel], k, top_features, max_df_frac)
    if embeddings:
        e = spark.read.parquet(embeddings).select("entity_id", "embedding")
        placed = tfidf.spread(r.select("entity_id", "source", "ckey"), tfidf.search_countries(q)).drop("ckey").withColumnRenamed("part", "ckey")
        channels["dense"] = dense.top_k_by_size(placed.join(e, "entity_id"), k_dense)
    pairs = kept(blocking.combine(channels))
    files.write_tsv(blocking.candidate_lists(q, pairs), output)
    if detail:
        files.write_detail(pairs, detail)
    said = {"channels": sorted(channels), **blocking.reduction_ratio(r, pairs).first().asDict(), **blocking.candidate_quantiles(q, pairs).first().asDict()}
    if truth:
        true, _ = _truth(spark, truth)
        hits = kept(blocking.found_truth(true.join(q.select(F.col("entity_id").alias("q"), F.col("ckey").alias("country")), "q"), pairs))
        rows = lambda df: [x.asDict() for x in df.collect()]  # noqa: E731  a row for each source, country, channel or k
        said |= {"recall": rows(blocking.recall(hits)), "by_channel": rows(blocking.recall_by_channel(hits, list(channels))), "at_k": rows(blocking.recall_at_k(hits, list(channels)))} | blocking.entity_full_recall(hits).first().asDict()
    if report:
        files.write_json(spark, said, report)
        reports.write_text(spark, reports.text("Blocking", said), f"{report}-text")
    return said


def featurize(spark: SparkSession, s1: list[str], s2: str, s3: str, idf: str, details: list[str], embeddings: str | None = None) -> DataFrame:
    """(q, p, FEATURES...) of the pairs of all details; S1 files are featurised together, so that queries see each other's candidates."""
    raw = kept(records.first_by_id(_read(spark, *s1, s2, s3)))
    r = kept(records.normalized(raw))
    pairs = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [files.read_detail(spark, p) for p in details])
    pairs = kept(pairs)
    parts = kept(records.with_address_parts(raw).select("entity_id", "comps"))
    of = {}
    for text in FIELDS.values():  # a record is needed under the weights of its own country and under those of its partners' countries
        own = files.read_idf(spark, idf, text)
        used = tfidf.with_fallback(r.select("ckey"), own)
        w = own.withColumnRenamed("ckey", "fitted").join(F.broadcast(used), "fitted").select(F.col("ckey").alias("part"), "gram", "idf")
        of[text] = r.select("entity_id", F.col(text).alias("text")), kept(w)
    e = files.embeddings_if_complete(spark, embeddings, r)
    return features.build(pairs, r.select("entity_id", "ckey", "name", "addr").join(parts, "entity_id"), of["sparse_text"], of["name_text"], e)


def train(spark: SparkSession, feats: DataFrame, truth: str, model: str, filtered: str | None = None, queries: DataFrame | None = None, columns: list[str] | None = None, top_k: int = 10, floor: float = 0.01, no_match: float = 0.01, folds: int = 5, ablation: bool = False, **how) -> dict:
    """Fits the first scorer on feats, saves it with its settings, importance table and report, and writes the filtered lists of
    out-of-fold scores, if asked for. ablation: also says how well the features do that need no embeddings."""
    columns = columns or features.FEATURES
    true, sizes = _truth(spark, truth)
    # features are computed once, into a table, and every fit reads that
    _labelled(feats, true).write.mode("overwrite").parquet(f"{model}/features")
    d = spark.read.parquet(f"{model}/features")
    fitted = scorer.fit_trees(d, columns, **how)
    fitted.write().overwrite().save(f"{model}/trees")
    gains = dict(scorer.importance(fitted, columns))
    ranked = reports.importance_rows([(f, gains[f], n) for f, n in zip(columns, scorer.split_counts(fitted, columns))])
    files.write_json(spark, {"features": columns, "top_k": top_k, "floor": floor, "no_match": no_match, "importance": scorer.importance(fitted, columns)}, f"{model}/meta")
    files.write_tsv(spark.createDataFrame([tuple(r.values()) for r in ranked], "feature string, gain double, split long, gain_pct double, gain_rank long, `group` string, dense_derived boolean").coalesce(1), f"{model}/importance")
    scored = kept(scorer.out_of_fold(d, columns, folds, **how).select("q", "p", "score", "label"))
    if filtered and queries is not None:
        files.write_tsv(filtering.filtered_lists(queries, filtering.keep_top(scored, top_k, floor, no_match)), filtered)
    own = kept(sizes.join(d.select("q").distinct(), "q", "left_semi"))
    said = reports.training(scored, own, ranked, top_k, floor, no_match)
    if ablation:
        plain = [c for c in columns if c not in features.DENSE_DERIVED]
        said["ablation_no_dense"] = metrics.average_precision(scorer.out_of_fold(d, plain, folds, **how)).first().asDict()
    files.write_json(spark, said, f"{model}/report")
    reports.write_text(spark, reports.text("First scorer", said | {"importance": ranked[:20]}), f"{model}/report-text")
    return said


def predict(spark: SparkSession, feats: DataFrame, model: str, queries: DataFrame, output: str) -> None:
    """Filtered lists by a stored model and its settings."""
    meta = files.read_json(spark, f"{model}/meta")
    feats.write.mode("overwrite").parquet(f"{output}-features")
    scored = scorer.score(spark.read.parquet(f"{output}-features"), PipelineModel.load(f"{model}/trees"), meta["features"])
    files.write_tsv(filtering.filtered_lists(queries, filtering.keep_top(scored.select("q", "p", "score"), meta["top_k"], meta["floor"], meta["no_match"])), output)


CONTEXT = ["lgbm_score", "lgbm_rank", "lgbm_gap", "n_cands", "lgbm_logit", "is_s3"]


def second(spark: SparkSession, filtered: str, output: str, model: str, truth: str | None = None) -> None:
    """Scores of the second scorer for filtered lists; with truth, it is fitted and calibrated first, on separate queries."""
    d = kept(filtering.read_lists(files.read_tsv(spark, filtered, files.FILTERED)))
    if truth:
        y = sampling.grouped_split(_labelled(d, _truth(spark, truth)[0]), "q", 0.15)
        fitted = scorer.fit_second(y.where("not held_out"), CONTEXT)
        a, b = scorer.fit_platt(scorer.second_logit(y.where("held_out"), fitted, CONTEXT))
        fitted.write().overwrite().save(f"{model}/second")
        files.write_json(spark, {"a": a, "b": b}, f"{model}/platt")
    platt = files.read_json(spark, f"{model}/platt")
    z = scorer.second_logit(d, PipelineModel.load(f"{model}/second"), CONTEXT)
    n = decision.normalized_scores(z.withColumn("raw_score", decision.sigmoid(platt["a"] * F.col("raw_logit") + platt["b"])), "raw_score")
    files.write_scores(n.select("q", "p", "raw_score", "normalized_score", "raw_logit", "no_match_score", "lgbm_score", "lgbm_rank"), output)


def tune(spark: SparkSession, scores: str, s1: str, truth: str, output: str, matches: str | None = None, sweep: str | None = None) -> dict:
    """The best rule of the grid; with matches, what it takes."""
    q, (true, sizes) = _read(spark, s1), _truth(spark, truth)
    s = files.read_scores(spark, scores)
    decision.check(s, q)
    ranked = kept(_labelled(decision.with_ranks(s), true))
    rules = kept(decision.grid(ranked, sizes.join(q.select(F.col("entity_id").alias("q")), "q", "left_semi")))
    best = decision.best_rule(rules).first().asDict()
    files.write_json(spark, best, output)
    if sweep:
        files.write_tsv(rules.orderBy(F.col("macro_f05").desc(), F.col("threshold").desc()), sweep)
    if matches:
        files.write_tsv(decision.match_lists(q, decision.apply_rule(ranked, best["score_column"], best["threshold"], best["max_matches"]), best["score_column"]), matches)
    return best


def apply(spark: SparkSession, scores: str, s1: str, output: str, rule: str | None = None, threshold: float | None = None, score_column: str = "raw_score", max_matches: int = 0) -> None:
    """Matches by a stored rule, or by a threshold."""
    if rule:
        r = files.read_json(spark, rule)
        score_column, threshold, max_matches = r["score_column"], r["threshold"], r["max_matches"]
    elif threshold is None:
        raise ValueError("a rule or a threshold is needed")
    q, s = _read(spark, s1), files.read_scores(spark, scores)
    decision.check(s, q)
    files.write_tsv(decision.match_lists(q, decision.apply_rule(decision.with_ranks(s), score_column, threshold, max_matches), score_column), output)
