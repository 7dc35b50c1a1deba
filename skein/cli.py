"""Command line: python -m skein.cli fit-idf | block | train | predict | score | tune | apply | subsample."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import sampling
from .plans import stages
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, needed: str, **more) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in needed.split():
            c.add_argument(f"--{x}", required=True)
        for x, default in more.items():
            kind = type(default) if default is not None else str
            c.add_argument(f"--{x.replace('_', '-')}", default=default, type=kind)
        return c

    c = add("fit-idf", "output", min_df=2)
    c.add_argument("--inputs", nargs="+", required=True)
    c.add_argument("--ngram-range", nargs=2, type=int, default=(2, 4))
    add("block", "s1 s2 s3 output", idf=None, detail=None, report=None, truth=None, embeddings=None, k_sparse=20, k_sparse_name=10, k_dense=20, top_features=48, max_df_frac=0.02)
    add("train", "s1 s2 s3 idf detail truth model output", embeddings=None, top_k=10, floor=0.01, no_match=0.01, rounds=40, depth=5, rate=0.1, folds=5, es_share=0.15).add_argument("--ablation", action="store_true")
    add("predict", "s1 s2 s3 idf detail model output", embeddings=None)
    add("score", "filtered model output", truth=None)
    add("tune", "scores s1 truth output", matches=None, sweep=None)
    add("apply", "scores s1 output", rule=None, threshold=None, score_column="raw_score", max_matches=0)
    add("subsample", "s1 s2 s3 truth output", n=3000, n_unmatched=3500, seed=42)
    return p


def subsample(spark: SparkSession, s1: str, s2: str, s3: str, truth: str, output: str, n: int, n_unmatched: int, seed: int) -> None:
    q, t = files.read_tsv(spark, s1), files.read_truth(spark, truth)
    chosen = sampling.stratified(q, files.truth_sizes(t), n, seed).drop("single").cache()
    wanted = t.join(chosen.select(F.col("entity_id").alias("q")), "q", "left_semi")
    files.write_tsv(chosen, f"{output}/source1")
    files.write_tsv(wanted.select(F.col("q").alias("source1_entity_id"), F.array_join("matched", ",").alias("matched_entity_ids")), f"{output}/truth")
    ids = lambda x: files.truth_pairs(x).select(F.col("p").alias("entity_id"))
    for name, path in (("source2", s2), ("source3", s3)):
        pool = files.read_tsv(spark, path).withColumn("source", F.split_part("entity_id", F.lit("-"), F.lit(1)))
        files.write_tsv(sampling.subsample_pool(pool, ids(wanted), ids(t), n_unmatched, seed).drop("source"), f"{output}/{name}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = vars(parser().parse_args(argv))
    spark = spark or SparkSession.builder.getOrCreate()
    command = a.pop("command")
    if command == "fit-idf":
        stages.fit_idf(spark, a["inputs"], a["output"], tuple(a["ngram_range"]), a["min_df"])
    elif command == "block":
        print(json.dumps(stages.block(spark, **a), default=str))
    elif command in ("train", "predict"):
        feats = stages.featurize(spark, [a["s1"]], a["s2"], a["s3"], a["idf"], [a["detail"]], a["embeddings"])
        q = files.read_tsv(spark, a["s1"])
        if command == "predict":
            stages.predict(spark, feats, a["model"], q, a["output"])
        else:
            how = {k: a[k] for k in ("top_k", "floor", "no_match", "rounds", "depth", "rate", "es_share", "ablation")}
            print(json.dumps(stages.train(spark, feats, a["truth"], a["model"], a["output"], q, folds=a["folds"], **how), default=str))
    elif command == "score":
        stages.second(spark, a["filtered"], a["output"], a["model"], a["truth"])
    elif command == "tune":
        print(json.dumps(stages.tune(spark, **a)))
    elif command == "apply":
        stages.apply(spark, **a | {"threshold": float(a["threshold"]) if a["threshold"] else None})
    else:
        subsample(spark, **a)


if __name__ == "__main__":
    main(sys.argv[1:])
