"""The stages by the command line, over files."""

from skein.cli import main
from skein.sources import files

FIRST, SECOND, KIND = ("acme", "zenith", "orion", "delta"), ("foods", "motors", "textiles", "systems"), ("ltd", "inc", "corp")
NAMES = [f"{a} {b} {KIND[(i + j) % 3]}" for i, a in enumerate(FIRST) for j, b in enumerate(SECOND)]


def write_sources(spark, at, country="us"):
    for s in (1, 2, 3):
        rows = [(f"S{s}-{i:03d}", n if s == 1 else n.replace("o", "oo", 1) if s == 2 else n.upper(), f"{i} main st, springfield", country) for i, n in enumerate(NAMES) if s == 1 or i % 3]
        files.write_tsv(spark.createDataFrame(rows, files.RECORD), at(f"s{s}"))
    files.write_tsv(spark.createDataFrame([(f"S1-{i:03d}", f"S2-{i:03d},S3-{i:03d}" if i % 3 else "") for i in range(len(NAMES))], files.TRUTH), at("truth"))
    return ["--s1", at("s1"), "--s2", at("s2"), "--s3", at("s3")]


def test_retrieval(spark, tmp_path):
    at = lambda k: str(tmp_path / k)
    three = write_sources(spark, at)
    main(["fit-idf", "--inputs", at("s1"), at("s2"), at("s3"), "--output", at("idf")], spark)
    main(["block", *three, "--idf", at("idf"), "--output", at("candidates"), "--detail", at("detail"), "--k-sparse", "3", "--k-sparse-name", "0"], spark)
    got = dict(map(tuple, files.read_tsv(spark, at("candidates"), "source1_entity_id string, candidate_entity_ids string").collect()))
    assert len(got) == len(NAMES) and sum(f"S3-{i:03d}" in got[f"S1-{i:03d}"].split(",") for i in range(len(NAMES)) if i % 3) >= 9


def test_retrieval_without_countries(spark, tmp_path):
    at = lambda k: str(tmp_path / k)
    three = write_sources(spark, at, "")
    main(["fit-idf", "--inputs", at("s1"), at("s2"), at("s3"), "--output", at("idf")], spark)
    assert {r.ckey for r in files.read_idf(spark, at("idf"), "sparse_text").select("ckey").distinct().collect()} == {""}
    main(["block", *three, "--idf", at("idf"), "--output", at("candidates"), "--k-sparse", "3", "--k-sparse-name", "0"], spark)
    got = dict(map(tuple, files.read_tsv(spark, at("candidates"), "source1_entity_id string, candidate_entity_ids string").collect()))
    assert len(got) == len(NAMES) and sum(f"S3-{i:03d}" in got[f"S1-{i:03d}"].split(",") for i in range(len(NAMES)) if i % 3) >= 9


def test_train_and_predict(spark, tmp_path):
    """From files through candidates, features, the fit and its report to filtered lists of another run."""
    at = lambda k: str(tmp_path / k)
    three = write_sources(spark, at)
    main(["fit-idf", "--inputs", at("s1"), at("s2"), at("s3"), "--output", at("idf")], spark)
    main(["block", *three, "--idf", at("idf"), "--output", at("candidates"), "--detail", at("detail"), "--k-sparse", "3", "--k-sparse-name", "2", "--report", at("blocking"), "--truth", at("truth")], spark)
    assert "recall" in spark.read.text(at("blocking-text")).collect()[0].value or spark.read.text(at("blocking-text")).count() > 5
    main(["train", *three, "--idf", at("idf"), "--detail", at("detail"), "--truth", at("truth"), "--model", at("model"), "--output", at("train-filtered"), "--rounds", "3", "--depth", "2", "--folds", "2", "--ablation"], spark)
    report = files.read_json(spark, at("model/report"))
    assert report["average_precision"] > 0.5 and report["ablation_no_dense"]["average_precision"] > 0.5 and len(report["filter_sweep"]) > 1
    importance = spark.read.csv(at("model/importance"), sep="\t", header=True, inferSchema=True).toPandas()
    assert importance.gain_pct.sum() > 99.9 and importance.split.sum() > 0 and importance.gain_rank.tolist() == sorted(importance.gain_rank)
    main(["predict", *three, "--idf", at("idf"), "--detail", at("detail"), "--model", at("model"), "--output", at("filtered")], spark)
    lists = {r.source1_entity_id: r.candidate_entity_ids.split(",") for r in files.read_tsv(spark, at("filtered"), files.FILTERED).collect()}
    assert len(lists) == len(NAMES) and sum(f"S2-{i:03d}" in lists[f"S1-{i:03d}"] for i in range(len(NAMES)) if i % 3) >= 8


def test_projection_and_cost(spark, tmp_path):
    from skein.plans import reports

    at = lambda k: str(tmp_path / k)
    write_sources(spark, at)
    full = reports.projected_pairs(spark, {"train": at("s1"), "test": at("s2")}, {"train": 3.0, "val": 2.0})
    assert full["train"] == {"s1": 16, "pairs_per_s1": 3.0, "pairs": 48} and full["test"]["pairs"] == 2 * full["test"]["s1"]
    said = reports.cost({"train": {"pairs": 36_000}, "val": {"pairs": 7200}}, {"train": 10.0, "infer": 20.0}, 0.5, epochs=2, dev_share=0.0)
    assert said["hours"] == {"train": 2.0, "dev_evals": 0.0, "score": 0.1, "total": 2.1, "range": [1.4, 4.2]} and said["price"]["total"] == 1.05
    assert reports.accelerator_rate(1e9, 100, 70.0, 0.25) == {"train": 29.2, "infer": 87.5}
    assert reports.plot_pr([{"threshold": 0.5, "precision": 1.0, "recall": 0.5, "f05": 0.8}], at("pr.png"), 0.5) in (True, False)


def test_last_row_of_truth_counts(spark, tmp_path):
    files.write_tsv(spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2,S2-2,"), ("S1-2", "")], files.TRUTH).coalesce(1), str(tmp_path / "t"))
    assert {r.q: r.matched for r in files.read_truth(spark, str(tmp_path / "t")).collect()} == {"S1-1": ["S2-2"], "S1-2": []}


def test_scores_to_matches(spark, tmp_path):
    at = lambda k: str(tmp_path / k)
    three = write_sources(spark, at)
    lists = [(f"S1-{i:03d}", f"S2-{i:03d},S3-{i:03d},S2-{(i + 1) % 16:03d}" if i % 3 else f"S2-{i + 1:03d}", "0.9000,0.8000,0.2000" if i % 3 else "0.3000", "0.9000" if i % 3 else "0.3000", "0") for i in range(len(NAMES))]
    files.write_tsv(spark.createDataFrame(lists, files.FILTERED), at("filtered"))
    main(["score", "--filtered", at("filtered"), "--model", at("model"), "--output", at("scores"), "--truth", at("truth")], spark)
    main(["tune", "--scores", at("scores"), "--s1", at("s1"), "--truth", at("truth"), "--output", at("rule"), "--matches", at("matches")], spark)
    assert files.read_json(spark, at("rule"))["macro_f05"] > 0.6
    main(["apply", "--scores", at("scores"), "--s1", at("s1"), "--output", at("applied"), "--rule", at("rule")], spark)
    read = lambda k: sorted(map(tuple, files.read_tsv(spark, at(k), "source1_entity_id string, matched_entity_ids string").collect()))
    assert read("applied") == read("matches") and len(read("applied")) == len(NAMES)
    main(["subsample", *three, "--truth", at("truth"), "--output", at("small"), "--n", "8", "--n-unmatched", "2"], spark)
    assert 6 <= files.read_tsv(spark, at("small/source1")).count() <= 10
