"""Grams in blocks: the same rows as the long tables of all grams, whatever the size of blocks, and shuffles of the order of the texts."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import tfidf
from skein.plans.catalogue import QUERIES


def sentence(rng, words, n):
    return " ".join(rng.choices(words, k=n))


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    """900 turns in three countries, and the bytes of their texts."""
    rng, there = random.Random(5), str(tmp_path_factory.mktemp("talk"))
    words = ["".join(rng.choices("abcdefghijklmnoprstuvwé", k=rng.randint(2, 9))) for _ in range(300)]
    rows = [(i // 6 * 5 + i // 6 % 3, i % 6, "user", f"{sentence(rng, words, 8)}. {sentence(rng, words, 80)}") for i in range(900)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{there}/conversations.parquet")
    spark.createDataFrame([(k, f"r{k}") for k in range(5)], "r_regionkey long, r_name string").write.parquet(f"{there}/region.parquet")
    return there, sum(len(r[3].encode()) for r in rows)


def shuffled(spark, run):
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


@pytest.mark.parametrize("name", ["pair_tfidf_cos", "sim_to_top1", "sparse_name_topk", "candidate_union", "abbrev_sim"])
def test_shuffles_are_of_the_order_of_the_texts(spark, talk, name):
    there, size = talk
    written = shuffled(spark, lambda: QUERIES[name](spark, there).write.format("noop").mode("overwrite").save())
    print(f"[{name}: {written} bytes shuffled, {size} of texts]")
    assert written < 8 * size


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdé ", k=rng.randint(1, 6))).strip() or "x" for _ in range(60)]
    rows = [(f"S{i % 3 + 1}-{i}", f"S{i % 3 + 1}", ("us", "fr", "")[i % 7 % 3], sentence(rng, words, rng.randint(0, 9))) for i in range(150)]
    rows += [(*rows[7][:3], "again abc"), ("S2-null", "S2", "us", None), ("S1-t", "S1", "us", "a\tb c d\n\x0be")]
    return spark.createDataFrame(rows, "entity_id string, source string, ckey string, t string")


def long_way(records, k, top, fraction):
    """The same by joins of grams."""
    idf = tfidf.fit_idf(tfidf.gram_counts(records, "t", ["source", "ckey", "entity_id"]), records, ["ckey"])
    rows = tfidf.spread(records, tfidf.search_countries(records.where("source = 'S1'")))
    fitted = tfidf.with_fallback(rows.select(F.col("part").alias("ckey")), idf).withColumnRenamed("ckey", "part")
    own = idf.withColumnRenamed("ckey", "fitted").join(fitted, "fitted").select("part", "gram", "idf")
    row = ["part", "source", "entity_id"]
    v = tfidf.prune(tfidf.vectors(tfidf.gram_counts(rows, "t", row), own, ["part"], row), row, top)
    pool = tfidf.cap_postings(v.where("source <> 'S1'"), rows.where("source <> 'S1'").groupBy("part", "source").agg(F.count("*").alias("n")), ["part", "source"], fraction)
    q = v.where("source = 'S1'").select("part", F.col("entity_id").alias("q"), "gram", F.col("w").alias("wq"))
    hits = pool.join(q, ["part", "gram"]).groupBy("part", "source", "q", F.col("entity_id").alias("p")).agg(F.round(F.sum(F.col("w") * F.col("wq")), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("part", "source", "q").orderBy(F.col("score").desc(), "p"))
    return idf, hits.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "p", "source", "part", "score", "rank")


@pytest.mark.parametrize("rows,block,top,fraction", [(8192, 16_384, 12, 0.02), (7, 5, 12, 0.02), (7, 5, 0, 1.0)])
def test_top_k_equals_joins(spark, records, monkeypatch, rows, block, top, fraction):
    monkeypatch.setattr(tfidf, "ROWS", rows)
    monkeypatch.setattr(tfidf, "BLOCK", block)
    idf, want = long_way(records, 4, top, fraction)
    got = tfidf.top_k(records, idf, "t", 4, top, fraction)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100


def test_common_grams_do_not_count(spark):
    """A gram in more than 50 and 2 % of a pool's records finds nothing, also where the pool is in several blocks."""
    rows = [("S1-1", "S1", "us", "common rare")] + [(f"S2-{i}", "S2", "us", "common" if i else "common rare") for i in range(60)]
    df = spark.createDataFrame(rows, "entity_id string, source string, ckey string, t string")
    _, want = long_way(df, 5, 48, 0.02)
    got = tfidf.top_k(df, tfidf.idf_of_texts(df, "t", "ckey", ["source", "ckey", "entity_id"]), "t", 5)
    assert [r.p for r in got.collect()] == ["S2-0"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_idf_of_texts(spark, records):
    want = tfidf.fit_idf(tfidf.gram_counts(records, "t", ["source", "ckey", "entity_id"]), records, ["ckey"])
    got = tfidf.idf_of_texts(records, "t", "ckey", ["source", "ckey", "entity_id"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("size", [32_768, 20])
def test_text_cosine_equals_joins(spark, records, monkeypatch, size):
    monkeypatch.setattr(tfidf, "PAIRS", size)
    counts = tfidf.gram_counts(records, "t", ["source", "ckey", "entity_id"])
    idf = tfidf.fit_idf(counts, records, ["ckey"])
    v = tfidf.vectors(counts, idf, ["ckey"], ["source", "entity_id"]).select(F.col("ckey").alias("part"), "entity_id", "gram", "w")
    a = records.where("source = 'S1'").select(F.col("ckey").alias("part"), F.col("entity_id").alias("q")).distinct()
    b = records.where("source <> 'S1'").select(F.col("ckey").alias("part"), F.col("entity_id").alias("p")).distinct()
    pairs = a.join(b, "part").withColumn("other", F.lit(1))
    texts = records.select(F.col("ckey").alias("part"), "entity_id", "t")
    got = tfidf.text_cosine(pairs, "q", "p", texts, "t", idf.select(F.col("ckey").alias("part"), "gram", "idf"), "cos")
    want = tfidf.pair_cosine(pairs, "q", "p", v, "cos").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_learned_scores_read_the_features_that_they_need(spark, talk, monkeypatch):
    """The addresses' window comparison is no feature of the scorers, and was computed for each of their pairs."""
    from skein.functions import strings
    from skein.plans import catalogue

    def never(*_):
        raise AssertionError("not wanted")

    monkeypatch.setattr(strings, "partials", never)
    build, asked = catalogue.features.build, []
    monkeypatch.setattr(catalogue.features, "build", lambda *a: asked.append(a) or build(*a))
    d = catalogue._featured(spark, talk[0], catalogue._SOME)
    assert set(d.columns) == {"q", "p", "label", *catalogue._SOME} and d.where("full_tfidf_cos > 0").count() > 0
    plan = build(*asked[0])._jdf.queryExecution().analyzed().toString()
    assert "addr_partial" not in plan


def test_only_texts_that_share_a_key_travel(spark, records):
    row = ["source", "ckey", "entity_id"]
    records = tfidf.kept(records.unionByName(records.where("source = 'S3'").withColumns({"entity_id": F.lit(None).cast("string"), "ckey": F.lit("")})))
    want = records.groupBy(*row).agg(F.sort_array(F.split(F.concat_ws(" ", F.collect_list("t")), " ")).alias("w"))
    got = tfidf._whole(records, "t", row).select(*row, F.sort_array(F.split("t", " ")).alias("w"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() < records.count()
    single = tfidf.kept(records.dropDuplicates(row))
    assert "Exchange" not in tfidf._whole(single, "t", row)._jdf.queryExecution().executedPlan().toString()


def test_best_of_a_block_is_a_row_for_each_query(spark, records, monkeypatch):
    seen, nearest = [], tfidf._met
    monkeypatch.setattr(tfidf, "_met", lambda *a: seen.append(nearest(*a)) or seen[-1])
    idf = tfidf.idf_of_texts(records, "t", "ckey", ["source", "ckey", "entity_id"])
    got = tfidf.top_k(records, idf, "t", 4, 12, 1.0)
    hits = seen[-1]
    assert hits.count() == got.select("q", "source", "part").distinct().count() < got.count()
