"""Operators against hand-made rows, slow versions and properties."""

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import strings as S
from skein.operators import blocking, decision, dense, features, filtering, metrics, sampling, tfidf
from skein.sources import files


def grams(spark, text):
    return spark.createDataFrame([(text,)], "x string").select(tfidf.char_ngrams(F.col("x")).alias("g")).first().g


@pytest.mark.parametrize("text,want", [("a", [" a", "a ", " a "]), ("ab", [" a", "ab", "b ", " ab", "ab ", " ab "]), ("", []), ("a b", [" a", "a ", " a ", " b", "b ", " b "])])
def test_char_ngrams(spark, text, want):
    assert grams(spark, text) == want


def test_three_letters_have_whole_four_gram(spark):
    assert grams(spark, "abc").count(" abc") == 1 and len(grams(spark, "abc")) == 4 + 3 + 2


def test_sparse_top_k_with_blank_country(spark):
    r = [("S1-1", "S1", "us", "acme corp"), ("S2-1", "S2", "us", "acme corp"), ("S2-2", "S2", "", "acme corps"), ("S3-1", "S3", "fr", "acme corp"), ("S2-3", "S2", "us", "zebra")]
    df = spark.createDataFrame(r, "entity_id string, source string, ckey string, sparse_text string")
    counts = tfidf.gram_counts(df, "sparse_text", ["source", "ckey", "entity_id"])
    out = tfidf.top_k(df, tfidf.fit_idf(counts, df, ["ckey"]), "sparse_text", 5).orderBy("rank").collect()
    assert [x.p for x in out] == ["S2-1", "S2-2"] and out[0].score == pytest.approx(1.0, abs=1e-6)


def test_combine_and_lists(spark):
    ch = "q string, p string, source string, score double, rank int"
    a = spark.createDataFrame([("S1-1", "S2-1", "S2", 0.5, 2), ("S1-1", "S2-1", "S2", 0.7, 1)], ch)
    b = spark.createDataFrame([("S1-1", "S3-1", "S3", 0.1, 1)], ch)
    got = {r.p: r for r in blocking.combine({"sparse": a, "dense": b}).collect()}
    assert got["S2-1"].sparse_score == 0.7 and got["S2-1"].sparse_rank == 1 and got["S2-1"].dense_rank == 0 and got["S3-1"].dense_score == 0.1
    q = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    assert {r[0]: r[1] for r in blocking.candidate_lists(q, a.unionByName(b).dropDuplicates(["q", "p"])).collect()} == {"S1-1": "S2-1,S3-1", "S1-2": ""}


def test_similarities():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abc "), rng.integers(0, 12))).strip() for _ in range(60)]
    for a, b in zip(words, words[1:]):
        n, m = len(a), len(b)
        table = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert S.common_subsequence(a, b) == table[n][m]
        size = SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size
        assert S.common_substring_of(a, b) == (size / min(n, m) if a and b else None)
        for f in (S.indel, S.jaro, S.token_sort_of, S.token_set_of, S.partial_of):
            assert f(a, b) == pytest.approx(f(b, a)) and 0 <= f(a, b) <= 1
        short, long = sorted((a, b), key=len)
        if short and len(short) < len(long):
            slow = max(S.indel(short, long[max(0, e - len(short)) : e]) for e in range(1, len(long) + len(short)))
            assert S.partial_of(a, b) == pytest.approx(slow)


def test_similarity_literals():
    assert S.jaro_winkler_of("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.token_set_of("a b", "b a c") == 1.0 and S.token_set_of("", "") == 0.0 and S.partial_of("abc", "xxabcxx") == 1.0



def plain_abbreviation(a, b):
    x, y = sorted((a.split(), b.split()), key=len)
    firsts = "".join(t[0] for t in y)
    hits = [t in y or len(t) > 1 and (any(len(u) > 1 and (u[: len(t)] == t or t[: len(u)] == u) for u in y) or t.isalpha() and t in firsts) for t in x]
    return sum(hits) / len(x) if x else None


def plain_initialism(a, b):
    small = {"and", "of", "the", "for", "a", "an", "de", "des", "du", "la", "le", "et"}
    for x, y in ((a.split(), b.split()), (b.split(), a.split())):
        for toks in (y, [t for t in y if t not in small]):
            if len(toks) > 1 and "".join(t[0] for t in toks) in [*x, "".join(x)]:
                return 1.0
    return 0.0


def plain_token_set(a, b):
    def ratio(x, y):
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            for j, e in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if c == e else max(table[i][j + 1], table[i + 1][j])
        return 2 * table[-1][-1] / (len(x) + len(y)) if x or y else 1.0

    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and not (left and right):
        return 1.0
    s, l, r = " ".join(both), " ".join(both + left), " ".join(both + right)
    return max([ratio(l, r)] + ([ratio(s, l), ratio(s, r)] if both else []))


def test_similarities_equal_plain_versions(spark):
    rng = random.Random(8)
    some = ["ibm", "international", "business", "machines", "intl", "tech", "technologies", "bank", "of", "america", "boa", "the", "a", "x1", "x", "é", "ibmc", "bm"]
    pairs = [(" ".join(rng.choices(some, k=rng.randint(0, 5))), " ".join(rng.choices(some, k=rng.randint(0, 5)))) for _ in range(400)]
    pairs += [("ibm", "international business machines"), ("bofa", "bank of america"), ("boa", "bank of america"), ("intl tech", "international technologies"), ("", "x"), ("", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select("i", S.abbreviation(a, b).alias("abbreviation"), S.initialism(a, b).alias("initialism"), S.token_set(a, b).alias("token_set")).orderBy("i").collect()
    for r, (x, y) in zip(got, pairs):
        want = plain_abbreviation(x, y)
        assert (r.abbreviation is None) == (want is None) and (want is None or abs(r.abbreviation - want) < 1e-12), (x, y)
        assert r.initialism == plain_initialism(x, y), (x, y)
        assert r.token_set == pytest.approx(plain_token_set(x, y)), (x, y)


def test_windows(spark):
    df = spark.createDataFrame([("q", "p1", "S2", 0.5), ("q", "p2", "S3", 0.5), ("q", "p3", "S2", None), ("r", "p1", "S2", 0.9)], "q string, p string, source string, full_tfidf_cos double")
    d = features.structure(df.withColumns({"bge_m3_cos": F.lit(None).cast("double"), "name_tset": F.col("full_tfidf_cos")}))
    got = {(r.q, r.p): r for r in d.collect()}
    assert got["q", "p1"].grp_rank_tfidf == got["q", "p2"].grp_rank_tfidf == 1 and got["q", "p3"].grp_rank_name is None and got["q", "p1"].top_p == "p1"
    assert got["r", "p1"].grp_margin_tfidf == 0.9 and got["q", "p1"].grp_margin_tfidf == 0 and got["q", "p1"].cand_rank_s1 == 2 and got["q", "p1"].cand_gap_s1 == pytest.approx(0.4)
    assert got["q", "p1"].grp_rank_bge is None


def test_f05(spark):
    rows = [(0, 0, 0, 1.0), (0, 1, 0, 0.0), (1, 2, 1, 0.625 / 1.125), (0, 0, 2, 0.0)]
    df = spark.createDataFrame(rows, "tp int, n_pred int, n_true int, want double").select(metrics.f05_of(F.col("tp"), F.col("n_pred"), F.col("n_true")).alias("f"), "want")
    assert all(r.f == pytest.approx(r.want) for r in df.collect())


def test_bins(spark):
    df = spark.createDataFrame([(0.0, 0), (0.3, 2), (0.30000000000000004, 3), (1.0, 9), (0.95, 9)], "s double, want int")
    assert all(r.b == r.want for r in df.select(metrics.bin_of(F.col("s"), 10).alias("b"), "want").collect())


def test_normalized_scores(spark):
    df = spark.createDataFrame([("a", "x", 0.8), ("b", "x", 0.5), ("b", "y", 0.5)], "q string, p string, prob double")
    got = {(r.q, r.p): r for r in decision.normalized_scores(df).collect()}
    assert got["a", "x"].normalized_score == pytest.approx(0.8) and got["a", "x"].no_match_score == pytest.approx(0.2) and got["b", "y"].normalized_score == pytest.approx(1 / 3)


def test_best_rule_breaks_ties(spark):
    df = spark.createDataFrame([("raw_score", 0, 0.5, 0.9), ("raw_score", 3, 0.5, 0.9), ("raw_score", 1, 0.4, 0.9), ("raw_score", 1, 0.9, 0.8)], "score_column string, max_matches int, threshold double, macro_f05 double")
    assert decision.best_rule(df).first().max_matches == 3


def test_decision_checks(spark):
    q = spark.createDataFrame([("S1-1",)], "entity_id string")
    with pytest.raises(ValueError):
        decision.check(spark.createDataFrame([("S1-1", "p", 0.1)], "q string, p string, raw_score double"), q)
    with pytest.raises(ValueError):
        decision.check(spark.createDataFrame([("S1-2", "p", 0.1, 0.1)], "q string, p string, raw_score double, normalized_score double"), q)


def test_filter_and_lists(spark):
    s = spark.createDataFrame([("S1-1", "S2-1", 0.9, 1), ("S1-1", "S3-2", 0.2, 0), ("S1-1", "S2-3", 0.01, 0), ("S1-2", "S2-1", 0.05, 0)], "q string, p string, score double, label int")
    k = filtering.keep_top(s, 2, 0.1, 0.1)
    lists = filtering.filtered_lists(spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string"), k)
    got = {r[0]: tuple(r)[1:] for r in lists.collect()}
    assert got == {"S1-1": ("S2-1,S3-2", "0.9000,0.2000", "0.9000", 0), "S1-2": ("", "", "0.0500", 1), "S1-3": ("", "", "0.0000", 1)}
    back = {r.p: r for r in filtering.read_lists(lists).collect()}
    assert back["S3-2"].lgbm_rank == 2 and back["S3-2"].lgbm_gap == pytest.approx(0.7) and back["S3-2"].is_s3 == 1 and back["S2-1"].lgbm_logit == pytest.approx(math.log(9))


def test_sampling(spark):
    s1 = spark.createDataFrame([(f"S1-{i}", "us" if i % 3 else "fr") for i in range(400)], "entity_id string, country string")
    truth = s1.select(F.col("entity_id").alias("q"), (F.length("entity_id") % 2).cast("long").alias("n_true"))
    got = sampling.stratified(s1, truth, 100)
    again = {r.entity_id for r in sampling.stratified(s1.repartition(7), truth, 100).collect()}
    assert {r.entity_id for r in got.collect()} == again and abs(len(again) - 100) <= 2
    held = sampling.grouped_split(s1, "entity_id", 0.2, most=10)
    assert held.where("held_out").count() == 10


def test_dense(spark):
    r = [("S1-1", "S1", "us", [1.0, 0.0]), ("S2-1", "S2", "us", [0.0, 1.0]), ("S2-2", "S2", "us", [1.0, 0.0]), ("S3-1", "S3", "fr", [1.0, 0.0])]
    df = spark.createDataFrame(r, "entity_id string, source string, ckey string, embedding array<float>")
    assert [(x.p, x.score, x["rank"]) for x in dense.top_k(df, 2).orderBy("rank").collect()] == [("S2-2", 1.0, 1), ("S2-1", 0.0, 2)]
    pairs = spark.createDataFrame([("S1-1", "S2-2"), ("S1-1", "S9-9")], "q string, p string")
    assert {x.p: x.c for x in dense.pair_cosine(pairs, "q", "p", df, "c").collect()} == {"S2-2": 1.0, "S9-9": None}


def test_encode_only_what_the_cache_lacks(spark):
    def encoder(frames):
        for f in frames:
            yield f[["entity_id", "fingerprint"]].assign(embedding=[[float(len(t))] for t in f["dense_text"]])

    texts = spark.createDataFrame([("a", "xy"), ("b", "xyz")], "entity_id string, dense_text string")
    first = dense.encode(texts, encoder)
    changed = spark.createDataFrame([("a", "xy"), ("b", "x")], "entity_id string, dense_text string")
    cache = first.withColumn("embedding", F.array(F.lit(9.0).cast("float")))
    assert {r.entity_id: list(r.embedding) for r in dense.encode(changed, encoder, cache).collect()} == {"a": [9.0], "b": [1.0]}


def test_files(spark, tmp_path):
    p = str(tmp_path / "x")
    df = spark.createDataFrame([("S1-1", 'a "q"', "", "us"), ("S1-2", "b", "c", "")], files.RECORD)
    files.write_tsv(df, p)
    files.require(spark, p, None)
    assert sorted(map(tuple, files.read_tsv(spark, p).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(FileNotFoundError):
        files.require(spark, p + "-none")
    t = files.truth_lists(spark.createDataFrame([("a", "x,y,,x"), ("b", "")], files.TRUTH))
    assert {r.q: r.matched for r in t.collect()} == {"a": ["x", "y"], "b": []} and {r.q: r.n_true for r in files.truth_sizes(t).collect()} == {"a": 2, "b": 0}
    files.write_json(spark, {"a": 1}, p + ".json")
    assert files.read_json(spark, p + ".json") == {"a": 1}
    assert files.embeddings_if_complete(spark, None, df) is None


def test_entry_points():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())


def neighbours_of(df):
    return {(r.q, r.source, r.p, r.score) for r in df.collect()}


def test_dense_topk_cells_is_whole(spark):
    from skein.plans import catalogue

    d = "/root/testdata/sf0.1"
    want, got = neighbours_of(catalogue.dense_topk(spark, d)), neighbours_of(catalogue.dense_topk_cells(spark, d))
    assert len({x[:3] for x in want} & {x[:3] for x in got}) >= 0.9 * len(want)


def test_cells_beyond_the_probes(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 8)) * rng.uniform(0.5, 2, (900, 1))
    x[::50] = x[0]
    rows = [(f"S{i % 3 + 1}-{i:06d}", f"S{i % 3 + 1}", "ab"[i % 7 == 0], [float(np.float32(v)) for v in x[i]]) for i in range(900)]
    df = spark.createDataFrame(rows, "entity_id string, source string, ckey string, embedding array<float>")
    want = neighbours_of(dense.top_k(df, 10))
    assert neighbours_of(dense.top_k_by_cells(df, 10, n=12, probes=2, block=20, query_block=64)) == want
    assert dense.top_k_by_cells(df.where("source = 'S1'"), 10).count() == 0


def test_ids_above_a_million(spark, tmp_path):
    from skein.plans import catalogue, views

    ids = [7, 123456, 999999, 1234566, 1234567, 1234568, 12345678]
    e = spark.createDataFrame([(i, [1.0, float(i % 5)], 0) for i in ids], "vec_id long, embedding array<float>, label int")
    e.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [r.entity_id for r in e.select(views.entity_id("vec_id").alias("entity_id")).collect()]
    assert got == [f"S{i % 3 + 1}-{i:06d}" for i in ids]
    pairs = {(r.q, r.p): r.cos for r in catalogue.dense_pair_cos(spark, str(tmp_path)).collect()}
    assert pairs["S1-1234566", "S2-1234567"] == 1 * 1 + 1 * 2 and pairs["S1-999999", "S2-1000000"] is None and len(pairs) == 4


def test_records_hold_the_whole_text(spark, tmp_path):
    from skein.plans import catalogue, views

    long = "acme corp " * 20 + "zebra"
    texts = [long, f"{long}\n12 oak street,\n{'north road ' * 20}, quagga", "", None]
    spark.createDataFrame([(i, t, "us") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.business_name, r.business_address) for r in views.whole_entities(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [(long, ""), tuple(texts[1].split("\n", 1)), ("", ""), (None, None)]
    n, light, parts = ({r.entity_id: r for r in catalogue.QUERIES[q](spark, str(tmp_path)).collect()} for q in ("normalized_records", "light_text", "address_parts"))
    assert n["S1-000000"].name.endswith("zebra") and n["S2-000001"].name.endswith("zebra") and n["S2-000001"].addr.endswith("quagga")
    assert "zebra" in light["S1-000000"].text and "quagga" in light["S2-000001"].text and parts["S2-000001"].comps[-1] == "quagga"


def test_similarities_of_all_retrieved_pairs(spark, sf):
    from skein.plans import catalogue

    want = {(r.q, r.p) for c in (catalogue.sparse_topk, catalogue.sparse_name_topk) for r in c(spark, sf).collect()}
    assert {p[:2] for _, p in want} == {"S2", "S3"}
    for name in ("indel_token_sort", "token_set", "partial_ratio", "abbrev_sim", "acronym"):
        got = [(r.q, r.p) for r in catalogue.QUERIES[name](spark, sf).select("q", "p").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_features_of_all_retrieved_pairs(spark, sf):
    from skein.plans import catalogue, views

    pairs = catalogue._retrieved(spark, sf)
    want = {(r.q, r.p) for r in pairs.select("q", "p").collect()}
    got = catalogue.pair_features(spark, sf).select("q", "p", "bge_m3_cos", "cand_is_s3", "sparse_name_rank").collect()
    assert len(got) == len(want) and {(r.q, r.p) for r in got} == want
    assert {r.cand_is_s3 for r in got} == {0.0, 1.0} and any(r.bge_m3_cos is not None for r in got) and any(r.sparse_name_rank for r in got)
    assert views.labelled(pairs).where("score <= 0.08").count() > 0


def test_learned_scores_take_the_operators_parameters(spark, sf, monkeypatch):
    from skein.plans import catalogue

    class Caught(Exception):
        pass

    def caught(*a, **how):
        raise Caught(how)

    monkeypatch.setattr(catalogue, "_featured", lambda spark, d: spark.range(1))
    for name, fit in (("gbt_score", "fit_trees"), ("feature_importance", "fit_trees"), ("oof_scores", "out_of_fold")):
        monkeypatch.setattr(catalogue.scorer, fit, caught)
        with pytest.raises(Caught) as e:
            catalogue.QUERIES[name](spark, sf)
        assert e.value.args[0] == {}
