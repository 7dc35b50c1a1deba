"""Learned scores: what they learn from."""

import pytest


def test_importance_is_of_all_features(spark, sf, monkeypatch):
    from skein.operators.features import FEATURE_GROUPS, FEATURES
    from skein.plans import catalogue

    seen = {}

    def fit(x, features, **how):
        seen.update(features=list(features))

    monkeypatch.setattr(catalogue, "_features", lambda spark, d, only=None: seen.update(only=only))
    monkeypatch.setattr(catalogue.scorer, "fit_trees", fit)
    monkeypatch.setattr(catalogue.scorer, "importance", lambda model, features: [(f, 1.0) for f in features])
    got = {r.group for r in catalogue.feature_importance(spark, sf).collect()}
    assert seen == {"only": None, "features": FEATURES} and got == set(FEATURE_GROUPS)


def test_learned_pairs_have_the_scores_of_their_channels(spark, sf):
    from skein.plans import catalogue

    pairs = catalogue._retrieved(spark, sf, channels=True)
    for channel, score in (("sparse_topk", "sparse_score"), ("sparse_name_topk", "sparse_name_score")):
        want = {(r.q, r.p): r.score for r in catalogue.QUERIES[channel](spark, sf).collect()}
        assert {(r.q, r.p): r[score] for r in pairs.where(f"{score} is not null").collect()} == want


def _pairs(n, seed=1):
    import random

    rng, pairs = random.Random(seed), [("", ""), ("", "a"), ("a", ""), ("abc", "abc"), ("x" * 64, "x" * 64), ("x" * 63, "x" * 128), ("ab" * 100, "ab" * 100), ("a b", "b a c")]
    for _ in range(n):
        some = rng.choice(["ab", "abc ", "abcdefé𝒳", "a b"])
        pairs.append(tuple("".join(rng.choices(some, k=rng.randint(0, k))) for k in (rng.choice([14, 70, 140]), rng.choice([14, 40, 64, 130]))))
        t = "".join(rng.choices("abcd ", k=rng.randint(1, 200)))
        i = rng.randint(0, len(t))
        pairs.append((t, t[:i] + rng.choice(["", "x", "ab"]) + t[i + 1 :]))
    return pairs


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_many_pairs_as_one_by_one():
    from skein.functions import strings as S

    pairs = _pairs(400)
    of = ((S.subsequences, S.common_subsequence), (S.distances, _distance), (S.substrings, S.common_substring_of), (S.token_sorts, S.token_sort_of), (S.token_sets, S.token_set_of), (S.partials, S.partial_of))
    for many, one in of:
        for pair, got in zip(pairs, many(pairs)):
            want = one(*pair)
            assert got is want is None or abs(got - want) < 1e-12, (many.__name__, pair)


def test_abbreviations_as_spark_has_them(spark):
    from pyspark.sql import functions as F

    from skein.functions import strings as S

    pairs = [*_pairs(300), ("intl bus mach", "international business machines"), ("ibm", "intl business machines"), ("a  b\tcd", "cde ab"), ("1a 2b", "1ab 12")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], "i int, a string, b string")
    want = [r.x for r in df.select("i", S.abbreviation(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()]
    assert S.abbreviations(pairs) == pytest.approx(want)


def test_comparisons_in_batches_of_any_size(spark):
    from pyspark.sql import functions as F

    from skein.functions import strings as S
    from skein.operators import features as X

    pairs = [*_pairs(40), (None, "a"), (None, None), ("a", None)]
    df = spark.createDataFrame([(str(i), str(i), *x) for i, x in enumerate(pairs)], "q string, p string, a_name string, b_name string").coalesce(1)
    idf = spark.createDataFrame([(t, 1.0 + len(t) / 7, 9.0) for t in {t for x in pairs for s in x for t in (s or "").split(" ") if t}], "token string, idf double, default_idf double")
    want = X.weighted_jaccard(df, "a_name", "b_name", idf, "w").withColumn("d", F.levenshtein("a_name", "b_name").cast("double")).select("q", "d", "w")
    both = df.select("q", "a_name", "b_name")
    for s in "ab":
        one = df.select(F.col("q").alias("entity_id"), F.col(f"{s}_name").alias("name"))
        both = both.join(X.word_weights(one, "name", idf, f"{s}_name_w").withColumnRenamed("entity_id", "q"), "q", "left")
    for rows in (1, 7, 10_000):
        got = S.compared(both.coalesce(1), [("levenshtein", "name")], ["name"], rows).select("q", "_levenshtein_name", "_weighted_name")
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_comparing_many_long_pairs_takes_less_than_one_by_one():
    import random
    import time

    from skein.functions import strings as S

    rng = random.Random(2)
    pairs = [tuple("".join(rng.choices("etaoin shrdlu", k=450)) for _ in "ab") for _ in range(300)]
    spent = {}
    for f, some in ((S.partials, pairs), (S.substrings, pairs), (S.common_substring_of, pairs)):
        began = time.process_time()
        f(some) if f is not S.common_substring_of else [f(*x) for x in some]
        spent[f.__name__] = time.process_time() - began
    assert spent["substrings"] < spent["common_substring_of"] / 2 and spent["partials"] < 300 * 0.004
