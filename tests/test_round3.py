"""Window comparisons of many pairs at once, and numbers as printf writes them."""

import random

from pyspark.sql import functions as F

from skein.functions import strings as S
from skein.operators.filtering import four_places


def test_partials_equal_one_by_one():
    rng, pairs = random.Random(1), [("", ""), ("", "a"), ("abc", "abc")]
    for _ in range(1500):
        some = rng.choice(["ab", "abc ", "abcdefé𝒳"])
        pairs.append(tuple("".join(rng.choices(some, k=rng.randint(0, n))) for n in (14, rng.choice([14, 40]))))
    for pair, got in zip(pairs, S.partials(pairs)):
        assert abs(got - S.partial_of(*pair)) < 1e-12, pair


def test_partials_of_long_texts_take_milliseconds():
    import time

    rng = random.Random(2)
    pairs = [tuple("".join(rng.choices("etaoin shrdlu", k=450)) for _ in "ab") for _ in range(40)]
    began = time.process_time()
    S.partials(pairs)
    assert time.process_time() - began < 40 * 0.1  # 0.2 s and more for each pair by windows


def test_four_places_as_printf(spark):
    rng = random.Random(4)
    some = [0.03125, 0.09375, 0.00045, 0.12345, 0.5, 1.0, 0.0, 0.99995, 0.333333, 2.5, -0.03125, 12345.67895] + [rng.randint(0, 10**6) / 10**6 for _ in range(2000)] + [(2 * i + 1) / 20_000 for i in range(10_000)]
    got = spark.createDataFrame([(x,) for x in some], "x double").select("x", four_places(F.col("x")).alias("s")).collect()
    assert [(r.x, r.s) for r in got if r.s != f"{r.x:.4f}"] == []
