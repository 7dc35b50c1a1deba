"""The encoder, the choice of an index, and the scorer that reads both texts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.operators import dense, pairmodel


def test_hashed_ngrams(spark):
    encode = dense.hashed_ngrams(64)
    texts = ["acme foods limited", "acme food limited", "zenith motors", "", None, "有限公司 株式会社"]
    got = next(encode([pd.DataFrame({"entity_id": [str(i) for i in range(6)], "fingerprint": "", "dense_text": texts})])).embedding
    x = np.stack(got)
    assert np.allclose(np.linalg.norm(x, axis=1), [1, 1, 1, 0, 0, 1], atol=1e-6)
    assert x[0] @ x[1] > 0.7 > x[0] @ x[2]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "entity_id string, dense_text string").fillna("")
    first = dense.encode(df, dense.hashed_ngrams(64))
    again = dense.encode(df.withColumn("dense_text", F.when(F.col("entity_id") == "2", "new text").otherwise(F.col("dense_text"))), dense.hashed_ngrams(64), first)
    assert first.count() == again.count() == 6
    changed = first.join(again, ["entity_id", "fingerprint"], "left_anti").collect()
    assert [r.entity_id for r in changed] == ["2"]


@pytest.mark.parametrize("exact_up_to", [0, 10_000])
def test_index_by_size_gives_the_same_rows(spark, sf, exact_up_to):
    from skein.plans import views

    r = views.dense_records(spark, sf)
    got = sorted(map(tuple, dense.top_k_by_size(r, 5, exact_up_to).collect()))
    want = sorted(map(tuple, dense.top_k(r, 5).collect()))
    assert len(got) == len(want) and np.mean([a == b for a, b in zip(got, want)]) >= 0.99


def planted(n: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("bcdfglmnprst") + list("aeiou"), 6))
    rows = []
    for i in range(n):
        own = [word() for _ in range(3)]
        other = own[:2] + [word()] if i % 3 == 0 else [word() for _ in range(3)]
        rows.append((f"q{i // 4:04d}", f"p{i:05d}", " ".join(own), " ".join(other), int(i % 3 == 0)))
    return rows


def test_pair_model_learns_to_match(spark):
    schema = "q string, p string, a_text string, b_text string, label int"
    model = pairmodel.fit(spark.createDataFrame(planted(900, 1), schema), epochs=5)
    new = spark.createDataFrame(planted(300, 2), schema)
    got = pairmodel.with_logit(new, model).join(new, ["q", "p"]).toPandas()
    assert pairmodel.average_precision(got.label.to_numpy(), got.raw_logit.to_numpy()) > 0.95
    odd = spark.createDataFrame([("q", "p", None, "", 0), ("q", "r", "x", None, 0)], schema)
    assert pairmodel.with_logit(odd, model).count() == 2 and pairmodel.with_logit(odd.limit(0), model).count() == 0
    assert np.allclose(pairmodel.fit(odd).logits(["a"], ["b"]), np.log(0.25 / 0.75))


def test_batches_hold_every_row_once():
    lengths = np.random.default_rng(0).integers(0, 50, 333)
    got = list(pairmodel.batches(lengths, 64, np.random.default_rng(1)))
    assert sorted(np.concatenate(got).tolist()) == list(range(333)) and all(np.ptp(lengths[g]) < 20 for g in got)
