"""Operators of skein.llm against brute force, round trips and held-out labels, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import components, line_dedup, mixing, neighbours, packing, pii, quality, queries, rules, simhash, token_store, toxicity
from skein.llm.common import running_sums, scratch
from skein.llm.tokens import WordCache

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, digest int, size string, fp string, score string, n_lines int, y int, `row` int"
LONG = " ".join(f"w{i % 977}x" for i in range(30_000))
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 4), (4, LONG, "en", "b", len(LONG)), (5, "one two three four five\nshared line\n", None, "b", 37),
    (5, "one two three four five\nshared line\n", None, "b", 37), (None, "no id here at all\nSHARED line ", "de", "c", 10), (7, "one two three four five\nshared line\n", "de", "c", 37), (8, "Ünïcode ünd Straße\n\n日本語 \u00a0x", "fr", "a", 3), (9, "one", "fr", "a", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "k", 1, "s", "f", "z", 7, 1, 2) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return docs.toPandas().sort_values("doc_id").reset_index(drop=True)


def rows(df):
    return df.toPandas().reset_index(drop=True)


# ---- tokens


@pytest.mark.parametrize("path,kind", [(BYTE, "byte"), (WORD, "word")])
def test_word_cache_equals_library(path, kind, plain):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    added = [x.content for x in t.get_added_tokens_decoder().values()]
    assert added
    texts = [*added, *(f"a {x} b{x}c \n{x}" for x in added), *(x.upper() for x in added), "<| x |>", "\x02 x\x02", *plain.text[:60], "", " ", "\n", "a  b\n\nc \n d\t\te  ", "  x 's  'sx ''s!'s", "日本語 \u00a0x É́ ", "a\x1cb", "ΑΣ. x  y", "I'll we'Ve  12 3", "\nfoo bar", "İx. ª. µm", "b:\nc,...", "<|endoftext|> x", "\nA\nb.", "!!\n?", " .", "x\u2028y z"]
    cache = WordCache(path, kind, limit=300)
    for _ in range(2):  # from the library, then from the cache
        assert [np.frombuffer(x, "<u4").tolist() for x in cache.ids(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_cache_finds_words_by_hash(monkeypatch):
    """Also where words share a hash, and after half of them were forgotten; what is known is not merged again, with 100,000 words either."""
    from skein.llm import token_store, tokens

    assert token_store.WORDS >= 1_500_000
    texts = [" ".join(f"{a}{b}{c}" for b in "bcdfgh" for c in "klmnp") + f" {a}." for a in "xyzuvw"]
    want = [Tokenizer.from_file(BYTE).encode(t, add_special_tokens=False).ids for t in texts]
    exact = tokens._hashes
    for of in (exact, lambda words: exact(words) % 7):
        monkeypatch.setattr(tokens, "_hashes", of)
        for limit in (40, 10_000):
            cache = WordCache(BYTE, "byte", limit=limit)
            assert [np.frombuffer(cache.ids([t])[0], "<u4").tolist() for t in texts * 2] == want * 2
            assert (np.diff(cache._hashes) >= 0).all() and sorted(cache._place) == list(range(len(cache._words)))
    monkeypatch.setattr(tokens, "_hashes", exact)
    cache = WordCache(BYTE, "byte")
    many = [" ".join("".join("abcdefghij"[int(d)] for d in f"{i:05}") for i in range(100_000))]
    first = cache.ids(many)
    monkeypatch.setattr(cache, "_merged", None)
    assert cache.ids(many) == first


# ---- running sums


def test_running_sums(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, "g" if i % 3 else "h", i % 5) for i in range(1000)], "k int, g string, v int")
    out = rows(running_sums(df, [F.col("k")], "v", "before")).sort_values("k")
    assert (out.before == out.v.cumsum() - out.v).all()
    out = rows(running_sums(df, [F.col("g"), F.col("k")], "v", "before", "g")).sort_values(["g", "k"])
    assert (out.before == out.groupby("g").v.cumsum() - out.v).all()


# ---- 1 and 9


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    found = rows(queries.op1_toxicity(spark, d))
    m = found.merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    m = m[m.held_out]
    assert len(found) == 1000 and found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.5)).all()
    assert (m.predicted == m.toxic).mean() > 0.9 and m[m.toxic == 0].predicted.mean() < 0.05


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 9), (8, 0, 9), (None, 1, 9), (4, None, 9)], "doc_id long, toxic int, text int")
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(none, model).count() == 0
    empty = toxicity.fit(none, labels.limit(0))
    assert empty.scores([None, ""]).max() < 0.5 < empty.scores(["you are an idiot", "word " * 500 + "moron"]).min()


def test_label_model_trusts_agreement():
    v = np.array([[1, 1, 0, 0]] * 20 + [[0, 1, 0, 0]] * 5 + [[0, 0, 0, -1]] * 200)
    p = toxicity.LabelModel(v, 0.1).posterior(v)
    assert p[0] > 0.9 and p[-1] < 0.05 and p[0] >= p[22]


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    found = rows(queries.op9_quality(spark, d))
    m = found.merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    m = m[m.held_out]
    assert len(found) == 1000 and (found.predicted == (found.score >= 0.7)).all()
    assert (m.predicted == m.quality).mean() > 0.93 and m[m.quality == 1].predicted.mean() > 0.97


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (8, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    found = rows(quality.score(odd, model))
    assert len(found) == len(ODD) and found.score.between(0, 1).all()
    assert quality.keep_good(odd, model, 0.0).columns == odd.columns and quality.keep_good(odd, model, 0.0).count() == len(ODD)
    assert quality.score(none, quality.fit(none, labels.limit(0))).count() == 0


def test_features_are_words_pairs_and_runs():
    assert len(quality.features("ab")) == 1 + 2 + 1  # the word; " ab", "ab "; " ab "
    assert len(quality.features("ab cd")) == 2 + 1 + 4 + 2
    assert len(quality.features(" \n")) == 0
    same, again = quality.features("xy xy"), quality.features("qq qq")
    assert len(set(same) & set(again)) >= 1  # the pair of a word with itself


# ---- 2


def plain_fingerprint(t):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    hs = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(fps, ids):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            r = find(i)
            least[r] = min(x, least.get(r, x))
    return [least.get(find(i)) for i in range(len(f))]


def test_near_copies_equal_brute_force(docs, plain):
    found = rows(simhash.near_copies(docs)).sort_values("doc_id")
    fps = [plain_fingerprint(t) for t in plain.text]
    assert (found.fp.to_numpy().view(np.uint64) == np.array(fps, np.uint64)).all()
    assert found.component_id.tolist() == plain_components(fps, plain.doc_id.tolist())


def test_links_of_crowded_entries(spark):
    """Entries over the limit are compared in parts, and nothing is lost."""
    rng = np.random.default_rng(1)
    fps = {0} | {int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for _ in range(300)} | {int(x) for x in rng.integers(0, 1 << 62, 50)}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in sorted(fps)], "fp long")
    for most in (8, 8192):
        got = {int(np.int64(r.node).view(np.uint64)): r.root for r in components.components(simhash.links(df, most=most)).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(got.get(f, f"alone {f}"), []).append(f)
        least = {f: min(g) for g in groups.values() for f in g}
        assert [least[f] for f in sorted(fps)] == plain_components(sorted(fps), sorted(fps))


def test_near_copies_odd_rows(odd, none):
    found = rows(simhash.near_copies(odd))
    assert len(found) == len(ODD) and found[found.doc_id.isin([1, 2, 3])].component_id.tolist() == [1, 1, 1]
    assert simhash.near_copies(none).count() == 0
    kept = rows(simhash.one_of_each(odd))
    assert 7 not in set(kept.doc_id) and list(kept.columns) == odd.columns and kept.doc_id.isna().sum() == 1


# ---- 3


def test_store_round_trip(spark, docs, plain):
    from tokenizers import Tokenizer

    path = scratch(spark, "test")
    token_store.write(docs, path, BYTE)
    assert token_store.verify(spark, path)["documents"] == len(plain)
    want = [e.ids + [2] for e in Tokenizer.from_file(BYTE).encode_batch(plain.text.tolist(), add_special_tokens=False)]
    back = rows(token_store.read_documents(spark, path)).sort_values("start")
    assert back.doc_id.tolist() == plain.doc_id.tolist() and [list(x) for x in back.ids] == want
    short = rows(token_store.digests_of_documents(spark, path)).sort_values("start")
    assert short.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want] and short.n_tokens.tolist() == list(map(len, want))
    assert short.start.tolist() == [0, *np.cumsum(list(map(len, want)))[:-1]]
    chunks = rows(token_store.read_chunks(spark, path))
    assert chunks.digest.map(bytes).is_unique and chunks.n.sum() < short.n_tokens.sum()  # copies share chunks


def test_store_odd_rows(spark, odd, none):
    for df, n in ((odd, len(ODD)), (none, 0)):
        path = scratch(spark, "test")
        token_store.write(df, path, BYTE)
        token_store.verify(spark, path)
        found = rows(token_store.digests_of_documents(spark, path))
        assert len(found) == n and (n == 0 or found[found.doc_id == 1].n_tokens.tolist() == [1])


def test_cuts_do_not_depend_on_what_stands_before():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50_000, 700).astype("<u4"), rng.integers(0, 50_000, 5000).astype("<u4")
    alone, behind = set(token_store.cuts(b)), {c - len(a) for c in token_store.cuts(np.concatenate([a, b]))}
    assert len(alone & behind) >= 0.7 * len(alone)
    assert all(y - x <= token_store.MOST for x, y in zip([0, *token_store.cuts(b)], token_store.cuts(b)))


# ---- 4


def test_mix_odd_rows(odd, none):
    found = rows(mixing.mix(odd))
    assert len(found) == len(ODD) and (found.taken <= 3 * found["size"]).all() and mixing.mix(none).count() == 0
    per = found.fillna({"source": "~"}).groupby("source").agg(t=("taken", "sum"), target=("target", "first"), s=("source_size", "first"))
    assert (per.t == np.floor(per.target)).all() and (per.target <= 3 * per.s).all()


def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["c"] == 300 and got[None] == 15 and got["a"] == 30 and got["b"] == 1115 - 345


def test_mixed_takes_what_the_mix_says(docs):
    out, mix = rows(mixing.mixed(docs)), rows(mixing.mix(docs))
    words = out.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    want = mix.set_index("doc_id").taken
    assert out.assign(w=words).groupby("doc_id").w.sum().to_dict() == want[want > 0].to_dict()
    assert list(out.columns) == docs.columns and (out.n_chars == out.text.str.len()).all()


# ---- 5


def plain_spans(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = ["a@b.c@d.ef x@@y.z .@a.b", "1.2.3.4.5.6.7.8 256.1.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (2) 3-4 5 +49 30 1234567 +1", "x+1-2@q-.-.w 1..2.3.4 +123456789) ", "é1@b.de 007.1.1.01", "+1+2 3333333333", "a@b a@b.c@", "1.2.3.4a@b.c.d"]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(3)
    for _ in range(300):
        t = "".join(rng.choice(list("01249.@+- ()ab\n"), 60))
        assert pii.base_spans(t) == plain_spans(t)


def test_pii_query(spark, sf, plain):
    found = rows(queries.op5_pii(spark, sf)).sort_values("doc_id")
    want = [plain_spans(t) for t in plain.text]
    said = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert found.base_sha256.tolist() == [hashlib.sha256(said(w).encode()).hexdigest() for w in want]
    for kind in pii.KINDS:
        assert found[f"n_{kind}"].tolist() == [sum(k == kind for k, *_ in w) for w in want]
    assert all(set(said(w).split(",")) <= set(s.split(",")) | {""} for w, s in zip(want, found.spans))


def test_pii_method_adds_spans(spark, odd, none):
    texts = ["mail: joe (at) gmail (dot) com, tel (030) 555-1234. a@b.com 10.1.1.1"] * 40
    model = pii.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    t = "contact jane (at) gmail (dot) com phone (212) 555-7788"
    assert [model.keeps(s[0], pii.votes(t, *s, False)) for s in pii.more_candidates(t, [])] == [True, True]
    assert pii.find(odd, pii.fit(odd)).count() == len(ODD) and pii.find(none, pii.fit(none)).count() == 0


def test_pii_added_spans_on_planted_disguises(spark, capsys):
    rng = np.random.default_rng(4)
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    area = lambda: str(rng.integers(201, 990))
    name = lambda: pick("anna", "jo", "karl", "lee", "max") + digits(2)
    disguised = [
        lambda: ("email", f"{name()} {pick('(at)', '[at]')} {pick('gmail', 'web', 'acme')} {pick('(dot)', '[dot]')} {pick('com', 'org', 'de')}"),
        lambda: ("email", f"{name()}(at){pick('gmail', 'proton')}.com"),
        lambda: ("ip", "[.]".join(str(rng.integers(1, 255)) for _ in range(4))),
        lambda: ("phone", f"({area()}) {area()}-{digits(4)}"),
    ]
    decoys = [lambda: f"invoice {digits(5)} of section {rng.integers(1, 9)}.{rng.integers(1, 9)}", lambda: f"build 1.{digits(1)}.3", lambda: f"order {digits(3)} {digits(3)} {digits(5)}", lambda: f"ip [.] version {rng.integers(300, 999)}[.]{rng.integers(300, 999)}[.]1[.]2", lambda: "met (at) noon"]
    cue = {"email": ("mail", "contact", "write to"), "ip": ("server", "host", "ping"), "phone": ("tel", "call", "phone")}
    texts, want = [], []
    for i in range(1200):
        text, spans = "some plain words here ", []
        if i % 3 == 0:
            kind, shown = pick(*disguised)()
            text += f"{pick(*cue[kind])} "
            spans.append((kind, len(text), len(text) + len(shown)))
            text += shown
        elif i % 3 == 1:
            text += pick(*decoys)()
        else:
            text += f"mail {name()}@{pick('gmail', 'acme')}.com or call +1 {area()} {area()} {digits(4)}"
        texts.append(text + " and more words")
        want.append(spans)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if not s.base] for r in pii.find(df, pii.fit(df)).collect()}
    hits = sum(len(set(found[i]) & set(w)) for i, w in enumerate(want))
    recall, precision = hits / sum(map(len, want)), hits / max(1, sum(map(len, found.values())))
    with capsys.disabled():
        print(f" [added spans: recall {recall:.3f}, precision {precision:.3f}]", end="")
    assert recall >= 0.9 and precision >= 0.9


# ---- 6


def plain_lines(texts, least):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")] for t in texts]
    seen = Counter(k for ks in keys for k in set(ks) if k)
    return ["\n".join(x for x, k in zip((t or "").split("\n"), ks) if not k or seen[k] < least) for t, ks in zip(texts, keys)]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_lines_equal_brute_force(docs, plain, limit):
    found = rows(line_dedup.drop_shared_lines(docs, least_docs=3, broadcast_bytes=limit)).sort_values("doc_id")
    assert found.text.tolist() == plain_lines(plain.text, 3) and found.n_dropped.sum() > 0


def test_only_suspects_travel(spark, docs, plain):
    """Without any broadcast, what is sent to the exact count are lines that many documents share, and no others."""
    wanted, blocks = line_dedup.wanted_hashes(docs, 3)
    keys = Counter(k for t in plain.text for k in set(line_dedup.keys_of(t)) if k)
    want = {k for k, n in keys.items() if n >= 3}
    codes = set(line_dedup._codes(wanted.collect()).tolist())
    of = dict(zip(keys, line_dedup._code(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), blocks).tolist()))
    assert {k for k in keys if of[k] in codes} == want and 0 < len(want) < len(keys) / 5


def test_lines_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PER_BLOCK", 50)
    texts = ["\n".join(f"line {j * (i % 7 + 1) % 400}" for j in range(20)) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (64 << 20, 1000, 0):
        found = rows(line_dedup.drop_shared_lines(df, least_docs=10, broadcast_bytes=limit)).sort_values("doc_id")
        assert found.text.tolist() == plain_lines(texts, 10)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_lines_odd_rows(odd, none, limit):
    found = rows(line_dedup.drop_shared_lines(odd, least_docs=4, broadcast_bytes=limit))
    assert len(found) == len(ODD) and found.n_dropped.sum() == 4 and found[found.doc_id == 1].text.isna().all()
    first = rows(line_dedup.drop_shared_lines(odd, least_docs=4, keep_first=True, broadcast_bytes=limit))
    assert first.n_dropped.sum() == 2  # both rows with id 5 hold the first occurrence
    assert line_dedup.drop_shared_lines(none).count() == 0


# ---- 7


def test_neighbours(spark, sf):
    found = rows(queries.op7_neighbours(spark, sf))
    e = pd.read_parquet(f"{sf}/embeddings.parquet").sort_values("vec_id")
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    met = []
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        mine = found[found.query_id == q].sort_values("rank")
        assert np.allclose(mine.score, s[mine.vec_id]) and mine["rank"].tolist() == list(range(1, 21))
        met.append(len(set(mine.vec_id) & set(ids[np.argsort(-s, kind="stable")[:20]])) / 20)
    assert np.mean(met) >= 0.9


def test_neighbours_odd_vectors(spark):
    v = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (10, []), (11, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in v], "vec_id long, embedding array<double>, score string")
    found = rows(neighbours.nearest(df, df, k=2)).sort_values(["query_id", "rank"])
    assert {q: g.vec_id.tolist() for q, g in found.groupby("query_id")} == {1: [2, 8], 2: [1, 8], 3: [1, 2], 8: [1, 2]}
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("norms", ["one", "outlier", "uniform", "gaussian", "log-normal"])
def test_neighbours_of_unequal_norms(spark, norms, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((20_000, 64))
    if norms != "gaussian":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "outlier":
        x[777] *= 3
    elif norms == "uniform":
        x *= rng.uniform(0.5, 1.5, (len(x), 1))
    elif norms == "log-normal":
        x *= np.exp(0.3 * rng.standard_normal((len(x), 1)))
    pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}).to_parquet(tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    found = rows(neighbours.nearest(df, df.where("vec_id % 200 = 0")))
    met = []
    for q, g in found.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        met.append(len(set(g.vec_id) & set(np.argsort(-s)[:20].tolist())) / 20)
    assert len(met) == 100 and np.mean(met) >= 0.9


@pytest.mark.parametrize("kind", ["unit", "gaussian", "clustered", "log-normal"])
def test_neighbours_verify_a_share(kind, capsys):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((16_384, 64))
    if kind == "clustered":
        x = rng.standard_normal((200, 64))[rng.integers(0, 200, len(x))] + 0.3 * x
    elif kind != "gaussian":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x *= np.exp(0.3 * rng.standard_normal((len(x), 1))) if kind == "log-normal" else 1
    ids, asked = np.arange(len(x)), np.arange(0, len(x), 200)
    best, verified = neighbours.search(x, ids, x[asked], asked, 20, 128, 104, 1.0, 0.8, 64, 1.1, 7)
    met = [len(set(rows) & set([i for i in np.argsort(-(x @ x[q]))[:21].tolist() if i != q][:20])) / 20 for q, (rows, _) in zip(asked, best)]
    share = verified / len(asked) / len(x)
    with capsys.disabled():
        print(f" [{kind}: recall {np.mean(met):.3f}, verified {share:.3f} of the rows]", end="")
    assert np.mean(met) >= 0.9 and share < 0.25


def test_neighbours_ties_across_blocks(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(60)], "vec_id long, embedding array<double>").repartition(5)
    found = rows(neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=5, block=7, query_block=2)).sort_values(["query_id", "rank"])
    want = {q: [i for i in range(60) if i != q and (i % 3 > 0) == (q % 3 > 0)][:5] for q in (0, 20, 40)}
    assert {q: g.vec_id.tolist() for q, g in found.groupby("query_id")} == want


# ---- 8


def test_packing(docs, plain):
    found = rows(packing.pack(docs, WORD)).sort_values(["sequence_id", "offset"])
    for _, g in found.groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert found.sequence_id.nunique() <= found.length.sum() / 4096 * 1.05 + 1
    from tokenizers import Tokenizer

    ids = [np.array(e.ids + [1], "<u4") for e in Tokenizer.from_file(WORD).encode_batch(plain.text.tolist(), add_special_tokens=False)]
    want = [(d, k // 4096, k, len(a[k : k + 4096]), zlib.crc32(a[k : k + 4096].tobytes())) for d, a in zip(plain.doc_id, ids) for k in range(0, len(a), 4096)]
    assert list(found.sort_values(["doc_id", "piece"])[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want


def test_packing_places_by_sum_of_squares():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 60, 300)
    bins, offsets = packing.place(sizes, 64)
    left = []  # the rule, step by step
    for s, b in zip(sizes.tolist(), bins.tolist()):
        n = Counter(left)
        total = lambda c: sum(v * v for g, v in c.items() if g)
        options = {g: total(n - Counter([g]) + Counter([g - s])) for g in set(left) if g >= s}
        new = total(n + Counter([64 - s]))
        if b == len(left):
            assert not options or new < min(options.values())
            left.append(64 - s)
        else:
            assert options[left[b]] == min(options.values()) <= new
            left[b] -= s
    assert max(bins) + 1 == len(left) and (offsets >= 0).all()


def test_packing_odd_rows(odd, none):
    found = rows(packing.pack(odd, WORD))
    assert set(found.doc_id.dropna()) == {1, 2, 3, 4, 5, 7, 8, 9} and found[found.doc_id == 1].length.tolist() == [1]
    assert packing.pack(none, WORD).count() == 0


# ---- 10


def plain_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = list(zip(w, w[1:], w[2:]))
    c = Counter(windows)
    cover = {i + k for i, x in enumerate(windows) if c[x] > 1 for k in range(3)}
    lines = t.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)]


def test_statistics(plain):
    for t in [*plain.text, "", "a a a a", "a b c a b c", "a b c a b", "x\n\nx\n \nx #<é> \u00a0y"]:
        assert rules.statistics(t)[:5] == plain_statistics(t)


def test_rules_separate_labels(spark):
    d = "/root/testdata/sf0.1"
    found = rows(queries.op10_rules(spark, d))
    m = found.merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    m = m[~m.base_failed]
    assert m[m.quality == 1].kept.mean() > 0.99 and m[m.quality == 0].kept.mean() < 0.1


def plain_threshold(score, good, keep):
    if not good.any() or good.all():
        return np.quantile(score, keep)
    order = np.unique(score)
    cuts = np.append((order[:-1] + order[1:]) / 2, order[-1])
    kept = np.array([(score[good] <= c).mean() for c in cuts])
    gone = np.array([(score[~good] > c).mean() for c in cuts])
    return cuts[np.argmax(np.where(kept >= min(keep, 1 - 1.5 / good.sum()), kept + gone, -1))]


@pytest.mark.parametrize("n,share,keep", [(900, 0.9, 0.998), (900, 0.5, 0.9), (900, 1.0, 0.998), (900, 0.0, 0.95), (2, 0.5, 0.998), (9, 0.2, 0.998), (1, 1.0, 0.998)])
def test_rules_threshold_of_all_rows(spark, n, share, keep):
    rng = np.random.default_rng(n)
    good = np.arange(n) < round(n * share)
    score = np.round(rng.normal(np.where(good, 0.4, 0.6), 0.1), 2)  # ties, too
    df = spark.createDataFrame(pd.DataFrame({"score": score, "good": good})).repartition(5)
    assert rules.calibrate(df, keep) == pytest.approx(plain_threshold(score, good, keep), abs=1e-12)
    assert rules.quantiles(df.select("score", (-F.col("score")).alias("x")), n, keep) == pytest.approx([np.quantile(score, keep), np.quantile(-score, keep)], abs=1e-12)


def test_rules_learn_from_all_labels(spark):
    """Over 20,000 labelled rows: what is usual and the threshold are those of all of them, not of a part."""
    n = 24_000
    rng = np.random.default_rng(4)
    stats = np.stack([rng.integers(60, 500, n), rng.integers(300, 3000, n), rng.integers(0, 9, n), *np.zeros((2, n), int), rng.integers(1, 9, n), rng.integers(40, 60, n), *rng.integers(0, 30, (4, n))], axis=1)
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(n), "mark": rng.integers(-(1 << 62), 1 << 62, n), "stats": stats.tolist()}), "doc_id long, mark long, stats array<long>")
    good = np.arange(n) % 3 > 0
    model = rules.fit(docs, spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(n), "quality": good.astype(int)})))
    assert model.usual == pytest.approx(np.quantile(rules.shares(stats[good]), 1 - 0.002 / 8, axis=0), abs=1e-12)
    assert model.threshold == pytest.approx(plain_threshold(model.score(stats), good, 0.998), abs=1e-12)
    assert len(model.forest.trees) == 128 and model.forest.size == 256


def test_rules_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1)], "doc_id long, quality int")
    model = rules.fit(odd, labels)
    found = rows(rules.judge(odd, model))
    assert len(found) == len(ODD) and found[found.doc_id == 1].base_failed.all() and not found[found.doc_id == 1].kept.any()
    assert rules.judge(none, rules.fit(none, labels.limit(0))).count() == 0


# ---- the pipeline


def test_pipeline_stages(spark, docs, sf):
    import corpus_pipeline as P
    from skein.llm.common import stored

    out = {"": docs}
    for name, stage in P.STAGES:
        out[name] = stored(stage(spark, list(out.values())[-1], sf), "test")
    frames = {k: rows(v) for k, v in out.items()}
    good, lines, near, mixed = (frames[n] for n, _ in P.STAGES[:4])
    for f in (good, lines, near, mixed):
        assert list(f.columns) == docs.columns and (f.n_chars == f.text.str.len()).all()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    clean = set(labels[labels.quality == 1].doc_id) & set(frames[""].doc_id)
    assert len(clean & set(good.doc_id)) >= 0.95 * len(clean)
    good, lines = good.sort_values("doc_id"), lines.sort_values("doc_id")
    assert lines.text.tolist() == plain_lines(good.text, 10)
    comp = plain_components([plain_fingerprint(t) for t in lines.text], lines.doc_id.tolist())
    assert sorted(near.doc_id) == sorted(set(comp))
    words = lambda f: f.text.map(lambda t: len(t.split())).sum()
    assert abs(words(mixed) - words(near)) <= near.source.nunique()
    assert set(frames["best-fit packing"].doc_id) == set(mixed.doc_id)


@pytest.mark.parametrize("which", ["odd", "none"])
def test_pipeline_stages_on_odd_rows(spark, sf, which, request):
    """Null, empty and repeated rows, other columns and an empty table go through every stage."""
    import corpus_pipeline
    from skein.llm.common import stored

    docs = stored(request.getfixturevalue(which), "odd-rows")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf), "odd-stage")
        assert out.columns == docs.columns and out.count() <= 3 * docs.count()
    out = rows(corpus_pipeline.STAGES[-1][1](spark, docs, sf))
    assert len(out) >= docs.count() and (which == "odd" or len(out) == 0)
    assert len(out) == 0 or out.groupby("sequence_id").length.sum().max() <= 4096


def test_mixed_odd_rows(spark, odd, none):
    from skein.llm.common import stored

    kept = stored(odd, "mixed")
    out = rows(mixing.mixed(kept))
    taken = rows(mixing.mix(kept))
    assert list(out.columns) == odd.columns and sum(len(re.findall("[^ \t-\r]+", t)) for t in out.text) == taken.taken.sum()
    assert mixing.mixed(stored(none, "mixed")).count() == 0


def test_copies_go_by_row(spark):
    from skein.llm.common import stored

    text = "one two three four five six seven"
    docs = stored(spark.createDataFrame([(None, text), (None, text), (3, "quite another text that shares no words"), (3, text), (4, text)], "doc_id long, text string").coalesce(1), "copies")
    kept = rows(simhash.one_of_each(docs))
    assert kept[kept.text == text].doc_id.tolist() == [3]  # the smallest id, wherever it stands
    assert sorted(kept.text) == sorted(["quite another text that shares no words", text])


def test_one_text_for_each_labelled_id(spark):
    from skein.llm.common import labelled_texts

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None), (3, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    got = labelled_texts(docs, labels, "quality", F.lit(True), 10).collect()
    assert sorted((r.doc_id, r.y) for r in got) == [(1, 1), (2, 0)]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from skein.llm.common import shared_dir

    sc = SimpleNamespace(master="spark://host:7077", environment={}, getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=sc))


def test_packing_loses_a_few_sequences_a_shard():
    """In descending order, what the sum of squares leaves over is a few sequences, at any number of pieces."""
    rng = np.random.default_rng(6)
    for n in (2000, 10_000):
        lengths = np.sort(np.clip((rng.lognormal(6.2, 1, n)).astype(int), 1, 4095))[::-1]
        bins, offsets = packing.place(lengths, 4096)
        assert np.bincount(bins, lengths).max() <= 4096 and bins.max() + 1 - lengths.sum() / 4096 <= 4
