"""Toxicity by weak supervision (operator 1).

1. Lexicons are mined from labelled rows: words, and beginnings of words of 4 to 8 letters, that toxic texts hold far more often than
   chance allows (binomial deviation above the logarithm of the number of terms looked at). Near-copies in the sample count once. The rows
   fall into two halves by a hash of their id, and each mined term knows which halves bear it out by themselves.
2. Voters: words and beginnings that the one half of the labels bears out, and those of the other half, so that no label speaks through two
   of them; a fixed list of English insults, look-alike spelling, direct address, repetition and density vote for toxic; the absence of any
   hit, and of any hit in a long text, votes against. Each voter may abstain.
3. A label model takes the true label as hidden and estimates by expectation-maximisation how often each voter votes which way on either
   class, and from the residuals how voters correlate; a voter's evidence is divided by what it shares with others.
4. A linear classifier is trained on hit counts with the posterior as its label, and gives the scores.

Only labels of rows for which `take` holds are read, in step 1 and for the share of toxic texts. The sample is bounded by `limit` rows, and
the lexicons by `most` terms (50,000), of which those with the strongest evidence stay.

Edge cases: a null or empty text has no hits and the score that goes with that; without labels of both classes only the fixed voters
remain, and where the sample has no text with a hit, or none without, the classifier is shown some. Rows that share a doc_id each get a row. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, importable, labelled_texts, slices

#: A short list of English insults.
INSULTS = "asshole bastard bitch bullshit clown crap cretin cunt degenerate disgusting dumbass fag faggot filth freak fuck fucker fucking garbage hate idiot idiotic imbecile jerk loser maggot moron moronic motherfucker nigger pathetic pig prick psycho rapist retard retarded scum scumbag shit shitty slut stupid subhuman trash twat vermin whore worthless".split()
#: Characters that stand for letters.
LOOKALIKES = str.maketrans("013457@$", "oleastas")
BEGINNINGS, PARTS = (4, 5, 6, 7, 8), 4
_MIXED = re.compile(r"[a-z]+[013457@$]+[a-z]+|[013457@$][a-z]{3,}")
_YOU = re.compile(r"\b(?:you|u|they|he|she)(?:'re|'s| are| is)? (?:an? |the |such an? |so |all )?([a-z]+)")
_NOT_ASCII_LETTER = {i: 32 for i in range(128) if not chr(i).isalpha()}


def words_of(text: str | None) -> list[str]:
    """Lower-case runs without ASCII characters other than letters."""
    return (text or "").lower().translate(_NOT_ASCII_LETTER).split()


class Lexicon(dict):
    """Of each word, the number of its group: 0 for none, 1 to PARTS for mined words, then PARTS for beginnings, then the fixed list.

    words, beginnings: terms, each with the halves of the labels that bear it out: 0 neither, 1 the first, 2 the second, 3 both.
    """

    GROUPS = 2 * PARTS + 1

    def __init__(self, words: dict[str, int], beginnings: dict[str, int]):
        self.words, self.beginnings, self.fixed = words, beginnings, frozenset(INSULTS)
        self.sizes = sorted({len(b) for b in beginnings})

    def __missing__(self, w: str) -> int:
        g = 0
        if w in self.words:
            g = 1 + self.words[w]
        elif b := next((w[:n] for n in self.sizes if w[:n] in self.beginnings), None):
            g = 1 + PARTS + self.beginnings[b]
        elif w in self.fixed:
            g = self.GROUPS
        if len(self) > 400_000:
            self.clear()
        self[w] = g
        return g

    def counts(self, text: str | None) -> np.ndarray:
        """Hits by group (from 1), look-alikes, direct address, distinct hits, words."""
        words = words_of(text)
        codes = list(map(self.__getitem__, words))
        out = np.zeros(self.GROUPS + 5)
        out[-1] = len(words)
        if any(codes):
            for c in codes:
                out[c] += 1
            out[-2] = len({w for w, c in zip(words, codes) if c})
            low = text.lower()
            out[-3] = sum(1 for m in _YOU.finditer(low) if self[m[1]])
        out[0] = 0
        if text and any(c in text for c in "013457@$"):
            out[-4] = sum(1 for m in _MIXED.finditer(text.lower()) if self[m[0].translate(LOOKALIKES)])
        return out


def votes(counts: np.ndarray) -> np.ndarray:
    """A column for each voter: 1 toxic, -1 not, 0 abstains."""
    hits, likes, you, distinct, n = counts[:, 1 : Lexicon.GROUPS + 1], *(counts[:, -k] for k in (4, 3, 2, 1))
    total = hits.sum(axis=1) + likes
    halves = [(first + half, first + 3) for first in (0, PARTS) for half in (1, 2)]  # a term of both halves votes with either
    columns = [(hits[:, h].sum(axis=1) > 0).astype(int) for h in (*map(list, halves), [2 * PARTS])]
    columns += [(likes > 0).astype(int), (you > 0).astype(int), (total >= 3).astype(int), (distinct >= 2).astype(int), (total > 0.01 * n).astype(int) * (total > 0)]
    columns += [np.where(total == 0, -1, 0), np.where((total == 0) & (n >= 100), -1, 0)]
    return np.stack(columns, axis=1)


class LabelModel:
    """Voters' reliabilities and correlations, from their votes alone; the share of toxic texts is given."""

    def __init__(self, v: np.ndarray, prior: float = 0.1, rounds: int = 40):
        self.prior, n = min(max(prior, 0.01), 0.5), len(v)
        self.shared = np.eye(v.shape[1])
        q = np.clip(0.02 + 0.96 * (v.sum(axis=1) > 0), 0, 1) if n else np.zeros(0)
        for _ in range(rounds):
            self.log = self._table(v, q)
            self.shared = self._shared(v, q)
            first = (self.log, self.shared) if not _ else first
            new = self.posterior(v)
            if n == 0 or np.abs(new - q).max() < 1e-6:
                break
            q = new
        some = v.max(axis=1) > 0 if n else np.zeros(0, bool)
        if some.any() and (self.posterior(v)[some] < 0.5).all():
            self.log, self.shared = first  # too few votes to learn from: what the majority vote says

    @staticmethod
    def _table(v: np.ndarray, q: np.ndarray) -> np.ndarray:
        """log P(vote | class), by class, voter and vote + 1."""
        out = np.zeros((2, v.shape[1], 3))
        for c, w in enumerate((1 - q, q)):
            for x in (-1, 0, 1):
                out[c, :, x + 1] = ((v == x) * w[:, None]).sum(axis=0) + 0.5
        # a vote for toxic may not be held as evidence against, and the other way round
        p = out / out.sum(axis=2, keepdims=True)
        p[0, :, 2] = np.minimum(p[0, :, 2], p[1, :, 2])
        p[1, :, 0] = np.minimum(p[1, :, 0], p[0, :, 0])
        return np.log(p)

    @staticmethod
    def _shared(v: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Absolute residual correlations of voters within the classes."""
        total = np.zeros((v.shape[1], v.shape[1]))
        for w in (1 - q, q):
            if w.sum() < 2:
                continue
            x = v - np.average(v, axis=0, weights=w)
            cov = (x * w[:, None]).T @ x / w.sum()
            sd = np.sqrt(np.diag(cov))
            total += np.abs(np.divide(cov, np.outer(sd, sd), out=np.zeros_like(cov), where=np.outer(sd, sd) > 1e-9)) / 2
        np.fill_diagonal(total, 1)
        total[total < 0.1] = 0
        return total

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(toxic | votes). Who abstains says nothing; the others' evidence is divided by what they share with those that vote, too."""
        voted = v != 0
        share = voted / np.maximum(voted @ self.shared, 1)
        z = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for j in range(v.shape[1]):
            z += share[:, j] * (self.log[1, j] - self.log[0, j])[v[:, j] + 1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def inputs(counts: np.ndarray) -> np.ndarray:
    """What the linear classifier sees of the hits."""
    hits, likes, you, distinct, n = counts[:, 1 : Lexicon.GROUPS + 1], *(counts[:, -k] for k in (4, 3, 2, 1))
    total = hits.sum(axis=1) + likes
    some = [total > 0, total >= 2, np.minimum(np.log1p(total), 2), np.minimum(np.log1p(distinct), 2), np.minimum(1, 10 * total / np.maximum(n, 1)), np.log1p(you), np.log1p(likes), np.log1p(hits[:, :PARTS].sum(axis=1)), np.log1p(hits[:, PARTS : 2 * PARTS].sum(axis=1)), np.log1p(hits[:, -1]), np.ones(len(n))]
    return np.stack([np.asarray(x, float) for x in some], axis=1)


def linear(x: np.ndarray, q: np.ndarray, ridge: float = 0.03, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression on soft labels q, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (q - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _terms(text: str | None) -> set[str]:
    """Words, and beginnings with a hyphen behind."""
    words = set(words_of(text))
    return words | {f"{w[:n]}-" for w in words for n in BEGINNINGS if len(w) > n}


def mine(sample: DataFrame, least: int = 4, alpha: float = 1.0, most: int = 50_000) -> tuple[dict[str, int], dict[str, int]]:
    """(words, beginnings) that mark label 1 in sample (doc_id, text, y), at most `most` of them, each with the halves that bear it out;
    of texts with the same sketch, the one with the smallest hash counts."""

    def sketch(batches):
        from xxhash import xxh3_64_intdigest

        for b in slices(batches):
            marks = []
            for t in b.column(0).to_pylist():
                w = words_of(t)
                grams = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
                marks.append(min(xxh3_64_intdigest(g) for g in grams) >> 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(marks, pa.int64())], names=["text", "kind", "mark"])

    def count(batches):
        held = [Counter() for _ in range(4)]
        for b in slices(batches):
            for t, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[kind].update(_terms(t))
                if sum(map(len, held)) > 400_000:
                    yield said(held)
                    held = [Counter() for _ in range(4)]
        yield said(held)

    def said(held):
        terms = list(set().union(*held))
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([h[t] for t in terms], pa.int64()) for h in held)], names=["term", *counts])

    counts = ("against_a", "hits_a", "against_b", "hits_b")
    kind = (2 * F.pmod(F.xxhash64("doc_id"), F.lit(2)) + (F.col("y") > 0).cast("int")).cast("int").alias("kind")  # half and label
    one = sample.select("text", kind).mapInArrow(sketch, "text string, kind int, mark long")
    one = checkpoint(one.groupBy("mark").agg(F.min_by(F.struct("text", "kind"), F.struct(F.xxhash64("text"), "kind")).alias("x")).select("x.text", "x.kind"))
    n = one.agg(F.count("*").alias("n"), F.sum(F.col("kind") % 2).alias("pos")).first()
    if not n["pos"] or n["pos"] == n["n"]:
        return {}, {}
    base = n["pos"] / n["n"]
    found = one.mapInArrow(count, f"term string, {', '.join(f'{c} long' for c in counts)}").groupBy("term").agg(*[F.sum(c).alias(c) for c in counts])
    found = found.withColumns({c: F.col(f"{c}_a") + F.col(f"{c}_b") for c in ("against", "hits")})
    found = checkpoint(found.where(F.col("hits") + F.col("against") >= least))
    looked = max(found.count(), 1)
    n, p = F.col("hits") + F.col("against"), F.col("hits") / (F.col("hits") + F.col("against"))
    deviation = n * (p * F.log(p / base) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0))
    sure = found.where((F.col("hits") > 0) & (p >= 0.9)).withColumn("deviation", deviation).where(F.col("deviation") > float(np.log(looked / alpha)))
    borne = lambda half: ((F.col(f"hits_{half}") >= 2) & (F.col(f"hits_{half}") >= 0.9 * (F.col(f"hits_{half}") + F.col(f"against_{half}")))).cast("int")
    sure = sure.withColumn("halves", borne("a") + 2 * borne("b"))
    got = {r["term"]: (r["hits"], r["halves"]) for r in sure.orderBy(F.col("deviation").desc(), "term").limit(most).collect()}
    words = {t: halves for t, (_, halves) in got.items() if not t.endswith("-")}
    # a beginning must stand for more than one frequent word
    one_word = {f"{w[:n]}-" for w in words for n in BEGINNINGS if got[w][0] >= 0.7 * got.get(f"{w[:n]}-", (1 << 60, 0))[0]}
    return words, {t[:-1]: halves for t, (_, halves) in got.items() if t.endswith("-") and t not in one_word}


class Model:
    def __init__(self, words: dict[str, int], beginnings: dict[str, int], weights: np.ndarray):
        self.lexicon, self.weights = Lexicon(words, beginnings), weights

    def scores(self, texts: list) -> np.ndarray:
        x = inputs(np.array([self.lexicon.counts(t) for t in texts]).reshape(len(texts), -1))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", take=None, limit: int = 20_000) -> Model:
    """Learns from at most limit labelled rows for which take (a column of labels) holds."""
    importable(docs.sparkSession)
    sample = labelled_texts(docs, labels, label, F.lit(True) if take is None else take, limit)
    sample = checkpoint(sample)
    words, beginnings = mine(sample)

    def count(batches):
        lexicon = Lexicon(words, beginnings)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([lexicon.counts(t).tolist() for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "y", "counts"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(count, f"doc_id {kind}, y int, counts array<double>").orderBy("doc_id", "counts").collect()  # limit rows at most
    counts = np.array([r["counts"] for r in got]).reshape(len(got), Lexicon.GROUPS + 5)
    prior = float(np.mean([r["y"] > 0 for r in got])) if got else 0.1
    hit = counts[:, -2] > 0
    if hit.all() or not hit.any():  # a few texts with and without hits, so that the classifier knows both
        known = np.zeros((8, counts.shape[1]))
        known[:, -1] = (10, 100, 1000, 10, 100, 1000, 10, 100)
        known[3:, Lexicon.GROUPS] = (1, 2, 20, 2, 10)
        known[3:, -2] = (1, 1, 5, 2, 4)
        counts = np.concatenate([counts, np.repeat(known, 8, axis=0)])
    v = votes(counts)
    posterior = LabelModel(v, prior).posterior(v)
    return Model(words, beginnings, linear(inputs(counts), posterior))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    own = (model.lexicon.words, model.lexicon.beginnings, model.weights)
    held = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        m = Model(*held.value)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.scores(b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
