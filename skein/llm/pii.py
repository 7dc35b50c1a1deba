"""Personal data by aggregated labelers (operator 5).

Base spans follow fixed rules for each kind and always stay. Further candidates come from looser patterns: addresses and numbers in
disguise, phone numbers without a plus sign, cards whose digits are grouped in other ways. Labelers vote on every candidate, base spans
included: strict and loose patterns, gazetteers (mail hosts and endings, words that announce a kind), checksums and value ranges, context
on either side. Expectation-maximisation over the counts of vote patterns in all documents estimates each labeler's reliability, and a
logistic classifier over the votes, trained on the posteriors, decides which of the other candidates become spans.

The pass over the texts is linear in their length: addresses are found from their @ sign, numbers from their runs of digits.

Edge cases: a null or empty text has no spans. Offsets count code points, the end is exclusive. Rows that share a doc_id each get a row.
Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")
#: Looser patterns for further candidates.
_LOOSE = {
    "email": re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[A-Za-z0-9-]{2,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\s?[0-9]{1,3}){3}(?![0-9.])", re.I),
    "card": re.compile(r"(?<![0-9.+])[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{1,7}(?![0-9.])"),
    "phone": re.compile(r"(?<![0-9+(.])(?:\([0-9]{2,5}\)\s?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])00[1-9][0-9]{0,2}[ ./-][0-9][0-9 ./-]{6,14}[0-9](?![0-9])"),
}
#: Words that announce a kind, and those that speak against it.
_CUES = {
    "email": frozenset("email e-mail mail mailto contact kontakt correo courriel write reach".split()),
    "ip": frozenset("ip ipv4 address host server gateway ping login adresse servidor serveur".split()),
    "card": frozenset("card visa mastercard amex credit debit kreditkarte karte tarjeta carte payment pay cc".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell whatsapp telefon telefono téléfono téléphone teléfono handy anruf ring".split()),
}
_AGAINST = frozenset("version isbn issn id order invoice item sku section figure chapter build release article nummer".split())
_HOSTS = frozenset("gmail hotmail outlook yahoo aol icloud gmx web proton protonmail example mail".split())
_ENDINGS = frozenset("com org net edu gov io co de fr es uk it nl eu us info biz".split())
_WORD = re.compile(r"[^\W\d_][\w-]*")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as in KINDS, then by start."""
    out = []
    last = 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _DOTTED.finditer(text):
            parts = m[0].split(".")
            start = m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = start + len(".".join(four))
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append(("ip", start, end))
                start = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(d) <= 19 and _luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def more_candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of the looser patterns that overlap no base span, nor one another: the kind listed first goes first. No number of an ip
    is above 255."""
    out = []
    low = text.lower() if "(" in text or "[" in text or "{" in text else ""
    digits = _DIGIT.search(text) is not None
    for kind in KINDS:
        if kind == "email" and not any(x in low for x in ("(at)", "[at]", "{at}")) or kind == "ip" and not any(x in low for x in ("[.]", "(.)", "[dot]", "(dot)")) or kind in ("card", "phone") and not digits:
            continue
        out += [(kind, m.start(), m.end()) for m in _LOOSE[kind].finditer(text) if not any(a < m.end() and m.start() < b for _, a, b in (*base, *out))]
        if kind == "ip":
            out = [x for x in out if x[0] != "ip" or max(map(int, re.findall("[0-9]+", text[x[1] : x[2]]))) <= 255]
    return out


def votes(text: str, kind: str, a: int, b: int, base: bool) -> tuple[int, ...]:
    """1 for, -1 against, 0 abstains: strict pattern, checksum or range, shape, gazetteer, cue before, cue after, borders, uniform digits."""
    span, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 20]
    digits = _NOT_DIGIT.sub("", span)
    near = [w.lower() for w in _WORD.findall(before)[-4:]]
    behind = [w.lower() for w in _WORD.findall(after)[:2]]
    if kind == "email":
        parts = [p.lower() for p in re.split(r"\W+|dot", span) if p]
        check = 1 if parts and parts[-1].isalpha() and 2 <= len(parts[-1]) <= 6 else -1
        known = 1 if parts and (parts[-1] in _ENDINGS or set(parts) & _HOSTS) else 0
        shape = 1 if 6 <= len(span) <= 80 else -1
    elif kind == "ip":
        numbers = [int(x) for x in re.findall("[0-9]{1,4}", span)]
        check = 1 if len(numbers) == 4 and max(numbers) <= 255 else -1
        known = 0
        shape = -1 if re.search(r"(?<![0-9])0[0-9]", span) else 1
    elif kind == "card":
        check = 1 if _luhn(digits) else -1
        known = 1 if digits[:1] in "3456" else -1
        shape = 1 if len(digits) in (15, 16) else -1
    else:
        check = 1 if 9 <= len(digits) <= 15 else -1
        known = 1 if "(" in span or span.startswith(("+", "00")) else 0
        shape = 1 if span.count("-") + span.count(" ") + span.count(".") <= 5 else -1
    cue = 1 if set(near) & _CUES[kind] else -1 if set(near) & _AGAINST else 0
    follow = 1 if set(behind) & _CUES[kind] else 0
    border = 1 if not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()) else -1
    plain = -1 if digits and len(set(digits)) <= 2 and len(digits) > 6 else 0
    return (1 if base else -1, check, shape, known, cue, follow, border, plain)


class Model:
    """For each kind the weights of a logistic classifier over votes, its last weight the bias."""

    def __init__(self, weights: dict[str, np.ndarray], threshold: float = 0.9):
        self.weights, self.threshold = weights, threshold

    def keeps(self, kind: str, vote: tuple[int, ...]) -> bool:
        w = self.weights.get(kind)
        return w is not None and 1 / (1 + np.exp(-np.clip(w[:-1] @ np.array(vote) + w[-1], -40, 40))) >= self.threshold


def reliabilities(v: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior P(personal) of each vote pattern (rows of v, met n times), by expectation-maximisation from the votes' sum."""
    q = 1 / (1 + np.exp(-(v.sum(axis=1) - 1.0)))
    for _ in range(rounds):
        prior = np.clip((q * n).sum() / n.sum(), 0.01, 0.99)
        z = np.full(len(v), np.log(prior / (1 - prior)))
        for j in range(v.shape[1]):
            # a cell of strong pseudo-counts that agree with what the labeler says keeps few candidates from turning it around
            p = np.stack([[((v[:, j] == x) * n * w).sum() + (2.0 if x * s >= 0 else 0.5) for x in (-1, 0, 1)] for w, s in ((1 - q, -1), (q, 1))])
            p /= p.sum(axis=1, keepdims=True)
            ratio = np.log(p[1] / p[0])
            ratio[0], ratio[2] = min(ratio[0], 0), max(ratio[2], 0)
            z += np.where(v[:, j] == 0, 0, ratio[v[:, j] + 1])
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - q).max() < 1e-7:
            break
        q = new
    return q


def _logistic(v: np.ndarray, n: np.ndarray, q: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x, w = np.column_stack([v, np.ones(len(v))]).astype(float), np.zeros(v.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (q - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, threshold: float = 0.9) -> Model:
    """Counts the vote patterns of all candidates in all documents (a few hundred different ones at most) and trains on them."""
    importable(docs.sparkSession)

    def count(batches):
        from collections import Counter

        held: Counter = Counter()
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                if t:
                    base = base_spans(t)
                    held.update((s[0], votes(t, *s, True)) for s in base)
                    held.update((s[0], votes(t, *s, False)) for s in more_candidates(t, base))
        rows = [(k, ",".join(map(str, v)), n) for (k, v), n in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "votes", "n"])

    got = docs.select("text").mapInArrow(count, "kind string, votes string, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect()
    weights = {}
    for kind in KINDS:
        rows = [r for r in got if r["kind"] == kind]
        if rows:
            v, n = np.array([[int(x) for x in r["votes"].split(",")] for r in rows]), np.array([r["n"] for r in rows], float)
            weights[kind] = _logistic(v, n, reliabilities(v, n))
    return Model(weights, threshold)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans) of every row; spans: array of (kind, start, end, base), by kind as in KINDS, then by start."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches):
        m = held.value
        for b in slices(batches):
            out = []
            for t in b.column(1).to_pylist():
                base = base_spans(t) if t else []
                more = [s for s in more_candidates(t, base) if m.keeps(s[0], votes(t, *s, False))] if t else []
                both = [(*s, True) for s in base] + [(*s, False) for s in more]
                both.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                out.append([dict(zip(("kind", "start", "end", "base"), s)) for s in both])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long, base: boolean>>")
