"""String similarities; all in 0..1, null where undefined. Those that Spark has no function for are one Arrow UDF each.

Work repeats within a batch (a record is in many pairs), so results are kept by pair of strings for the length of a batch. Comparisons that
grow with the product of both lengths have two versions: the one for a pair says what is meant, the one for many pairs does the same by numpy.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .tables import INITIALISM_STOP


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel(a: str, b: str) -> float:
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free: dict[str, int] = {}  # places of each character of b that are not taken yet
    for j, c in enumerate(b):
        free[c] = free.get(c, 0) | 1 << j
    taken, mine, window = 0, [], (1 << 2 * reach + 1) - 1
    for i, c in enumerate(a):
        if some := free.get(c, 0) & (window << i - reach if i >= reach else window >> reach - i):
            first = some & -some
            free[c] ^= first
            taken |= first
            mine.append(c)
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, t in zip(b, reversed(f"{taken:0{len(b)}b}")) if t == "1"]
    moved = sum(x != y for x, y in zip(mine, theirs)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    j, same = jaro(a, b), 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return j + 0.1 * same * (1 - j) if j > 0.7 else j


def _coded(texts: list[str]) -> tuple[int, np.ndarray]:
    """How many characters there are in the texts, and each of all texts' characters by its number among them."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    number = np.zeros(int(flat.max(initial=0)) + 1, np.int32)
    number[flat] = 1
    letters = np.flatnonzero(number)
    number[letters] = np.arange(len(letters))
    return len(letters), number[flat]


def _words(length: int) -> int:
    """Words of 64 places for a string and a free place; many words are rounded up, so that more strings are alike."""
    n = length // 64 + 1
    step = 1 << max(0, n.bit_length() - 3)
    return -(-n // step) * step


def _in_batches(pairs: list[tuple[str, str]], room: int, rows: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs in batches of like sizes, the shorter string first: (places in pairs, codes of the shorter strings and their lengths, words and
    lengths of the longer ones). Words say where in the longer string a code stands: (pair, code, 64 places). Rows are in ascending order of the
    shorter length; code 0 fills up and stands nowhere, and the last place of the words is free. room: words of a batch, for each character of the
    shorter strings if rows, a pair at least."""
    sides = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    of = [_words(len(long)) for _, long in sides]
    order = sorted(range(len(pairs)), key=lambda i: (of[i], len(sides[i][0])))
    at = 0
    while at < len(order):
        wide, end = of[order[at]], at + 1
        while end < len(order) and of[order[end]] == wide and (end + 1 - at) * wide * (len(sides[order[end]][0]) if rows else 1) <= room:
            end += 1
        some = order[at:end]
        n, m = (np.array([len(sides[i][k]) for i in some]) for k in (0, 1))
        letters, codes = _coded([sides[i][k] for k in (0, 1) for i in some])
        short = np.zeros((len(some), max(int(n.max()), 1)), np.int64)
        short[np.arange(short.shape[1]) < n[:, None]] = codes[: n.sum()] + 1
        stands = np.zeros((len(some), letters + 1, 64 * wide), bool)
        place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        stands[np.repeat(np.arange(len(some)), m), codes[n.sum() :] + 1, place] = True
        yield np.array(some), short, n, np.packbits(stands, axis=2, bitorder="little").view(np.uint64), m
        at = end


def _below(m: np.ndarray, wide: int) -> np.ndarray:
    """(word, pair): ones at the first m places."""
    left = np.clip(m - 64 * np.arange(wide)[:, None], 0, 64).astype(np.uint64)
    return np.where(left < 64, (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1), ~np.uint64(0))


def subsequences(pairs: list[tuple[str, str]]) -> list[int]:
    """common_subsequence for each pair, many at a time."""
    out = np.zeros(len(pairs), np.int64)
    for places, short, n, words, m in _in_batches(pairs, 20_000):
        count, known, wide = words.shape
        words, row = np.ascontiguousarray(words.transpose(2, 0, 1)).reshape(wide, -1), np.arange(count) * known
        v = np.full((wide, count), ~np.uint64(0))
        for t in range(int(n.max())):
            a = int(np.searchsorted(n, t, "right"))  # those before have no more characters
            at, carry = row[a:] + short[a:, t], None
            for w in range(wide):
                x, u = v[w, a:], words[w].take(at)
                u &= x
                total = x + u
                more = total < u
                if carry is not None:
                    total += carry
                    more |= total < carry
                x ^= u  # u has only ones of x, so nothing is borrowed
                x |= total
                carry = more.astype(np.uint64) if w + 1 < wide else None
        out[places] = m - np.bitwise_count(v & _below(m, wide)).sum(0, dtype=np.int64)
    return out.tolist()


def distances(pairs: list[tuple[str, str]]) -> list[int]:
    """Levenshtein's distance for each pair, many at a time: a column of the table is kept as steps up and down, 64 rows in a word."""
    out, one, top = np.zeros(len(pairs), np.int64), np.uint64(1), np.uint64(63)
    for places, short, n, words, m in _in_batches(pairs, 20_000):
        count, known, wide = words.shape
        words, row = np.ascontiguousarray(words.transpose(2, 0, 1)).reshape(wide, -1), np.arange(count) * known
        up, down = np.full((wide, count), ~np.uint64(0)), np.zeros((wide, count), np.uint64)
        for t in range(int(n.max())):
            a = int(np.searchsorted(n, t, "right"))
            at, carry, plus, minus = row[a:] + short[a:, t], None, one, None
            for w in range(wide):
                p, q, x = up[w, a:], down[w, a:], words[w].take(at)
                x |= q
                d = x & p
                d += p
                if w + 1 < wide:
                    more = d < p
                    if carry is not None:
                        d += carry
                        more |= d < carry
                    carry = more.astype(np.uint64)
                elif carry is not None:
                    d += carry
                d ^= p
                d |= x
                x = d | p
                np.invert(x, out=x)
                x |= q  # steps up from the column before
                y = d & p  # and down
                after = (x >> top, y >> top) if w + 1 < wide else (None, None)
                x <<= one
                x |= plus
                y <<= one
                if minus is not None:
                    y |= minus
                plus, minus = after
                np.bitwise_and(x, d, out=q)
                d |= x
                np.invert(d, out=d)
                np.bitwise_or(d, y, out=p)
        below = _below(m, wide)
        out[places] = n + np.bitwise_count(up & below).sum(0, dtype=np.int64) - np.bitwise_count(down & below).sum(0, dtype=np.int64)
    return out.tolist()


def substrings(pairs: list[tuple[str, str]]) -> list[float | None]:
    """common_substring_of for each pair, many at a time: where the characters are the same is a table of bits, and there are common strings
    of twice the length where the table agrees with itself, moved down the diagonal."""
    out: list[float | None] = [None] * len(pairs)

    def moved(table: np.ndarray, by: int, wide: int) -> np.ndarray:
        words, bits = divmod(by * (64 * wide + 1), 64)
        if words >= table.shape[1]:
            return table[:, :0]
        there = table[:, words:]
        if bits:
            there = there >> np.uint64(bits)
            there[:, :-1] |= table[:, words + 1 :] << np.uint64(64 - bits)
        return there & table[:, : there.shape[1]]

    def longest(table: np.ndarray, which: np.ndarray, low: int, high: int, wide: int, found: np.ndarray) -> None:
        """table: where common strings of the length low begin, which all have; none has one of the length high."""
        if not len(which):
            return
        if high - low == 1:
            found[which] = low
            return
        mid = min(2 * low, (low + high) // 2) if high < 4 * low else 2 * low
        longer = moved(table, mid - low, wide)
        more = longer.any(axis=1)
        longest(longer[more], which[more], mid, high, wide, found)
        longest(table[~more], which[~more], low, mid, wide, found)

    for places, short, n, words, m in _in_batches(pairs, 130_000, rows=True):
        wide, found = words.shape[2], np.zeros(len(places), np.int64)
        table = words[np.arange(len(places))[:, None], short].reshape(len(places), -1)
        some = table.any(axis=1)
        longest(table[some], np.flatnonzero(some), 1, int(n.max()) + 1, wide, found)
        for i, size, length in zip(places.tolist(), found.tolist(), n.tolist()):
            out[i] = size / length if length else None
    return out


def token_sort_of(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_of(a: str, b: str) -> float:
    """The best of three comparisons among the shared tokens and these with either side's own; 0 if a side has no token."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    joined = [f"{both} {own}".strip() for own in (left, right)]
    best = indel(*joined)
    return max(best, indel(both, joined[0]), indel(both, joined[1])) if both else best


def _indels(pairs: list[tuple[str, str]]) -> list[float]:
    return [2 * n / (len(a) + len(b)) if a or b else 1.0 for (a, b), n in zip(pairs, subsequences(pairs))]


def token_sorts(pairs: list[tuple[str, str]]) -> list[float]:
    """token_sort_of for each pair, many at a time."""
    ordered = {t: " ".join(sorted(t.split())) for t in {x for pair in pairs for x in pair}}
    return _indels([(ordered[a], ordered[b]) for a, b in pairs])


def token_sets(pairs: list[tuple[str, str]]) -> list[float]:
    """token_set_of for each pair, many at a time. The shared tokens are a beginning of what they are compared with, so the common subsequence
    of these two is all of them."""
    tokens = {t: frozenset(t.split()) for t in {x for pair in pairs for x in pair}}
    out, todo, rest = [0.0] * len(pairs), [], []
    for i, (a, b) in enumerate(pairs):
        x, y = tokens[a], tokens[b]
        if x and y:
            both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
            if both and (not left or not right):
                out[i] = 1.0
            else:
                joined = tuple(f"{both} {own}".strip() for own in (left, right))
                out[i] = max(2 * len(both) / (len(both) + len(j)) for j in joined) if both else 0.0
                todo.append(i)
                rest.append(joined)
    for i, best in zip(todo, _indels(rest)):
        out[i] = max(out[i], best)
    return out


def partial_of(a: str, b: str) -> float:
    """The shorter string against every window of its length in the longer one, windows that stick out at either end included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long else 0.0
    if short in long:
        return 1.0
    n, letters, best = len(short), set(short), 0.0
    for end in range(1, len(long) + n):
        window = long[max(0, end - n) : end]
        # only windows that begin (at the right end) or end (elsewhere) in a letter of the short string can be best
        if (window[-1] if end <= len(long) else window[0]) in letters and 2 * min(n, len(window)) > best * (n + len(window)):
            best = max(best, indel(short, window))
    if len(a) == len(b):
        n, letters = len(long), set(long)
        for end in range(1, 2 * n):
            window = short[max(0, end - n) : end]
            if 2 * len(window) > best * (n + len(window)):
                best = max(best, indel(long, window))
    return best


def _best_windows(shorts: list[str], longs: list[str]) -> np.ndarray:
    """For each pair the best similarity of the short string with any window of its length in the long one, windows that stick out included. One
    pass over the table of both strings serves all windows (semi-local alignment by strands that cross at most once); the tables of all pairs
    are worked at once, antidiagonal by antidiagonal, and what is added to fill them up matches nothing."""
    size, width = (np.array([len(x) for x in some]) for some in (shorts, longs))
    n, m, count = int(size.max()), int(width.max()), len(shorts)
    kind = np.int16 if n + m < 1 << 15 else np.int32
    letters, codes = _coded([*shorts, *longs])
    kind = kind if letters < (1 << 15) - 2 else np.int32
    a, b = np.full((count, n), letters, kind), np.full((count, m), letters + 1, kind)
    a[np.arange(n) >= n - size[:, None]] = np.concatenate([x[::-1] for x in np.split(codes[: size.sum()], np.cumsum(size)[:-1])])  # from its end, so that antidiagonals are slices; what fills it up comes last
    b[np.arange(m) < width[:, None]] = codes[size.sum() :]
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    h, v = (np.repeat(np.arange(k, k + x, dtype=kind)[:, None], count, 1) for k, x in ((0, n), (n, m)))
    room, ones = np.empty((min(n, m), count), kind), np.ones((min(n, m), count), kind)  # a scalar would take seven times as long
    for d in range(n + m - 1):
        k0, k1 = max(0, n - 1 - d), min(n, n - 1 - d + m)
        at, to = slice(k0, k1), slice(d - n + 1 + k0, d - n + 1 + k1)
        x, y, t = h[at], v[to], room[: k1 - k0]
        # they change places if the characters are the same or x > y: what goes to y is the larger one, or x
        np.bitwise_xor(a[at], b[to], out=t)
        np.minimum(t, ones[: k1 - k0], out=t)
        np.multiply(t, y, out=t)
        np.maximum(t, x, out=t)
        x += y
        x -= t
        y[:] = t
    start = v.T.astype(np.int64) - n  # where the strand that ends in a column began, negative: not in the long string
    column, size, width = np.arange(m), size[:, None], width[:, None]
    inside = (start >= 0) & (column < width)
    counted = lambda row, place: np.bincount(row * (m + 2) + place, minlength=count * (m + 2)).reshape(count, m + 2)
    # a strand costs every window that holds both its ends one letter
    first, last = np.maximum(column - size + 1, 0), np.minimum(start, width - size)
    row, col = np.nonzero(inside & (first <= last))
    cost = np.cumsum(counted(row, first[row, col]) - counted(row, last[row, col] + 1), axis=1)[:, :m]
    best = 1 - np.where(column <= width - size, cost, size).min(axis=1) / size[:, 0]
    row, col = np.nonzero(inside)
    left, right = np.cumsum(inside, axis=1), np.cumsum(counted(row, (width - 1 - start)[row, col]), axis=1)[:, :m]
    out = np.where(column + 1 < size, 2 * (column + 1 - np.minimum(left, right)) / (size + column + 1), 0.0)
    return np.maximum(best, out.max(axis=1))


def partials(pairs: list[tuple[str, str]]) -> list[float]:
    """partial_of for each pair, many at a time."""
    out: list[float] = [0.0] * len(pairs)
    todo = []
    for i, (a, b) in enumerate(pairs):
        short, long = sorted((a, b), key=len)
        if not short or short in long:
            out[i] = 1.0 if short or not long else 0.0
        else:
            like = int(8 * math.log(len(long)))
            todo += [(like, len(short), i, short, long)] + [(like, len(short), i, long, short)] * (len(a) == len(b))
    todo.sort(key=lambda x: x[:2])
    at = 0
    while at < len(todo):
        end = at + 1
        while end < len(todo) and todo[end][0] == todo[at][0] and (end + 1 - at) * todo[end][1] <= 32_000:
            end += 1
        some = todo[at:end]
        for (_, _, i, _, _), best in zip(some, _best_windows([x[3] for x in some], [x[4] for x in some]).tolist()):
            out[i] = max(out[i], best)
        at = end
    return out


def common_substring_of(a: str, b: str) -> float | None:
    """Longest common substring by the length of the shorter string."""
    if not a or not b:
        return None
    short, long = sorted((a, b), key=len)
    low, high = 0, len(short)
    while low < high:  # if some length is shared, every smaller one is
        n = (low + high + 1) // 2
        there = {long[i : i + n] for i in range(len(long) - n + 1)}
        if any(short[i : i + n] in there for i in range(len(short) - n + 1)):
            low = n
        else:
            high = n - 1
    return low / len(short)


def _tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")


def _initials(toks: Column) -> Column:
    return F.array_join(F.transform(toks, lambda t: F.substring(t, 1, 1)), "")


def abbreviation(a: Column, b: Column) -> Column:
    """Share of the tokens of the name with fewer that the other has: whole, as a beginning of one of its tokens or the other way round
    (two characters at least), or, if made of letters, as initials of tokens in a row. Null if a name has no token."""
    x, y = _tokens(a), _tokens(b)
    less, more = (F.when(F.size(x) <= F.size(y), one).otherwise(other) for one, other in ((x, y), (y, x)))
    begins = lambda t, u: (F.length(u) >= 2) & (F.startswith(u, t) | F.startswith(t, u))
    partly = lambda t: (F.length(t) >= 2) & (F.exists(more, lambda u: begins(t, u)) | (t.rlike(r"^\p{L}+$") & F.contains(_initials(more), t)))
    met = F.filter(less, lambda t: F.array_contains(more, t) | partly(t))
    return F.size(met) / F.nullif(F.size(less), F.lit(0))


_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")  # \s of Java


def abbreviations(pairs: list[tuple[str, str]]) -> list[float | None]:
    """abbreviation for each pair. Of two tokens that begin alike the first two characters are the same, so only such tokens are looked at."""
    held: dict[str, tuple[list[str], dict[str, list[str]], str]] = {}

    def parts(text: str):
        if text not in held:
            toks, begins = [t for t in _BLANKS.split(text) if t], {}
            for t in toks:
                if len(t) >= 2:
                    begins.setdefault(t[:2], []).append(t)
            held[text] = toks, begins, "".join(t[0] for t in toks)
        return held[text]

    out: list[float | None] = []
    for a, b in pairs:
        x, y = parts(a), parts(b)
        (less, _, _), (more, begins, initials) = (x, y) if len(x[0]) <= len(y[0]) else (y, x)
        known = set(more)
        met = sum(t in known or len(t) >= 2 and (any(u.startswith(t) or t.startswith(u) for u in begins.get(t[:2], ())) or t.isalpha() and t in initials) for t in less)
        out.append(met / len(less) if less else None)
    return out


def initialism(a: Column, b: Column) -> Column:
    """1 if either name has, as a token or as all its tokens put together, the initials of the other, with small words or without."""
    x, y = _tokens(a), _tokens(b)

    def short_forms(toks: Column) -> Column:
        long = F.filter(F.array(toks, F.filter(toks, lambda t: ~t.isin(*INITIALISM_STOP))), lambda ts: F.size(ts) >= 2)
        return F.transform(long, _initials)

    named = lambda toks: F.concat(toks, F.array(F.array_join(toks, "")))
    return (F.arrays_overlap(short_forms(y), named(x)) | F.arrays_overlap(short_forms(x), named(y))).cast("double")


def _udf(f: Callable[[str, str], float | None]):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        held: dict[tuple[str, str], float | None] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in held:
                held[pair] = f(*pair)
            out.append(held[pair])
        return pd.Series(out, dtype="float64")

    return lambda a, b: F.nanvl(run(a, b), F.lit(None).cast("double"))


def _batched(f: Callable[[list[tuple[str, str]]], list[float | None]]):
    """f for a batch at once."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = list(zip(a.fillna(""), b.fillna("")))
        each = list(dict.fromkeys(pairs))
        found = dict(zip(each, f(each)))
        return pd.Series([found[x] for x in pairs], dtype="float64")

    return lambda a, b: F.nanvl(run(a, b), F.lit(None).cast("double"))


def levenshtein(a: Column, b: Column) -> Column:
    """Null if either text is."""
    return F.when(a.isNotNull() & b.isNotNull(), _distance(a, b))


jaro_winkler = _udf(jaro_winkler_of)
token_sort, token_set, partial, common_substring, _distance = map(_batched, (token_sorts, token_sets, partials, substrings, distances))

#: Comparisons of many pairs at a time, by name.
MANY: dict[str, Callable[[list[tuple[str, str]]], list]] = {
    "levenshtein": distances, "token_sort": token_sorts, "token_set": token_sets, "partial": partials, "common_substring": substrings,
    "jaro_winkler": lambda pairs: [jaro_winkler_of(*x) for x in pairs], "abbreviation": abbreviations,
}


def compared(pairs: DataFrame, wanted: list[tuple[str, str]], weighted: Sequence[str] = (), rows: int = 32_768, size: int = 64 << 20) -> DataFrame:
    """pairs with _<name>_<text> for each (name in MANY, text) of wanted, from columns a_<text> and b_<text>, and _weighted_<text>: the weight of
    the shared words by that of all words, from the weights a_<text>_w of distinct words in their order. Works on some `rows` rows, or `size`
    bytes, at a time: the more there are, the less it takes for a pair."""
    names = [f"_{n}_{x}" for n, x in wanted] + [f"_weighted_{x}" for x in weighted]

    def weigh(t: pa.Table, text: str) -> list[float | None]:
        words = lambda s: [w for w in dict.fromkeys(_BLANKS.split(s)) if w]
        held: dict[str, dict[str, float]] = {}
        out = []
        for a, b, u, v in zip(*(t[f"{side}_{text}{w}"].to_pylist() for w in ("", "_w") for side in "ab")):
            if a is None or b is None:
                out.append(None)
                continue
            x, y = (held[s] if s in held else held.setdefault(s, dict(zip(words(s), w or ()))) for s, w in ((a, u), (b, v)))
            both = math.fsum(w for k, w in x.items() if k in y)
            total = math.fsum(x.values()) + math.fsum(y.values()) - both
            out.append(math.floor(both / total * 1e6 + 0.5) / 1e6 if total else None)
        return out

    def run(batches):
        def done():
            t = pa.Table.from_batches(held)
            add = []
            for name, x in wanted:
                each = list(zip(t[f"a_{x}"].to_pylist(), t[f"b_{x}"].to_pylist()))
                some = list(dict.fromkeys((a or "", b or "") for a, b in each))
                found = dict(zip(some, MANY[name](some)))
                add.append([None if name == "levenshtein" and (a is None or b is None) else found[a or "", b or ""] for a, b in each])
            for text in weighted:
                add.append(weigh(t, text))
            for name, values in zip(names, add):
                t = t.append_column(name, pa.array(values, pa.float64()))
            return t.to_batches(max_chunksize=10_000)

        held = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= size:
                yield from done()
                held = []
        if held:
            yield from done()

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, *[StructField(name, DoubleType()) for name in names]]))
