"""Token ids by the tokenizers library, with a cache by word.

Both vocabularies cut a text into words before they merge anything, and no merge crosses such a cut. So a text's ids are its words'
ids in a row, and a word that was met before need not be encoded again. The library's own cache holds 10,000 words; the corpora here
have millions of rare ones. The cache has two generations, so that it forgets words that were not used lately and no others.

Texts go through in parts: Arrow cuts a part into words and numbers the distinct ones, only these are looked up, and Arrow puts their ids
in the order of the words. New words of letters go to the library's model many at a time. Whatever this could get wrong (strings of added
tokens, odd white space, other scripts, digits) goes to the library as it is: the ids are those of Tokenizer.from_file(path).encode(text,
add_special_tokens=False), also where a text spells an added token out, which the library then gives its own id.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from pathlib import Path
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

assert array("I").itemsize == 4 and sys.byteorder == "little"
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Byte-level vocabularies write each byte as a character: printable ones as themselves, the rest in order from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}
#: The same, but a line feed becomes the space at which words for the model are cut.
_LISTED = _BYTE_CHARS | {10: 32}
#: Stands before a text's first word; texts that hold it go to the library.
_MARK = "\x02"
#: White space to str.split, but not to the library.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: White space other than one space or line feed between words, in ASCII texts and in all.
_ASCII_ODD = ["  ", " \n", "\n ", "\n\n", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"]
_WIDE = [*map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
_ODD = [*_ASCII_ODD, *_WIDE]
_LATIN = "^[\\x00-\\x{ff}]*$"
#: Characters of text that are cut into words at once, and words that the model gets at once.
_PART, _LIST = 8 << 20, 500
_HELD: dict[tuple[str, str], WordCache] = {}


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.uint32()))


def _ragged(pieces: list[bytes]) -> pa.ListArray:
    return _lists(np.array([len(p) // 4 for p in pieces], np.int64), np.frombuffer(b"".join(pieces), "<u4"))


def listed(column: pa.Array) -> list:
    """to_pylist() of strings or bytes, ten times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(hash, listed(words)), np.int64, len(words))


class _Tails(dict):
    """Runs of ASCII punctuation behind a word; each is cut off as one piece."""

    def __init__(self, encode):
        self._encode = encode

    def __missing__(self, tail: str) -> bytes:
        ids = self._encode(tail)
        if len(self) < 10_000:
            self[tail] = ids
        return ids


class WordCache:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit integers. kind: "byte" or "word", as the vocabulary.

    limit: words that are kept, in two Arrow columns of some 40 bytes a word; beyond it, the half that was used last stays. Words are found
    by sorted hashes, which grow with the cache (a hash table of Arrow's would be built anew for each part), and compared as they are.
    """

    def __init__(self, path: str, kind: str, limit: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self._limit, self._byte = limit, kind == "byte"
        self._words, self._ids = pa.array([], pa.string()), _ragged([])
        self._used, self._turn = np.zeros(0, np.int32), 0
        self._hashes, self._place = np.zeros(0, np.int64), np.zeros(0, np.int32)  # of the words in order of their hashes
        self._tokenizer = Tokenizer.from_file(path)
        self._listed = Tokenizer(self._tokenizer.model)  # cuts at spaces only
        self._listed.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._tails = _Tails(self._whole)
        self._added = {t["content"][:2] for t in json.loads(Path(path).read_text(encoding="utf-8"))["added_tokens"]} | {_MARK}

    def _whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, words: pa.Array) -> pa.ListArray:
        """Ids of words of letters, which the model sees as byte characters, one list after another."""
        words = listed(words)
        if self._byte:  # a space before each, but for those with a mark
            words = [w[1:] if w[0] == _MARK else f" {w}" for w in words]
        lists = ["\n".join(words[i : i + _LIST]) for i in range(0, len(words), _LIST)]
        lists = [(x if self._byte else x.lower()).encode().decode("latin-1").translate(_LISTED) for x in lists]
        ids, counts = array("I"), [np.zeros(0, np.int64)]
        for e in self._listed.encode_batch(lists, add_special_tokens=False):
            ids.extend(e.ids)
            of = np.array(e.word_ids)
            counts.append(np.diff(np.flatnonzero(of[1:] != of[:-1]) + 1, prepend=0, append=len(of)))
        return _lists(np.concatenate(counts), np.frombuffer(ids, "<u4"))

    def _learn(self, words: pa.Array, ids: pa.ListArray) -> None:
        hashes, n = _hashes(words), len(self._words)
        order = np.argsort(hashes)
        to = np.searchsorted(self._hashes, hashes[order], "right")
        self._hashes, self._place = np.insert(self._hashes, to, hashes[order]), np.insert(self._place, to, n + order)
        self._words, self._ids = pa.concat_arrays([self._words, words]), pa.concat_arrays([self._ids, ids])
        self._used = np.append(self._used, np.full(len(words), self._turn, np.int32))

    def _find(self, words: pa.Array) -> np.ndarray:
        """Where the cache has each of words, or -1. Of words with one hash only the first learned is found; the others are learned again."""
        if not len(self._words) or not len(words):
            return np.full(len(words), -1, np.int64)
        hashes = _hashes(words)
        order = np.argsort(hashes)
        near = np.empty(len(words), np.int64)
        near[order] = np.searchsorted(self._hashes, hashes[order])
        near = np.minimum(near, len(self._hashes) - 1)
        at = np.where(self._hashes[near] == hashes, self._place[near], -1).astype(np.int64)
        there = np.flatnonzero(at >= 0)
        same = pc.equal(words.take(pa.array(there)), self._words.take(pa.array(at[there]))).to_numpy(zero_copy_only=False)
        at[there[~same]] = -1
        return at

    def _forget(self) -> None:
        stay = np.sort(np.argsort(-self._used, kind="stable")[: self._limit // 2])
        now = np.full(len(self._used), -1, np.int32)
        now[stay] = np.arange(len(stay))
        held = now[self._place] >= 0
        self._hashes, self._place = self._hashes[held], now[self._place[held]]
        self._words, self._ids, self._used = self._words.take(pa.array(stay)), self._ids.take(pa.array(stay)), self._used[stay]

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the cache has each of these distinct runs without white space, after it has learned those that it did not have.

        A byte vocabulary has a space before each run, but for those that begin with a line feed or _MARK. A word of Latin letters is learned
        as such, one with punctuation behind it or a line feed before it from its parts, and any other from the library.
        """
        self._turn += 1
        cores = pc.utf8_rtrim(words, characters=punctuation)
        if self._byte:
            cores = pc.replace_substring(cores, "\n", _MARK)
        parted = np.flatnonzero(pc.not_equal(cores, words).to_numpy(zero_copy_only=False))
        cores = cores.take(pa.array(parted))
        found = self._find(pa.concat_arrays([words, cores]))
        at, core_at = found[: len(words)].copy(), found[len(words) :].copy()
        is_word = lambda w: pc.and_(pc.utf8_is_alpha(pc.utf8_ltrim(w, characters=_MARK) if self._byte else w), pc.match_substring_regex(w, _LATIN)).to_numpy(zero_copy_only=False)
        lacks = at[parted] < 0
        parted, cores, core_at = parted[lacks], cores.filter(pa.array(lacks)), core_at[lacks]
        made = is_word(cores)  # from parts
        rest = np.setdiff1d(np.flatnonzero(at < 0), parted[made])
        single = is_word(words.take(pa.array(rest)))
        merge = pc.unique(pa.concat_arrays([words.take(pa.array(rest[single])), cores.filter(pa.array(made & (core_at < 0)))]))
        if len(merge):
            start = len(self._words)
            self._learn(merge, self._merged(merge))
            at[rest[single]] = start + np.arange(single.sum())
            fresh = made & (core_at < 0)
            core_at[fresh] = start + pc.index_in(cores.filter(pa.array(fresh)), value_set=merge).to_numpy()
        if made.any():
            whole, parted, core_at = words.take(pa.array(parted[made])), parted[made], core_at[made]
            texts = listed(whole)
            tails = pa.array([w[len(w.rstrip(punctuation)) :] for w in texts]).dictionary_encode()
            few = _ragged([*map(self._tails.__getitem__, listed(tails.dictionary)), b"", self._tails["\n"]])
            n, pool = len(self._ids), pa.concat_arrays([self._ids, few])
            none = n + len(few) - 2
            three = np.stack([np.where(pc.starts_with(whole, "\n").to_numpy(zero_copy_only=False) & self._byte, none + 1, none), core_at, n + tails.indices.to_numpy()], axis=1)
            ids = pool.take(pa.array(three.ravel()))
            at[parted] = n + np.arange(len(whole))
            self._learn(whole, pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[::3]), ids.values))
        if not single.all():
            others = words.take(pa.array(rest[~single]))
            at[rest[~single]] = len(self._words) + np.arange(len(others))
            self._learn(others, _ragged([b"" if w == _MARK else self._whole(w[1:] if w[:1] == _MARK else w if w[:1] == "\n" or not self._byte else f" {w}") for w in listed(others)]))
        self._used[at] = self._turn
        return at

    def _part(self, texts: list[str]) -> list[bytes]:
        if self._byte:
            joined = (_MARK + f" {_MARK}".join(texts)).replace("\n", " \n")
        else:
            joined = f"{_MARK} " + f" {_MARK} ".join(texts).replace("\n", " ")
        found = pc.split_pattern(pa.array([joined]), " ").values.dictionary_encode()
        codes, words = found.indices.to_numpy(), found.dictionary
        ids = self._ids_of(words, codes)
        at, raw = ids.offsets.to_numpy().astype(np.int64), ids.flatten().to_numpy().tobytes()
        firsts = pc.starts_with(words, _MARK).to_numpy(zero_copy_only=False)[codes]
        bounds = (4 * (at[:-1][firsts] - at[0])).tolist() + [len(raw)]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _ids_of(self, words: pa.Array, codes: np.ndarray) -> pa.ListArray:
        at = self._places(words)
        ids = self._ids.take(pa.array(at[codes]))
        if len(self._words) > self._limit:
            self._forget()
        return ids

    def _plain(self, text: str) -> str | None:
        """What can be cut into words here: only single spaces and line feeds between them. None: the library gets the text."""
        if any(c in text for c in self._added):
            return None
        if self._byte:  # none at the ends, either
            odd = _ASCII_ODD if text.isascii() else _ODD
            return None if text[0] in " \n" or text[-1] in " \n" or any(c in text for c in odd) else text
        if any(c in text for c in _NOT_SPACE):
            return None
        return " ".join(text.split()) if any(c in text for c in "\t\r\x0b\x0c") or not text.isascii() and any(c in text for c in _WIDE) else text

    def ids(self, texts: list[str]) -> list[bytes]:
        out, held, size = [b""] * len(texts), {}, 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if (plain := self._plain(text)) is None:
                out[i] = self._whole(text)
                continue
            held[i] = plain
            size += len(plain)
            if size >= _PART or i == len(texts) - 1:
                for at, ids in zip(held, self._part(list(held.values()))):
                    out[at] = ids
                held, size = {}, 0
        if held:
            for at, ids in zip(held, self._part(list(held.values()))):
                out[at] = ids
        return out


def word_cache(path: str, kind: str, limit: int = 600_000) -> WordCache:
    """One for each Python worker, kept from task to task, with the limit that it was first asked for."""
    if (path, kind) not in _HELD:
        _HELD[path, kind] = WordCache(path, kind, limit)
    return _HELD[path, kind]
