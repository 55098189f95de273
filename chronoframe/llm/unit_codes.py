"""Token ids of texts by way of their distinct units.

A unit is a stretch that a tokenizer's own splitting never joins with its neighbours, so the ids of a
text are those of its units in turn.  Each distinct unit is encoded once, by the tokenizers library;
all the rest is numpy.  Units already seen are kept in a bounded cache that only saves work.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np

from chronoframe.llm.kernel import Flat, ragged

CACHED_UNITS, CACHED_PIECES = 800_000, 300_000
#: White space outside ASCII, in UTF-8: fixed values of the Unicode property White_Space.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Texts whose splitting into pieces is done here; others go to the library whole.
PLAIN = re.compile("[ !-~\u00c0-\u00ff]+")


def byte_names() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown}
    return names | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in names)}


BYTE_NAMES = byte_names()
SPACE = BYTE_NAMES[32]


def load(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


class UnitCodes:
    """Encodes lists of texts; subclasses say what the units are."""

    lower = False
    split: re.Pattern  # how the vocabulary cuts PLAIN units into the pieces that are merged one by one

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[str, tuple] = {}
        self.keys, self.first, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def units(self, flat: Flat) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def whole(self, text: bytes) -> bool:
        """Whether the text has no such units and must be encoded in one piece."""
        return False

    def direct(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _encode_units(self, units: list[bytes]) -> list:
        out: list = [None] * len(units)
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        pieces, split, known = self.pieces, self.split.findall, PLAIN.fullmatch
        for i, unit in enumerate(units):
            text = unit.decode("utf-8", "replace")
            if not known(text):
                continue
            ids: tuple = ()
            for piece in split(text.lower() if self.lower else text):
                got = pieces.get(piece)
                if got is None:
                    mapped = piece.replace(" ", SPACE) if piece.isascii() else piece.encode().decode("latin1").translate(BYTE_NAMES)
                    got = pieces[piece] = tuple([x.id for x in self.model.tokenize(mapped)])
                ids += got
            out[i] = ids
        rest = [i for i in range(len(units)) if out[i] is None]
        for i, ids in zip(rest, self.direct([units[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn, and how many each text has."""
        odd = [i for i, t in enumerate(texts) if self.whole(t)]
        if odd:
            parts = dict(zip(odd, self.direct([texts[i] for i in odd]), strict=True))
            plain = [b"" if i in parts else t for i, t in enumerate(texts)]
            ids, n = self.encode(plain)
            pieces = np.split(ids, np.cumsum(n)[:-1])
            pieces = [parts.get(i, x) for i, x in enumerate(pieces)]
            return np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)
        flat = Flat(texts, self.lower)
        a, b = self.units(flat)
        if not len(a):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        h = flat.hashes(a, b)
        order = np.argsort(h)
        new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
        distinct, at = h[order[new]], order[new]
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        if len(self.keys) > CACHED_UNITS:
            self.clear()
        k = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = k < len(self.keys)
        known[inside] = self.keys[k[inside]] == distinct[inside]
        miss = np.flatnonzero(~known)
        if len(miss):
            raw = flat.raw
            got = self._encode_units([raw[x:y] for x, y in zip(a[at[miss]].tolist(), b[at[miss]].tolist(), strict=True)])
            size = np.array([len(x) for x in got], np.int64)
            first = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))])
            keys = np.concatenate([self.keys, distinct[miss]])
            by = np.argsort(keys)
            self.keys, self.first, self.size = keys[by], np.concatenate([self.first, first])[by], np.concatenate([self.size, size])[by]
            k = np.searchsorted(self.keys, distinct)
        size = self.size[k][place]
        ids = self.pool[ragged(self.first[k][place], size)]
        return ids, np.bincount(flat.docs(a), weights=size, minlength=len(texts)).astype(np.int64)


class WordCodes(UnitCodes):
    """For vocabularies of words with end marks, where white space only separates: units are words."""

    lower = True  # the tokenizer lower-cases anyway
    split = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^ a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

    def units(self, flat: Flat) -> tuple[np.ndarray, np.ndarray]:
        return flat.words()


class ByteCodes(UnitCodes):
    """For byte-level vocabularies: units are words with the one space before them, and the white space between.

    In white space of k characters before a word, the splitting pattern takes the first k - 1 together and
    leaves the last one to the word if it is a space, or alone; at a text's end it takes all k.
    Texts with white space outside ASCII are encoded in one piece.
    """

    split = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+| ?[0-9]+| ?[^ a-zA-Z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+| +")

    def units(self, flat: Flat) -> tuple[np.ndarray, np.ndarray]:
        a, b = flat.words()
        raw = flat.bytes
        first = np.zeros(len(a), bool)
        first[np.unique(np.searchsorted(a, flat.bounds[:-1]).clip(0, max(0, len(a) - 1)))] = True
        joined = (a > 0) & (raw[a - 1] == 32)  # a text begins after a line feed
        begin = a - joined
        prev = np.concatenate([[0], b[:-1]]) if len(b) else b
        # before the first word of a text, white space begins where the text does
        d = flat.docs(a)
        prev = np.where(np.concatenate([[True], d[1:] != d[:-1]]) if len(d) else first, flat.bounds[d], prev)
        gap = begin - prev
        lone = (gap > 0) & ~joined  # the last of them stands alone
        head = gap - lone
        some = head > 0
        # after the last word, all the rest; texts without words are all white space
        last_end = flat.bounds[:-1].copy()
        if len(d):
            np.maximum.at(last_end, d, b)
        tail = flat.bounds[1:] - 1 - last_end
        t = tail > 0
        lo = np.concatenate([begin, prev[some], begin[lone] - 1, last_end[t]])
        hi = np.concatenate([b, (prev + head)[some], begin[lone], (last_end + tail)[t]])
        order = np.argsort(lo, kind="stable")
        return lo[order], hi[order]

    def whole(self, text: bytes) -> bool:
        return not text.isascii() and WIDE_SPACE.search(text) is not None


@lru_cache(2)
def encoder(kind: type[UnitCodes], path: str) -> UnitCodes:
    """One for each Python worker, kept from task to task."""
    return kind(path)
