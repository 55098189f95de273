"""Vectorised text work on Arrow string columns.

A column becomes one byte buffer in which every text is followed by a line feed, so that
words, lines and hashes of thousands of texts come from a few numpy passes instead of a
Python loop over words.  Words are runs of bytes other than space and 0x09-0x0D; a word's
hash covers its length and all its bytes (64 bits, equal words only collide by chance).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)
#: Bytes of text worked on at once; bounds the memory of a Python worker.
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> S30)
    x *= C2
    x ^= x >> S27
    x *= C3
    x ^= x >> S31
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(mix(a * C1 + C2) + b)


def binary_list(column) -> list[bytes]:
    """The column's texts as UTF-8; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text is a range of its own."""
    begin = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(x) + 1
    if begin < len(texts):
        yield begin, len(texts)


class Flat:
    """Texts laid end to end, each followed by a line feed, then 8 zero bytes.

    ``bounds[i]:bounds[i + 1] - 1`` is text i.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.n = len(texts)
        self.bounds = np.zeros(self.n + 1, np.int64)
        np.cumsum([len(x) + 1 for x in texts], out=self.bounds[1:])
        raw = b"\n".join(texts) + b"\n" * bool(texts) + b"\0" * 8
        self.raw = raw.lower() if lower else raw  # of bytes: A-Z only
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self._wide = np.ndarray((len(raw) - 7,), "<u8", self.raw, 0, (1,))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each word."""
        b = self.bytes[:-8]
        word = ((b - np.uint8(9)) > 4) & (b != 32)
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(b) and word[0]:
            edge = np.concatenate([[0], edge])
        return edge[0::2], edge[1::2]

    def subwords(self) -> tuple[np.ndarray, np.ndarray]:
        """Words, cut where letters and digits meet other ASCII characters; 16 punctuation bytes at most together."""
        b = self.bytes[:-8]
        kind = _KIND[b]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        if not len(b):
            return edge, edge
        begins = np.concatenate([[0], edge])
        ends = np.concatenate([edge, [len(b)]])
        keep = kind[begins] > 0
        return begins[keep], ends[keep]

    def docs(self, begins: np.ndarray) -> np.ndarray:
        """The text that each position lies in."""
        per = np.diff(np.searchsorted(begins, self.bounds))
        return np.repeat(np.arange(self.n), per)

    def hashes(self, begins: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hashes of byte ranges, eight bytes at a time."""
        with np.errstate(over="ignore"):
            size = ends - begins
            h = (size.astype(np.uint64) + np.uint64(seed * 2 + 1)) * C1
            if not len(size):
                return h
            live, at, left = None, begins, size
            while True:
                part = self._wide[at]
                short = left < 8
                keep = np.where(short, left, 8).astype(np.uint64) * np.uint64(8)
                part = np.where(short, part & ((np.uint64(1) << (keep % np.uint64(64))) - np.uint64(1)), part)
                if live is None:
                    h = mix(h ^ part)
                else:
                    h[live] = mix(h[live] * C1 + part)
                more = np.flatnonzero(left > 8)
                if not len(more):
                    return h
                live = more if live is None else live[more]
                at, left = at[more] + 8, left[more] - 8

    def points(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code points in each byte range."""
        lead = (self.bytes[:-8] & 0xC0) != 0x80
        total = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
        return total[ends] - total[begins]


#: 0 white space, 1 letters, digits and all bytes over 127, 2 other ASCII characters.
_KIND = np.full(256, 2, np.uint8)
_KIND[128:] = 1
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _KIND[_a:_b] = 1
_KIND[9:14] = 0
_KIND[32] = 0


def per_doc(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Sum of values by text, in double precision."""
    return np.bincount(docs, weights=values, minlength=n) if len(docs) else np.zeros(n)


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(begin, begin + size)``."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(begins - (ends - sizes), sizes)


def shingles(h: np.ndarray, docs: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word windows by text, as (hashes, offsets by text), each text's in ascending order.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    with np.errstate(over="ignore"):
        per = np.bincount(docs, minlength=n) if len(docs) else np.zeros(n, np.int64)
        first = np.cumsum(per) - per
        out, who = [], []
        if len(h) >= k:
            x = h[: len(h) - k + 1]
            for j in range(1, k):
                x = combine(x, h[j : len(h) - k + 1 + j])
            ok = docs[: len(x)] == docs[k - 1 :]
            out.append(x[ok])
            who.append(docs[: len(x)][ok])
        for size in range(1, k):
            few = np.flatnonzero(per == size)
            if len(few):
                x = h[first[few]]
                for j in range(1, size):
                    x = combine(x, h[first[few] + j])
                out.append(mix(x + np.uint64(size)))
                who.append(few)
        if not out:
            return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
        x, d = np.concatenate(out), np.concatenate(who)
        order = np.lexsort((x, d))
        x, d = x[order], d[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
        x, d = x[new], d[new]
        return x, np.searchsorted(d, np.arange(n + 1))


def tokens(texts: list[bytes], lower: bool = True, seed: int = 0) -> tuple[np.ndarray, np.ndarray, Flat]:
    """Word hashes and the text of each word."""
    flat = Flat(texts, lower)
    a, b = flat.words()
    return flat.hashes(a, b, seed), flat.docs(a), flat
