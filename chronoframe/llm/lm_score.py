"""LM scoring by a hierarchical Pitman-Yor model.

Every token is a customer of the restaurant of its context, the whole token before it or the text's start.  All
contexts share one parent, the unigram restaurant, whose customers are their tables and whose dishes come from a base
over the V training types and one unknown type.  Seating is sampled by Gibbs on the present seating (``seating``): in
each round every customer of every context is taken out and seated again, then the unigram restaurant gets the
customers that have come or gone.  The first of BURN rounds seats everybody, and in those rounds the unigram
restaurant reseats all of its own customers too; each of SAMPLES rounds after them is a sample.  Each restaurant's
predictive probabilities are averaged over the samples.

Layout: tokens are dealt by a hash of the pair (word before, word), so a frequent word or context is spread over all
buckets.  Chunks of documents send each bucket one compressed block of their tokens; cells and scores both come
from these blocks.  What a context or a word has in all buckets together is summed at its home, a bucket given by its
hash, which also has the word's seating in the unigram restaurant: in each round every bucket sends each home one block
of sums and gets one back.  Inside a bucket a round sees every change at once; changes of other buckets are seen in the
next round, as in distributed Gibbs sampling of topic models (Newman et al., 2009).  Only sums of whole counts go to the
driver.  Nothing else is bounded: counts cover all training documents, and grow with them.

Null and empty texts are one token, the end.  Rows of equal doc_id are scored one by one; a null doc_id is learnt from.
An empty table gives no rows.  Words are known by 56 bits of their hash.
"""

from __future__ import annotations

import contextlib
import ctypes
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.kernel import C1, C2, Flat, binary_list, mix, ragged, slices
from chronoframe.llm.seating import Seats
from chronoframe.llm.storage import LARGE_VALUES, delete, dropped, new_path, small_batches, written

#: A key is the upper 56 bits of a word's hash; 0 is a text's start.
CUT = np.uint64(8)
START, END = np.uint64(0), np.uint64(0xE0D0E0D0E0D0E0)
BURN, SAMPLES = 1, 3
STRENGTH = 1.0
#: Bytes of text that are taken in at a time, and of a chunk.
PART_BYTES, CHUNK_BYTES, CHUNK_DOCS = 8 << 20, 24 << 20, 60_000
#: Bytes of text of a bucket.
BUCKET_BYTES = 16 << 20
#: Tokens that are looked up at a time.
SLICE = 1 << 19
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PARTITIONS, BATCH, READ = "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
#: Kinds of rows: what a bucket and a home always keep, what they keep for the next round, and what they send.
TEXT, IDS, CELLS, HOME, KEYS, SEATS, ROOTS, UP, DOWN = range(9)
ROW = "bucket int, kind int, frm long, block binary, sums array<double>"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block."""
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *(np.ascontiguousarray(a).data for a in arrays)]))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + 10 * n, []
    for k in range(n):
        kind, size = struct.unpack_from("<2sQ", raw, 4 + 10 * k)
        t = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(raw, t, size, at))
        at += size * t.itemsize
    return out


def planes(x: np.ndarray) -> np.ndarray:
    """First bytes of all values, then second ones, and so on: what is alike in them packs well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.ravel()


def of_planes(x: np.ndarray, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    out = np.empty((len(x) // width, width), np.uint8)
    for k, plane in enumerate(x.reshape(width, -1)):  # a plane at a time: numpy would go value by value
        out[:, k] = plane
    return out.ravel().view(kind)


def steps(x: np.ndarray) -> np.ndarray:
    """Ascending 64-bit values by their differences."""
    return planes(np.diff(x, prepend=x.dtype.type(0)).astype("<u8"))


def of_steps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(of_planes(x, "<u8"), dtype=np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Ascending distinct values; ``np.unique`` hashes them first, which takes ten times as long."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``np.searchsorted``, in ascending order, so that neighbouring keys are in the cache."""
    out = np.empty(len(x), np.int64)
    order = np.argsort(x)
    out[order] = np.searchsorted(keys, x[order])
    return out


def index_kind(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def counts(x: np.ndarray) -> np.ndarray:
    """Whole numbers as planes of the bytes that they need, after how many those are."""
    top = int(x.max()) if len(x) else 0
    width = next(k for k in (1, 2, 4, 8) if top >> 8 * k == 0)
    return np.concatenate([np.array([width], np.uint8), planes(x.astype(f"<u{width}"))])


def of_counts(x: np.ndarray) -> np.ndarray:
    return of_planes(x[1:], f"<u{x[0]}").astype(np.int64)


@lru_cache(1)
def thrifty() -> None:
    """From now on this process's large arrays are mapped one by one, so that what is freed goes back to the system at once."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        # M_TRIM_THRESHOLD: else 128 kB free at the end of the heap go back, and small arrays' pages come anew each time
        ctypes.CDLL(None).mallopt(-1, 32 << 20)


def give_back() -> None:
    """Free memory that Arrow and the C library keep for later goes back to the system."""
    thrifty()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def home(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that sums up each key."""
    return (mix(keys) % np.uint64(buckets)).astype(np.int64)


def dealt(keys: np.ndarray, buckets: int) -> list[np.ndarray]:
    """The places of the keys of each home, ascending."""
    to = home(keys, buckets).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # short numbers are sorted by radix
    order = np.argsort(to, kind="stable")
    return np.split(order, np.searchsorted(to[order], np.arange(1, buckets)))


def held_out(doc_id: int | None, folds: int = 5, fold: int = 1) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all tokens, each text's end among them, and how many each text has."""
    flat = Flat(texts, lower=True)
    a, b = flat.words()
    d = flat.docs(a)
    per = np.bincount(d, minlength=len(texts))
    out = np.full(len(a) + len(texts), END)
    # token j of text i stands at j + i, its end after its last one
    out[np.arange(len(a)) + d] = np.maximum(flat.hashes(a, b) >> CUT, np.uint64(1))
    return out, per + 1


class Part(NamedTuple):
    """Tokens in turn, as places in ascending keys."""

    types: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(keys: np.ndarray) -> Part:
        types, at = np.unique(keys, return_inverse=True)
        return Part(types, at.astype(np.uint32))


def blocks_of(parts: list[Part], per: np.ndarray, held: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """The tokens of each bucket: keys, by token the place of its context and its word, tokens by text, and the held-out texts.

    Keys stand in classes of falling frequency and ascend in each, so that both they and the places pack well.
    """
    types = distinct(np.concatenate([[START], *(p.types for p in parts)]))
    at = np.concatenate([np.searchsorted(types, p.types).astype(np.uint32)[p.at] for p in parts])
    parts.clear()
    rarity = 64 - np.frexp(np.bincount(at, minlength=len(types)))[1]
    order = np.argsort(rarity.astype(np.uint8), kind="stable")
    place = np.empty(len(types), np.uint32)
    place[order] = np.arange(len(types), dtype=np.uint32)
    types, at = types[order], place[at]
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[np.cumsum(per) - per] = place[0]  # the start's key is the smallest
    bucket = np.empty(len(at), np.uint16 if buckets <= 1 << 16 else np.uint32)
    with np.errstate(over="ignore"):
        half = mix(types * C1 + C2)
        for k in range(0, len(at), 1 << 19):  # as ``combine`` of both keys
            some = slice(k, k + (1 << 19))
            bucket[some] = mix(half[before[some]] + types[at[some]]) % np.uint64(buckets)
    del half
    order = np.argsort(bucket, kind="stable").astype(np.uint32)
    n = np.bincount(bucket, minlength=buckets)
    del bucket
    text = np.repeat(np.arange(len(per), dtype=np.uint32), per)
    mark = np.zeros(len(types), bool)
    flags, stop = np.packbits(held), np.cumsum(n)
    for k in np.flatnonzero(n).tolist():
        mine = order[stop[k] - n[k] : stop[k]]
        u, w = before[mine].astype(np.int64), at[mine].astype(np.int64)
        mark[u] = mark[w] = True
        found = np.flatnonzero(mark)
        mark[found] = False
        place[found] = np.arange(len(found), dtype=np.uint32)
        kind = index_kind(len(found))
        yield k, pack(steps(types[found]), planes(place[u].astype(kind)), planes(place[w].astype(kind)), planes(np.bincount(text[mine], minlength=len(per)).astype("<u4")), flags)


def tokens_of(blob: bytes) -> tuple[np.ndarray, ...]:
    """Keys, by token the place of its context and of its word, tokens by text, and whether each text is held out."""
    types, iu, iw, per, flags = unpack(blob)
    types, per = of_steps(types), of_planes(per, "<u4").astype(np.int64)
    kind = index_kind(len(types))
    return types, of_planes(iu, kind), of_planes(iw, kind), per, np.unpackbits(flags, count=len(per)).astype(bool)


def places_in(keys: np.ndarray, types: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of types[at] in ascending keys, which hold them all."""
    there = np.zeros(len(types), bool)
    there[at] = True
    out = np.zeros(len(types), np.int64)
    out[there] = find(keys, types[there])
    return out[at]


def merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and their sums."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


class Cells(NamedTuple):
    """A bucket's contexts and words, and its training cells by ascending (context, word), with their customers."""

    u: np.ndarray
    w: np.ndarray
    iu: np.ndarray
    iw: np.ndarray
    c: np.ndarray

    def pack(self) -> bytes:
        return pack(steps(self.u), steps(self.w), planes(np.bincount(self.iu, minlength=len(self.u)).astype("<u4")), planes(self.iw.astype("<u4")), counts(self.c))

    @staticmethod
    def of(blob: bytes) -> Cells:
        u, w, per, iw, c = unpack(blob)
        u = of_steps(u)
        return Cells(u, of_steps(w), np.repeat(np.arange(len(u)), of_planes(per, "<u4")), of_planes(iw, "<u4").astype(np.int64), of_counts(c))


def cells_of(blobs: list[bytes]) -> Cells:
    us, ws, train = [], [], []
    for blob in blobs:
        types, iu, iw, per, held = tokens_of(blob)
        for found, at in ((us, iu), (ws, iw)):
            there = np.zeros(len(types), bool)
            there[at] = True
            found.append(types[there])
        keep = np.repeat(~held, per)
        train.append((types, iu[keep], iw[keep]))
    u, w = distinct(np.concatenate(us)), distinct(np.concatenate(ws))
    del us, ws
    key, end = np.empty(sum(len(x[1]) for x in train), np.int64), 0
    while train:
        types, iu, iw = train.pop()
        begin, end = end, end + len(iu)
        key[begin:end] = places_in(u, types, iu) * len(w) + places_in(w, types, iw)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    c = np.diff(np.append(first, len(key)))
    key = key[first]
    return Cells(u, w, key // len(w), key % len(w), c)


def key_blocks(x: Cells, buckets: int) -> Iterator[tuple[int, bytes]]:
    """For each home its contexts and words among the bucket's, with their customers and cells (a table each, at first)."""
    nu, nw = len(x.u), len(x.w)
    cu, cw = (np.bincount(i, weights=x.c, minlength=n) for i, n in ((x.iu, nu), (x.iw, nw)))
    tu, tw = np.bincount(x.iu, minlength=nu), np.bincount(x.iw, minlength=nw)
    for k, (i, j) in enumerate(zip(dealt(x.u, buckets), dealt(x.w, buckets), strict=True)):
        if len(i) or len(j):
            yield k, pack(steps(x.u[i]), counts(cu[i]), steps(x.w[j]), counts(cw[j]), counts(tu[i]), counts(tw[j]))


class Home(NamedTuple):
    """Customers of the contexts and words whose home it is, and which of them each bucket has."""

    cu: np.ndarray
    cw: np.ndarray
    of: dict[int, tuple[np.ndarray, np.ndarray]]

    def pack(self) -> bytes:
        names = sorted(self.of)
        return pack(counts(self.cu), counts(self.cw), np.array(names, "<i8"), *(steps(x.astype(np.uint64)) for k in names for x in self.of[k]))

    @staticmethod
    def read(blob: bytes) -> Home:
        cu, cw, names, *lists = unpack(blob)
        lists = [of_steps(x).astype(np.int64) for x in lists]
        return Home(of_counts(cu), of_counts(cw), {k: (i, j) for k, i, j in zip(names.tolist(), lists[::2], lists[1::2], strict=True)})


def home_of(blobs: dict[int, bytes]) -> tuple[Home, list[float]]:
    """A home from the key blocks of all buckets; and types, tokens, types of one token, cells, types of one and of two cells."""
    raw = {k: unpack(x) for k, x in blobs.items()}
    (u, cu), (w, cw) = (merged(np.concatenate([of_steps(x[i]) for x in raw.values()]), np.concatenate([of_counts(x[i + 1]) for x in raw.values()])) for i in (0, 2))
    made = Home(cu, cw, {k: (np.searchsorted(u, of_steps(x[0])), np.searchsorted(w, of_steps(x[2]))) for k, x in raw.items()})
    n = np.zeros(len(w), np.int64)
    for k, x in raw.items():
        n[made.of[k][1]] += of_counts(x[5])
    return made, [float(v) for v in ((cw > 0).sum(), cw.sum(), (cw == 1).sum(), n.sum(), (n == 1).sum(), (n == 2).sum())]


class Model(NamedTuple):
    """What all buckets share: discounts of the contexts and of the unigrams, base probabilities, and this round's totals of tables."""

    d1: float
    d0: float
    known: float
    unknown: float
    types: float
    tokens: float
    tables: float
    roots: float


def discount(one: float, two: float) -> float:
    """By n1 / (n1 + 2 n2)."""
    return min(0.95, max(0.05, one / max(1.0, one + 2 * two)))


def model_of(types: float, tokens: float, once: float, cells: float, roots1: float, roots2: float, cells1: float, cells2: float) -> Model:
    """The model before the first round, when each cell has one table.

    The unknown type's base probability is what makes its overall probability the share of tokens seen once
    (Good-Turing), as far as a base can give it.
    """
    d1, d0 = discount(cells1, cells2), discount(roots1, roots2)
    escape = (STRENGTH + d1 * cells) / (STRENGTH + tokens) * (STRENGTH + d0 * types) / (STRENGTH + cells)
    unknown = min(0.95, max(1.0 / (types + 1), (once / max(1.0, tokens)) / max(escape, 1e-12)))
    return Model(d1, d0, (1 - unknown) / max(1.0, types), unknown, types, tokens, cells, types)


def root_share(m: Model) -> float:
    """The unigram restaurant's weight for its base."""
    return (STRENGTH + m.d0 * m.roots) / (STRENGTH + m.tables)


def home_round(x: Home, roots: bytes | None, ups: dict[int, bytes], m: Model, seed: list[int], sweep: bool, keep: bool, last: bool) -> tuple[bytes, dict[int, bytes], list[float]]:
    """The unigram restaurant's words of this home after the buckets' round: its seating, what each bucket is told, its tables.

    With ``sweep`` all customers are reseated, not only those that come; with ``keep`` the round is a sample; with
    ``last`` buckets are told the sums over the samples.
    """
    tu, c = np.zeros(len(x.cu), np.int64), np.zeros(len(x.cw), np.int64)
    for k, blob in ups.items():
        *_, pu, pw = unpack(blob)
        i, j = x.of[k]
        tu[i] += of_counts(pu)
        c[j] += of_counts(pw)
    if roots is None:  # the model counts a table for each type
        had, z, sum_t, sum_p, before = np.zeros(len(c), np.int64), np.zeros(0, np.int64), np.zeros(len(tu), np.int64), np.zeros(len(c)), (x.cw > 0).sum()
    else:
        had, z, sum_t, sum_p, before = unpack(roots)
        had, z, sum_t, sum_p, before = of_counts(had), of_planes(z, "<u4").astype(np.int64), of_counts(sum_t), of_planes(sum_p, "<f8"), before.sum()
    stay = np.minimum(had, c)
    off = np.cumsum(had) - had
    fewer = np.flatnonzero(stay < had)
    if len(fewer):  # customers of a word are alike, so any of them go
        at = ragged(off[fewer], had[fewer])
        who = np.repeat(fewer, had[fewer])
        rank = np.argsort(who + np.random.default_rng([*seed, 1]).random(len(at)))
        z[at] = z[at[rank]]
    z = z[ragged(off, stay)]
    tables = np.array([float(m.roots - before)])
    seats = Seats(c, stay, z, m.d0, STRENGTH, np.zeros(len(c), np.int64), tables, np.arange(len(c)), c.astype(float), lambda col, above: np.full(len(col), m.known), seed)
    tables += seats.used.sum()
    seats.come()
    if sweep:
        seats.sweep()
    t = seats.used
    if keep:
        sum_t = sum_t + tu
        sum_p = sum_p + (c - m.d0 * t) / (STRENGTH + m.tables)
    state = pack(counts(c), planes(seats.z.astype("<u4")), counts(sum_t), planes(sum_p.astype("<f8")), np.array([t.sum()], "<i8"))
    downs = {}
    for k, (i, j) in x.of.items():
        downs[k] = pack(counts(x.cu[i]), counts(sum_t[i]), counts(x.cw[j]), planes(sum_p[j].astype("<f8"))) if last else pack(counts(tu[i]), counts(c[j]), counts(t[j]))
    return state, downs, [float(t.sum())]


def leaf_round(x: Cells, seats: bytes | None, downs: dict[int, bytes], m: Model, seed: list[int], buckets: int, keep: bool) -> tuple[bytes, dict[int, bytes], list[float]]:
    """A round over a bucket's contexts: their seating, what each home is told, their tables."""
    tables, above, roots = np.zeros(len(x.u)), np.zeros(len(x.w)), np.zeros(len(x.w))
    ours = list(zip(dealt(x.u, buckets), dealt(x.w, buckets), strict=True))
    for k, blob in downs.items():
        tu, c, t = map(of_counts, unpack(blob))
        i, j = ours[k]
        tables[i], above[j], roots[j] = tu, c, t
    rest, over = (STRENGTH + m.d0 * m.roots) * m.known, STRENGTH + m.tables

    def parent(col: np.ndarray, customers: np.ndarray) -> np.ndarray:
        return (customers - m.d0 * np.minimum(roots[col], customers) + rest) / over

    some = np.flatnonzero(x.c > 1)  # a cell's only customer always has the one table
    if seats is None:
        z, have, total = np.zeros(0, np.int64), np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
        # until they come in, these cells have no tables
        np.subtract.at(tables, x.iu[some], 1)
        np.subtract.at(above, x.iw[some], 1)
    else:
        z, total = unpack(seats)
        z, have, total = of_planes(z, "<u4").astype(np.int64), x.c[some], of_counts(total)
    s = Seats(x.c[some], have, z, m.d1, STRENGTH, x.iu[some], tables, x.iw[some], above, parent, seed)
    s.come() if seats is None else s.sweep()
    t = np.ones(len(x.c), np.int64)
    t[some] = s.used
    if keep:
        total = total + t[some]
    tu, tw = np.bincount(x.iu, weights=t, minlength=len(x.u)), np.bincount(x.iw, weights=t, minlength=len(x.w))
    ups = {k: pack(counts(tu[i]), counts(tw[j])) for k, (i, j) in enumerate(ours) if len(i) or len(j)}
    return pack(planes(s.z.astype("<u4")), counts(total)), ups, [float(t.sum())]


class Scorer:
    """Scores the tokens of a bucket; ``drawn`` are the models of the sampled rounds."""

    def __init__(self, x: Cells, seats: bytes, downs: dict[int, bytes], drawn: list[Model], buckets: int):
        m = drawn[0]
        n = len(drawn)
        cu, sum_t, cw, sum_p = np.zeros(len(x.u)), np.zeros(len(x.u)), np.zeros(len(x.w)), np.zeros(len(x.w))
        ours = list(zip(dealt(x.u, buckets), dealt(x.w, buckets), strict=True))
        for k, blob in downs.items():
            a, b, c, d = unpack(blob)
            i, j = ours[k]
            cu[i], sum_t[i], cw[j], sum_p[j] = of_counts(a), of_counts(b), of_counts(c), of_planes(d, "<f8")
        share = float(np.mean([root_share(y) for y in drawn]))
        self.x, self.known = x, cw > 0
        self.word = np.where(self.known, sum_p / n + share * m.known, share * m.unknown)
        self.back = (STRENGTH + m.d1 * sum_t / n) / (STRENGTH + cu)
        t = np.ones(len(x.c))
        t[x.c > 1] = of_counts(unpack(seats)[1]) / n
        self.cell = x.iu * max(1, len(x.w)) + x.iw
        self.own = (x.c - m.d1 * t) / (STRENGTH + cu[x.iu])
        self.base = np.log10(cw + 0.5) - np.log10(m.tokens + 0.5 * (m.types + 1))

    def texts(self, blob: bytes) -> bytes:
        """By text of a block: log10 probability and base of its tokens here, and how many are known."""
        types, iu, iw, per, _ = tokens_of(blob)
        u, w = places_in(self.x.u, types, iu), places_in(self.x.w, types, iw)
        p = self.back[u] * self.word[w]
        if len(self.cell):
            key = u * max(1, len(self.x.w)) + w
            for k in range(0, len(key), SLICE):
                order = np.argsort(key[k : k + SLICE])  # ascending, so that neighbouring cells are in the cache
                some = key[k : k + SLICE][order]
                at = np.minimum(np.searchsorted(self.cell, some), len(self.cell) - 1)
                hit = np.flatnonzero(self.cell[at] == some)
                p[k + order[hit]] += self.own[at[hit]]
        text = np.repeat(np.arange(len(per)), per)
        score, base, known = (np.bincount(text, weights=y, minlength=len(per)) for y in (np.log10(p), self.base[w], self.known[w]))
        some = np.flatnonzero(per)
        return pack(planes(np.diff(some, prepend=0).astype("<u4")), planes(score[some].astype("<f8")), planes(base[some].astype("<f8")), planes(known[some].astype("<u4")))


def rows_of(rows: Iterable[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.float64())), strict=True)], names=["bucket", "kind", "frm", "block", "sums"])


def of_kind(table: pa.Table, kind: int) -> dict[int, bytes]:
    """Blocks of the kind by where they come from."""
    return {f: b.as_py() for k, f, b in zip(table.column("kind").to_pylist(), table.column("frm").to_pylist(), table.column("block"), strict=True) if k == kind}


def bucket_of(*tables: pa.Table) -> int:
    return next(t.column("bucket")[0].as_py() for t in tables if t.num_rows)


def blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of TEXT, a chunk's tokens in each bucket, and of IDS, its doc_ids and their tokens."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        chunk, parts, keys, ids, per, size, fresh = TaskContext.get().partitionId() << 32, [], [], [], [], 0, 0

        def taken_in() -> None:
            parts.append(Part.of(np.concatenate(keys)))
            keys.clear()

        def close() -> Iterator[pa.RecordBatch]:
            if keys:
                taken_in()
            held = np.array([held_out(i) for i in ids], bool)
            n = np.concatenate(per)
            raw = pack(np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], "<u1"), n.astype("<u4"))
            yield from rows_of([(chunk % buckets, IDS, chunk, raw, None)]).to_batches()
            for bucket, blob in blocks_of(parts, n, held, buckets):
                yield from rows_of([(bucket, TEXT, chunk, blob, None)]).to_batches()
            give_back()

        for batch in batches:
            texts, names = binary_list(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in slices(texts):
                x, n = stream(texts[a:b])
                keys.append(x)
                per.append(n)
                ids += names[a:b]
                size, fresh = size + sum(map(len, texts[a:b])), fresh + sum(map(len, texts[a:b]))
                if fresh > PART_BYTES:
                    taken_in()
                    fresh = 0
                if size > CHUNK_BYTES or len(ids) > CHUNK_DOCS:
                    yield from close()
                    chunk, ids, per, size, fresh = chunk + 1, [], [], 0, 0
        if ids:
            yield from close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROW)


def counted(table: DataFrame) -> DataFrame:
    """Rows of CELLS."""

    def run(group: pa.Table) -> pa.Table:
        own = bucket_of(group)
        give_back()
        x = cells_of(list(of_kind(group, TEXT).values()))
        give_back()
        return rows_of([(own, CELLS, own, x.pack(), [float((x.c == 1).sum()), float((x.c == 2).sum())])])

    return table.where(F.col("kind") == TEXT).groupBy("bucket").applyInArrow(run, ROW)


def named(table: DataFrame, buckets: int) -> DataFrame:
    """Rows of KEYS for each home, from those of CELLS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, blob in zip(batch.column("bucket").to_pylist(), batch.column("block"), strict=True):
                yield from rows_of((k, KEYS, own, x, None) for k, x in key_blocks(Cells.of(blob.as_py()), buckets)).to_batches()

    return table.where(F.col("kind") == CELLS).select("bucket", "block").mapInArrow(run, ROW)


def homes(keys: DataFrame) -> DataFrame:
    """Rows of HOME from those of KEYS."""

    def run(group: pa.Table) -> pa.Table:
        own = bucket_of(group)
        give_back()
        x, sums = home_of(of_kind(group, KEYS))
        return rows_of([(own, HOME, own, x.pack(), sums)])

    return keys.groupBy("bucket").applyInArrow(run, ROW)


def summed(rows: DataFrame, kind: int, n: int) -> list[float]:
    """Sums over all buckets; they're of whole numbers, so their order doesn't matter."""
    found = rows.where(F.col("kind") == kind).agg(*(F.sum(F.col("sums")[k]) for k in range(n))).first()
    return [float(x or 0.0) for x in found]


def at_homes(table: DataFrame, flow: DataFrame, m: Model, seed: int, sweep: bool, keep: bool, last: bool) -> DataFrame:
    """ROOTS and DOWN rows from ROOTS and UP (at first KEYS) rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = bucket_of(left, right)
        give_back()
        x = Home.read(of_kind(left, HOME)[own])
        state, downs, sums = home_round(x, of_kind(right, ROOTS).get(own), of_kind(right, UP) or of_kind(right, KEYS), m, [seed, own], sweep, keep, last)
        give_back()
        return rows_of([(own, ROOTS, own, state, sums), *((k, DOWN, own, blob, None) for k, blob in downs.items())])

    return table.where(F.col("kind") == HOME).groupBy("bucket").cogroup(flow.where(F.col("kind").isin(ROOTS, UP, KEYS)).groupBy("bucket")).applyInArrow(run, ROW)


def at_cells(table: DataFrame, flow: DataFrame, m: Model, seed: int, buckets: int, keep: bool) -> DataFrame:
    """SEATS and UP rows from SEATS and DOWN rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = bucket_of(left, right)
        give_back()
        x = Cells.of(of_kind(left, CELLS)[own])
        state, ups, sums = leaf_round(x, of_kind(right, SEATS).get(own), of_kind(right, DOWN), m, [seed, own], buckets, keep)
        give_back()
        return rows_of([(own, SEATS, own, state, sums), *((k, UP, own, blob, None) for k, blob in ups.items())])

    return table.where(F.col("kind") == CELLS).groupBy("bucket").cogroup(flow.where(F.col("kind").isin(SEATS, DOWN)).groupBy("bucket")).applyInArrow(run, ROW)


def scored(table: DataFrame, flow: DataFrame, drawn: list[Model], buckets: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = bucket_of(left, right)
        give_back()
        kinds = left.column("kind").to_pylist()
        scorer = Scorer(Cells.of(left.column("block")[kinds.index(CELLS)].as_py()), of_kind(right, SEATS)[own], of_kind(right, DOWN), drawn, buckets)
        rows = [(own, TEXT, f, scorer.texts(b.as_py()), None) for k, f, b in zip(kinds, left.column("frm").to_pylist(), left.column("block"), strict=True) if k == TEXT]
        del scorer
        give_back()
        return rows_of(rows)

    read = table.where(F.col("kind").isin(TEXT, CELLS)).groupBy("bucket").cogroup(flow.where(F.col("kind").isin(SEATS, DOWN)).groupBy("bucket")).applyInArrow(run, ROW)
    parts = read.unionByName(table.where(F.col("kind") == IDS).select("bucket", "kind", "frm", "block", "sums")).select("frm", "kind", "bucket", "block")
    train = int(drawn[0].tokens)

    def gather(group: pa.Table) -> pa.Table:
        give_back()
        kinds, blobs, by = (group.column(c).to_pylist() for c in ("kind", "block", "bucket"))
        ids, there, n_tokens = unpack(blobs[kinds.index(IDS)])
        score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        # in the order of buckets, so that sums don't depend on how rows arrive
        for _, blob in sorted((b, x) for k, b, x in zip(kinds, by, blobs, strict=True) if k == TEXT):
            some, a, b, n = unpack(blob)
            some = np.cumsum(of_planes(some, "<u4"))
            score[some] += of_planes(a, "<f8")
            base[some] += of_planes(b, "<f8")
            known[some] += of_planes(n, "<u4")
        names = [i if ok else None for i, ok in zip(ids.tolist(), there.tolist(), strict=True)]
        cols = [names, [held_out(i) for i in names], n_tokens.astype(np.int64), known, np.full(len(ids), train), base, score]
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return parts.groupBy("frm").applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, burn: int = BURN, samples: int = SAMPLES) -> DataFrame:
    """Learns from the training folds of ``docs`` and scores all its documents.  Working tables are removed."""
    spark = docs.sparkSession
    # by the text, not the session's partitions, as every bucket sends every home a block
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    name = f"lm_blocks_{uuid.uuid4().hex}"
    path = new_path(spark, name)

    def add(rows: DataFrame, mode: str = "append") -> DataFrame:
        """Rows that stay, bucketed by bucket, so that later steps read them without a shuffle."""
        rows.write.format("parquet").options(**LARGE_VALUES).mode(mode).bucketBy(buckets, "bucket").option("path", path).saveAsTable(name)
        return spark.table(name)

    # shuffle files are as large as the tables made of them and aren't needed once those are written
    before = {k: spark.conf.get(k, default) for k, default in ((CLEANUP, "false"), (BATCH, "10000"), (READ, "4096"), (PARTITIONS, "200"))}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(PARTITIONS, str(buckets))  # so that what meets the bucketed table is dealt as it is
    try:
        table = add(blocks(docs, buckets).repartition(buckets, "bucket"), "overwrite")
        # blocks are large, and a batch of them is held twice
        spark.conf.set(BATCH, "4")
        spark.conf.set(READ, "16")
        table = add(counted(table))
        table = add(homes(named(table, buckets)))
        m = model_of(*summed(table, HOME, 6), *summed(table, CELLS, 2))
        up, drawn = named(table, buckets), []
        down = written(at_homes(table, up, m, 0, False, False, False), "lm-homes", **LARGE_VALUES)
        for k in range(1, 1 + burn + samples):
            m = m._replace(roots=summed(down, ROOTS, 1)[0])
            keep = k > burn
            seats = up.where(F.col("kind") == SEATS)
            last, up = up, written(at_cells(table, down.unionByName(seats), m, 2 * k, buckets, keep), "lm-cells", **LARGE_VALUES)
            m = m._replace(tables=summed(up, SEATS, 1)[0])
            gone, down = down, written(at_homes(table, up.unionByName(down.where(F.col("kind") == ROOTS)), m, 2 * k + 1, not keep, keep, k == burn + samples), "lm-homes", **LARGE_VALUES)
            dropped(spark, gone)
            if k > 1:
                dropped(spark, last)
            if keep:
                drawn.append(m._replace(roots=summed(down, ROOTS, 1)[0]))
        out = written(scored(table, down.unionByName(up), drawn, buckets), "lm-scores")
        dropped(spark, down)
        dropped(spark, up)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, path)
    return out
