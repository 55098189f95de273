"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap.  Each chunk is split into pre-tokens by itself, chunks of long
texts in tasks of their own.  The first pre-tokens of a chunk may be wrong, since it can begin inside
one; but the pattern only looks ahead, so from the first boundary that a chunk shares with the one
before it, both agree.  There the two are stitched.  Where an overlap holds no common boundary, the
text is split on from the last sure one until it meets the chunk's.  The pieces are then encoded one
by one, and decoding joins the bytes of the ids.

Null and empty texts have no ids.  Repeated rows give equal results; a null doc_id stays null.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.kernel import binary_list
from chronoframe.llm.storage import partitions
from chronoframe.llm.textmap import add_columns

#: Characters of a chunk and of the overlap with the next.
CHUNK, OVERLAP = 1 << 14, 256
#: Texts of more characters have their chunks split in tasks of their own.
LONG = 1 << 16
CACHED_PIECES = 400_000


def ends_of(pattern: regex.Pattern, text: str, base: int = 0) -> list[int]:
    """Ends of the pre-tokens; they cover the text without gaps."""
    out, at = [], base
    for piece in pattern.findall(text):
        at += len(piece)
        out.append(at)
    return out


def cuts(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Begin and end of each chunk of a text of n characters."""
    return [(a, min(n, a + chunk + overlap)) for a in range(0, max(1, n), chunk)]


def stitch(pattern: regex.Pattern, text: str, parts: list[tuple[int, list[int]]]) -> list[int]:
    """Ends of the whole text's pre-tokens from those of its chunks, given as (begin, ends) in order."""
    sure: list[int] = []
    for k, (begin, ends) in enumerate(parts):
        last = k == len(parts) - 1
        if k == 0:
            new = ends
        else:
            at = sure[-1] if sure else 0
            bounds = [begin, *ends]
            here = set(bounds)
            while at < begin or at not in here:  # the chunk begins inside a pre-token
                if at >= (ends[-1] if ends else begin):
                    break
                back = next((x for x in reversed(sure[-64:]) if begin <= x and x in here), None) if at >= begin else None
                if back is not None:
                    while sure[-1] != back:
                        sure.pop()
                    at = back
                    break
                at = pattern.match(text, at).end()
                sure.append(at)
            new = [x for x in ends if x > at]
        # what touches the chunk's end may go on, and white space looks one character ahead
        sure += new if last else new[:-2]
    return sure


def pretokens(pattern: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pieces of the text, by chunks."""
    if len(text) <= chunk:
        return pattern.findall(text)
    ends = stitch(pattern, text, [(a, ends_of(pattern, text[a:b], a)) for a, b in cuts(len(text), chunk, overlap)])
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Pieces(dict):
    """Ids by piece, found when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHED_PIECES:
            self.clear()
        ids = self[piece] = tuple(self.encode(piece))
        return ids


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.pieces = Pieces(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)
        self.bytes = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> list[int]:
        return self.ids(pretokens(self.pattern, text))

    def ids(self, pieces: list[str]) -> list[int]:
        get = self.pieces.__getitem__
        return list(chain.from_iterable([get(p) for p in pieces]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One for each Python worker, kept from task to task."""
    return Codec(ranks_path, pattern)


def digest(c: Codec, ids: list[int]) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The table with a column ``ids`` in place of ``text``."""

    def make():
        c = codec(ranks_path, pattern)
        return lambda texts: {"ids": [c.encode(t.decode()) for t in texts]}

    return add_columns(docs, make, "ids array<int>", drop=("text",))


def decode_ids(ids: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The table with a column ``bytes`` in place of ``ids``."""
    out = [f for f in ids.schema.fieldNames() if f != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            raw = [c.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in out), pa.array(raw, pa.binary())], names=[*out, "bytes"])

    schema = ids.drop("ids").withColumn("bytes", F.lit(b"")).schema
    return ids.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Every document's number of ids and the digests of its ids and of the decoded bytes."""
    docs = docs.select("doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0))

    def make():
        c = codec(ranks_path, pattern)

        def run(texts):
            got = [digest(c, c.encode(t.decode())) for t in texts]
            return dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*got, strict=True), strict=True)) if got else {}

        return run

    short = add_columns(docs.where(size <= LONG), make, DIGESTS, drop=("text",))
    return short.unionByName(long_digests(docs.where(size > LONG), ranks_path, pattern))


def long_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """As ``digests``, for long texts: a task for some chunks, then the stitching, text by text, then a task for some
    stitched stretches; a text's digests take its stretches in turn and hold one at a time."""
    n = partitions(docs.sparkSession)
    docs = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    one = docs.dropDuplicates(["_key"]).select("_key", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column("_key").to_pylist(), binary_list(batch.column("text")), strict=True):
                text = raw.decode()
                yield from rows((key, a, text[a:b]) for a, b in cuts(len(text), CHUNK, OVERLAP))

    def rows(found: Iterator[tuple[int, int, str]]) -> Iterator[pa.RecordBatch]:
        while part := list(islice(found, 64)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["_key", "_at", "text"])

    stretch = "_key long, _at int, text string"

    def split():
        find = regex.compile(pattern)
        return lambda texts: {"_ends": [ends_of(find, t.decode()) for t in texts]}

    ends = add_columns(one.mapInArrow(cut, stretch).repartition(n, "_key", "_at"), split, "_ends array<int>", drop=("text",))
    ends = ends.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_at", "_ends"))).alias("_parts"))

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern)
        for batch in batches:
            for key, raw, parts in zip(batch.column("_key").to_pylist(), binary_list(batch.column("text")), batch.column("_parts").to_pylist(), strict=True):
                text = raw.decode()
                at = stitch(find, text, [(p["_at"], [p["_at"] + x for x in p["_ends"]]) for p in parts])
                # stretches of whole pre-tokens, with their ends: split anew, white space at a stretch's end could fall otherwise
                last = [k for k in range(len(at)) if k + 1 == len(at) or at[k] // LONG != at[k + 1] // LONG]
                for j, k in zip([0, *(k + 1 for k in last)], last, strict=False):
                    a = at[j - 1] if j else 0
                    cells = ([key], [a], [text[a : at[k]]], [[x - a for x in at[j : k + 1]]])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32())), strict=True)], names=["_key", "_at", "text", "_ends"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            for key, at, raw, found in zip(batch.column("_key").to_pylist(), batch.column("_at").to_pylist(), binary_list(batch.column("text")), batch.column("_ends").to_pylist(), strict=True):
                text = raw.decode()
                ids = c.ids([text[a:b] for a, b in zip([0, *found], found, strict=False)])
                cells = ([key], [at], [len(ids)], [",".join(map(str, ids)).encode()], [c.decode(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["_key", "_at", "_n", "_ids", "_bytes"])

    pieces = one.join(ends, "_key").select("_key", "text", "_parts").mapInArrow(stitched, f"{stretch}, _ends array<int>").repartition(n, "_key", "_at")
    coded = pieces.mapInArrow(encoded, "_key long, _at int, _n long, _ids binary, _bytes binary")
    laid = coded.repartition(n, "_key").sortWithinPartitions("_key", "_at")

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n_ids, ids, raw = None, 0, hashlib.sha256(), hashlib.sha256()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([ids.hexdigest()]), pa.array([raw.hexdigest()])], names=["_key", "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            for k, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("_key", "_n", "_ids", "_bytes")), strict=True):
                if k != key:
                    if key is not None:
                        yield row()
                    key, n_ids, ids, raw = k, 0, hashlib.sha256(), hashlib.sha256()
                if m:
                    ids.update(b"," * (n_ids > 0) + x)
                    n_ids += m
                raw.update(y)
        if key is not None:
            yield row()

    found = laid.mapInArrow(digested, f"_key long, {DIGESTS}")
    return docs.select("_key", "doc_id").join(found, "_key").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
