"""Token-id files: fixed-size blocks of ids, transposed into bit or byte planes, each plane compressed with zstandard.

A shard is one self-contained file::

    magic "CFTP"  version u8  plane kind u8 ('b' bits, 'B' bytes)  u16 0
    blocks        the compressed planes of block 0, block 1, ...; a plane of zeros has length 0
    index         per block: ids u32, planes u8, then the length of each plane u32
    documents     per document: doc_id i64, ids u32, 1 if it has a doc_id u8 (three columns)
    footer        index offset u64, documents offset u64, blocks u32, documents u32, ids u64, ids of its range before it u64, magic "CFTP"

All integers are little-endian.  Any block can be read by itself through the index.  ``write`` gives each shard a file of
its own, ``<range>-<number>.cftp`` in a folder that the executors share, through the file system of the folder's URI
(``pyarrow.fs``); a file gets its name when it is complete, and a task that is run again writes the same.  Names ascend as
doc_ids do.  ``read`` needs the files alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.kernel import binary_list, slices
from chronoframe.llm.storage import new_path, partitions
from chronoframe.llm.textmap import add_columns
from chronoframe.llm.unit_codes import ByteCodes, encoder

MAGIC = b"CFTP"
BLOCK_IDS = 1 << 16
#: Ids after which a shard is closed; a longer document has a shard to itself.
SHARD_IDS = 1 << 20
FOOTER = "<QQIIQQ"
TAIL = struct.calcsize(FOOTER) + len(MAGIC)
LEVEL = 3
END_ID = 2


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The block's planes, least significant first; those above the highest in use are left out."""
    by = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()) if len(ids) else 0
    if not bits:
        return [by[:, k].tobytes() for k in range(max(1, -(-top.bit_length() // 8)))]
    return [np.packbits(by[:, k // 8] >> (k % 8) & 1, bitorder="little").tobytes() for k in range(max(1, top.bit_length()))]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        if not plane:
            continue
        raw = np.frombuffer(plane, np.uint8)
        if bits:
            out[:, k // 8] |= np.unpackbits(raw, count=n, bitorder="little") << np.uint8(k % 8)
        else:
            out[:, k] = raw
    return out.view("<u4").reshape(n)


def pack_shard(lengths: list[int], ids: np.ndarray, bits: bool = False, block: int = BLOCK_IDS, names: list[int | None] | None = None, before: int = 0) -> bytes:
    """A shard of documents with these many ids each; ``names`` are their doc_ids, ``before`` the ids of the range before it."""
    z = zstandard.ZstdCompressor(level=LEVEL)
    body, index, at, blocks = [MAGIC + struct.pack("<BBH", 1, ord("b" if bits else "B"), 0)], [], 8, 0
    for k in range(0, len(ids), block):
        part = ids[k : k + block]
        planes = [z.compress(p) if any(p) else b"" for p in planes_of(part, bits)]
        body += planes
        index.append(struct.pack(f"<IB{len(planes)}I", len(part), len(planes), *map(len, planes)))
        at += sum(map(len, planes))
        blocks += 1
    tail = b"".join(index)
    names = names if names is not None else [None] * len(lengths)
    documents = np.array([x or 0 for x in names], "<i8").tobytes() + np.array(lengths, "<u4").tobytes() + np.array([x is not None for x in names], "<u1").tobytes()
    return b"".join([*body, tail, documents, struct.pack(FOOTER, at, at + len(tail), blocks, len(lengths), len(ids), before), MAGIC])


class Shard:
    """Reads a shard, whole or block by block."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC or raw[-4:] != MAGIC or raw[4] != 1:
            raise ValueError("not a shard of token ids")
        self.raw, self.bits = raw, raw[5] == ord("b")
        at, documents, blocks, n, self.n_ids, self.before = struct.unpack(FOOTER, raw[-TAIL:-4])
        named = np.frombuffer(raw, "<u1", n, documents + 12 * n)
        self.names = [i if ok else None for i, ok in zip(np.frombuffer(raw, "<i8", n, documents).tolist(), named.tolist(), strict=True)]
        self.lengths = np.frombuffer(raw, "<u4", n, documents + 8 * n).astype(np.int64)
        self.blocks, begin = [], 8
        for _ in range(blocks):
            ids, planes = struct.unpack_from("<IB", raw, at)
            sizes = struct.unpack_from(f"<{planes}I", raw, at + 5)
            self.blocks.append((begin, ids, sizes))
            begin += sum(sizes)
            at += 5 + 4 * planes

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.blocks[k]
        z, planes = zstandard.ZstdDecompressor(), []
        for size in sizes:
            planes.append(z.decompress(self.raw[at : at + size]) if size else b"")
            at += size
        return from_planes(planes, n, self.bits)

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.blocks))]) if self.blocks else np.zeros(0, np.uint32)


def encode(docs: DataFrame, path: str, end_id: int | None = END_ID, narrow: bool = True) -> DataFrame:
    """(doc_id, wide, ids): the ids of each text, 2 bytes each or 4 where one needs more."""

    def make():
        codes = encoder(ByteCodes, path)

        def run(texts):
            ids, n = codes.encode(texts)
            blobs, wide, at = [], [], 0
            for k in n.tolist():
                x = ids[at : at + k]
                at += k
                if end_id is not None:
                    x = np.append(x, np.uint32(end_id))
                big = not narrow or (len(x) and int(x.max()) > 65535)
                wide.append(bool(big))
                blobs.append(x.astype("<u4" if big else "<u2").tobytes())
            return {"wide": wide, "ids": blobs}

        return run

    return add_columns(docs.select("doc_id", "text"), make, "wide boolean, ids binary", drop=("text",))


def stored(uri: str, raw: bytes) -> None:
    """Writes a whole file; it has its name only when it is complete."""
    fs, path = pafs.FileSystem.from_uri(uri)
    folder, name = path.rsplit("/", 1)
    fs.create_dir(folder)
    tmp = f"{folder}/_{name}.{uuid.uuid4().hex}"  # Spark's readers leave names out that begin so
    with fs.open_output_stream(tmp) as f:
        f.write(raw)
    fs.move(tmp, path)


def write(docs: DataFrame, codes: str, path: str | None = None, bits: bool = False, n: int | None = None, end_id: int | None = END_ID) -> str:
    """Encodes the documents, writes their ids as shard files in ascending doc_id order, and returns the files' folder.

    The texts are dealt into ranges of doc_id and sorted within before they are encoded, so the bounds of
    the ranges are found from the ids alone.  Null ids come first, and rows of equal ids stand in the
    order of their texts.  A task holds one shard at a time.
    """
    spark = docs.sparkSession
    path, n = path or new_path(spark, "token-files"), n or partitions(spark)
    base = path if "://" in path or path.startswith("file:") else f"file://{path}"
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt = encode(ordered, codes, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first, ids, lengths, names, total = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def close() -> None:
            stored(f"{base}/{part:08d}-{seq:08d}.cftp", pack_shard(lengths, np.concatenate(ids), bits, names=names, before=first))

        for batch in batches:
            for name, wide, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "wide", "ids")), strict=True):
                x = np.frombuffer(raw, "<u4" if wide else "<u2")
                if lengths and total + len(x) > SHARD_IDS:
                    close()
                    seq, first, ids, lengths, names, total = seq + 1, first + total, [], [], [], 0
                ids.append(x)
                lengths.append(len(x))
                names.append(name)
                total += len(x)
        if lengths:
            close()
            yield pa.RecordBatch.from_arrays([pa.array([seq + 1], pa.int64())], names=["files"])

    dealt.mapInArrow(run, "files long").agg(F.sum("files")).collect()
    return path


def files(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, content) of the files of a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.cftp").load(path) if _any(spark, path) else spark.createDataFrame([], "path string, content binary")
    name = r"(\d+)-(\d+)\.cftp$"
    return found.select(F.regexp_extract("path", name, 1).cast("int").alias("part"), F.regexp_extract("path", name, 2).cast("int").alias("seq"), "content")


def _any(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def part_starts(found: DataFrame) -> dict[int, int]:
    """Ids before each range, from the footers: a row for each range goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [struct.unpack(FOOTER, x.as_py()[:-4])[4] for x in batch.column("tail")]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(n, pa.int64())], names=["part", "n"])

    tails = found.select("part", F.expr(f"substring(content, {-TAIL}, {TAIL})").alias("tail"))
    rows = tails.mapInArrow(run, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()
    out, at = {}, 0
    for part, n in sorted(rows):
        out[part] = at
        at += n
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    found = files(spark, path)
    starts = part_starts(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(raw.as_py())
                ids, n = shard.ids().astype("<u4"), shard.lengths
                stop = np.cumsum(n)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * (b - a) : 4 * b]) for a, b in zip(n.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.names, pa.int64()), pa.array(stop - n + (shard.before + starts[part])), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return found.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
