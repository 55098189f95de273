"""Binary key lists, block files and logs, brought in as tables; blocks and logs can be built too.

Files lie in ``<folder>/<shard>/<prefix>.<number>``; all integers in them are big-endian.  Spark reads each file
as one value (2 GB at most) and Arrow batches take it apart, so files are spread over the cluster.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.config import DEFAULT
from chronoframe.functions.bits import STORAGE_ID
from chronoframe.functions.codec import LEADING_BITS, MAX_LEADING, SIZE_BITS, Reader, Writer, decode_block

# fixed values of the formats
KEY_PREFIX, BLOCK_PREFIX, COMPLETE_PREFIX, LOG_PREFIX = "key_list", "block_data", "complete_block", "log"
PLAIN_MARK, CATEGORY_MARK = b"0", b"1"
PAGE_BYTES = 65536
SHORT_ID_BITS, LONG_ID_BITS = 21, 29
LOG_DELTA_BITS = (0, 7, 14, 32)  # by the ones of the control bits; what is stored is the step plus 2**(bits - 1) - 1
#: No record of a log is longer: 30 bits of id, 35 of the step and 76 of the value.
RECORD_BYTES = 18
ROWS_AT_ONCE = 65536

KEYS = "shard_id int, file_id long, seq long, key_id int, key binary, category int"
LOGS = "shard_id int, file_ts long, seq long, key_id long, ts long, value double"
BLOCKS = "shard_id int, bucket long, key_id long, count int, data binary"


def listed(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """(shard_id, file_id, content) of the files with the prefix that aren't empty."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{prefix}.*").load(folder)
    place = rf"/(\d+)/{prefix}\.(\d+)$"
    named = files.where(F.col("path").rlike(place))
    return named.select(F.regexp_extract("path", place, 1).cast("int").alias("shard_id"), F.regexp_extract("path", place, 2).cast("long").alias("file_id"), "content")


def completed(spark: SparkSession, folder: str) -> DataFrame:
    """(shard_id, file_id) of the completion marks.  They are empty files, which Spark's readers skip, so their names are listed."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*/{COMPLETE_PREFIX}.*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    names = [(f.getPath().getParent().getName(), f.getPath().getName().removeprefix(f"{COMPLETE_PREFIX}.")) for f in found]
    return spark.createDataFrame([(int(s), int(n)) for s, n in names if s.isdigit() and n.isdigit()], "shard_id int, file_id long")


def key_records(raw: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(key_id, key, category) of each whole record of a key list; files without a known mark have none.  Keys are any bytes."""
    mark = raw[:1]
    if mark not in (PLAIN_MARK, CATEGORY_MARK):
        return
    head = struct.Struct(">iHI" if mark == CATEGORY_MARK else ">iI")
    at = 1
    while at + head.size <= len(raw):
        key_id, *category, size = head.unpack_from(raw, at)
        at += head.size
        if at + size > len(raw):
            return
        yield key_id, raw[at : at + size], category[0] if category else 0
        at += size


def key_bytes(records: list[tuple[int, bytes, int]]) -> bytes:
    """A key list of (key_id, key, category) records."""
    return CATEGORY_MARK + b"".join(struct.pack(">iHI", key_id, category, len(key)) + key for key_id, key, category in records)


def block_records(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(key_id, count, data) of each block of a block file; ValueError where its length is wrong."""
    if len(raw) < 8:
        raise ValueError("a block file needs 8 bytes at least")
    n, pages = struct.unpack_from(">II", raw)
    first_page = 8 + 12 * n
    if len(raw) != first_page + PAGE_BYTES * pages:
        raise ValueError(f"a block file of {n} blocks and {pages} pages has {len(raw)} bytes")
    for key_id, where in zip(struct.unpack_from(f">{n}I", raw, 8), struct.unpack_from(f">{n}Q", raw, 8 + 4 * n), strict=True):
        fields = []
        for bits in reversed(STORAGE_ID):
            fields.append(where & ((1 << bits) - 1))
            where >>= bits
        count, size, offset, page = fields
        if page >= pages or offset + size > PAGE_BYTES:
            raise ValueError("a block lies outside its file's pages")
        begin = first_page + page * PAGE_BYTES + offset
        yield key_id, count, raw[begin : begin + size]


def block_file(blocks: list[tuple[int, int, bytes]]) -> bytes:
    """A block file of (key_id, count, data); a block doesn't cross a page's end."""
    pages, places = [bytearray()], []
    for _, count, data in blocks:
        if max(count, len(data)) >= 1 << STORAGE_ID[-1]:
            raise ValueError("the block is too large")
        if len(pages[-1]) + len(data) > PAGE_BYTES:
            pages.append(bytearray())
        where = len(pages) - 1
        for value, bits in zip((len(pages[-1]), len(data), count), STORAGE_ID[1:], strict=True):
            where = where << bits | value
        places.append(where)
        pages[-1] += data
    n = len(blocks)
    return struct.pack(f">II{n}I{n}Q", n, len(pages), *(b[0] for b in blocks), *places) + b"".join(bytes(p).ljust(PAGE_BYTES, b"\0") for p in pages)


def log_records(raw: bytes, base: int) -> Iterator[tuple[int, int, float]]:
    """(key_id, ts, value) of each whole record of a log that starts from the timestamp ``base``.

    Each record begins at a byte.  What follows a cut-off record, or one whose id is too large, isn't read.
    """
    ts, before, at = base, {}, 0
    while at < len(raw):
        r = Reader(raw[at : at + RECORD_BYTES])
        try:
            key_id = r.get(LONG_ID_BITS if r.get(1) else SHORT_ID_BITS)
            if key_id > DEFAULT.max_key_id:
                return
            ones = 0
            while ones < 3 and r.get(1):
                ones += 1
            step = r.get(LOG_DELTA_BITS[ones])
            if ones:
                step -= (1 << LOG_DELTA_BITS[ones] - 1) - 1
            bits = before.get(key_id, 0)
            if r.get(1):
                leading, size = r.get(LEADING_BITS), r.get(SIZE_BITS) + 1
                if leading + size > 64:
                    return
                bits ^= r.get(size) << 64 - leading - size
        except ValueError:
            return
        at += -(-r.at // 8)
        ts += step
        before[key_id] = bits
        yield key_id, ts, struct.unpack(">d", struct.pack(">Q", bits))[0]


def log_bytes(records: list[tuple[int, int, float]], base: int) -> bytes:
    """A log of (key_id, ts, value) records; ValueError where an id or a step doesn't fit."""
    out, last, before = [], base, {}
    for key_id, ts, value in records:
        if not 0 <= key_id <= DEFAULT.max_key_id:
            raise ValueError(f"the id {key_id} doesn't fit a log")
        w = Writer()
        long = key_id >> SHORT_ID_BITS > 0
        w.put(long, 1)
        w.put(key_id, LONG_ID_BITS if long else SHORT_ID_BITS)
        step, last = ts - last, ts
        if step == 0:
            w.put(0, 1)
        else:
            for ones in (1, 2, 3):
                half = 1 << LOG_DELTA_BITS[ones] - 1
                if -half < step <= half:
                    break
            else:
                raise ValueError("the step doesn't fit a log")
            w.put((1 << ones) - 1, ones)
            if ones < 3:
                w.put(0, 1)
            w.put(step + half - 1, LOG_DELTA_BITS[ones])
        bits = struct.unpack(">Q", struct.pack(">d", value))[0]
        x = bits ^ before.get(key_id, 0)
        before[key_id] = bits
        w.put(x != 0, 1)
        if x:
            leading, trailing = min(MAX_LEADING, 64 - x.bit_length()), (x & -x).bit_length() - 1
            w.put(leading, LEADING_BITS)
            w.put(63 - leading - trailing, SIZE_BITS)
            w.put(x >> trailing, 64 - leading - trailing)
        out.append(w.bytes())
    return b"".join(out)


def _exploded(files: DataFrame, fields: str, rows_of: Callable[[int, bytes], Iterator[tuple]], row: Callable[[int, int, int, tuple], tuple]) -> DataFrame:
    """A row for each record of each file; records come from the file's number and content."""
    arrow = files.sparkSession.createDataFrame([], fields).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file, raw in zip(*(batch.column(c) for c in ("shard_id", "file_id", "content")), strict=True):
                s, f = shard.as_py(), file.as_py()
                found = enumerate(rows_of(f, raw.as_py()))
                while part := list(islice(found, ROWS_AT_ONCE)):
                    cols = zip(*(row(s, f, k, x) for k, x in part), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow, strict=True)], names=arrow.names)

    return files.select("shard_id", "file_id", "content").mapInArrow(run, fields)


def read_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all key lists but number 0, which is an unfinished one; ``seq`` ascends as they were written."""
    files = listed(spark, folder, KEY_PREFIX).where("file_id > 0")
    return _exploded(files, KEYS, lambda _, raw: key_records(raw), lambda s, f, k, x: (s, f, f << 32 | k, *x))


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of the files that have a completion mark beside them; a file's number is its bucket."""
    files = listed(spark, folder, BLOCK_PREFIX).join(completed(spark, folder), ["shard_id", "file_id"], "left_semi")
    return _exploded(files, BLOCKS, lambda _, raw: block_records(raw), lambda s, f, _, x: (s, f, *x))


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all log files; a file's number is the timestamp that it starts from, and ``seq`` ascends in it."""
    return _exploded(listed(spark, folder, LOG_PREFIX), LOGS, lambda base, raw: log_records(raw, base), lambda s, f, k, x: (s, f, k, *x))


def keyed(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """Blocks, or what else has (shard_id, key_id), with the key of their series; those of unknown ids are left out."""
    return blocks.join(keys.select("shard_id", "key_id", "key"), ["shard_id", "key_id"])


def points_of(blocks: DataFrame, default_delta: int = 60) -> DataFrame:
    """(shard_id, bucket, key_id, ts, value) of all blocks' points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [decode_block(data, n, default_delta) for data, n in zip(batch.column("data").to_pylist(), batch.column("count").to_pylist(), strict=True)]
            at = pa.array([k for k, points in enumerate(got) for _ in points], pa.int64())
            ts, value = ([p[j] for points in got for p in points] for j in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("shard_id", "bucket", "key_id")), pa.array(ts, pa.int64()), pa.array(value, pa.float64())], names=["shard_id", "bucket", "key_id", "ts", "value"])

    return blocks.mapInArrow(run, "shard_id int, bucket long, key_id long, ts long, value double")
