"""What the compressed formats would cost, by window expressions alone; and the block codec as grouped functions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions import bits
from chronoframe.functions.buckets import bucket
from chronoframe.functions.codec import decode_block, encode_block
from chronoframe.operators.admit import ORDER, SPAN

SERIES = ["shard_id", "key"]


def timestamp_bits(points: DataFrame, window: int, default_delta: int) -> DataFrame:
    """(…, dod, bits): the delta of deltas in each block (of a shard, key and bucket) and its bits; 32 for a block's first."""
    b = points.withColumn("bucket", bucket(F.col("ts"), window))
    by = Window.partitionBy(*SERIES, "bucket").orderBy("ts", "arrival")
    b = b.withColumn("delta", F.col("ts") - F.lag("ts").over(by))
    before = F.when(F.row_number().over(by) == 2, F.lit(default_delta)).otherwise(F.lag("delta").over(by))
    b = b.withColumn("dod", F.col("delta") - before)
    size = F.when(F.col("dod").isNull(), 32).when(F.col("dod") == 0, 1)
    for low, high, n in ((-63, 64, 9), (-255, 256, 12), (-2047, 2048, 16)):
        size = size.when(F.col("dod").between(low, high), n)
    return b.withColumn("bits", size.otherwise(36))


def xor_profile(points: DataFrame, window: int) -> DataFrame:
    """Of each value that differs from the one before it in its block: leading and trailing zero bits of the XOR."""
    by = Window.partitionBy(*SERIES, "bucket").orderBy("ts", "arrival")
    b = points.withColumn("bucket", bucket(F.col("ts"), window)).withColumn("b", bits.double_bits(F.col("value")))
    x = F.col("b").bitwiseXOR(F.coalesce(F.lag("b").over(by), F.lit(0)))
    return b.withColumn("x", x).where("x <> 0").select(*SERIES, "bucket", "ts", "arrival", bits.leading_zeros(F.col("x")).alias("leading"), bits.trailing_zeros(F.col("x")).alias("trailing"))


def log_bits(points: DataFrame, keys: DataFrame, span: int = SPAN) -> DataFrame:
    """Bits of each log record's id and delta; the delta is against the shard's record before, whatever its series.

    As in ``newest_before``, a shard's arrivals are cut into blocks; a block's first record looks at the last one
    of the block before.
    """
    rows = points.withColumn("_block", F.expr(f"arrival div {span}"))
    ends = rows.groupBy("shard_id", "_block").agg(F.max_by("ts", F.struct(*ORDER)).alias("_end"))
    ends = ends.select("shard_id", "_block", F.lag("_end").over(Window.partitionBy("shard_id").orderBy("_block")).alias("_before"))
    inside = F.lag("ts").over(Window.partitionBy("shard_id", "_block").orderBy(*ORDER))
    rows = rows.join(ends, ["shard_id", "_block"], "left").withColumn("delta", F.col("ts") - F.coalesce(inside, F.col("_before"), F.col("ts")))
    rows = rows.join(keys, SERIES)
    id_bits = F.when(F.col("key_id") < 1 << 21, 22).otherwise(30)
    delta = F.when(F.col("delta") == 0, 1).when(F.col("delta").between(-63, 64), 9).when(F.col("delta").between(-8191, 8192), 17).otherwise(35)
    return rows.select("shard_id", "event_id", "delta", (id_bits + delta).alias("bits"))


BLOCKS = "shard_id int, key string, bucket long, count int, data binary"


BLOCKS_AT_ONCE = 4096


def _fits() -> Column:
    return F.col("ts").between(0, (1 << 32) - 1) & F.col("value").isNotNull()


def rejected(points: DataFrame) -> DataFrame:
    """Points whose timestamp doesn't fit the 32 bits of a block, or that lack a value."""
    return points.where(~F.coalesce(_fits(), F.lit(False)))


def encode(points: DataFrame, window: int) -> DataFrame:
    """Blocks of the points, one for each series and bucket; rows stream through sorted, so a task holds one block's points at a time.

    Points that no block can hold, which ``rejected`` gives, are skipped.
    """
    by = [*SERIES, "bucket"]
    laid = points.where(_fits()).withColumn("bucket", bucket(F.col("ts"), window)).select(*by, "ts", "arrival", "value").repartition(*by).sortWithinPartitions(*by, "ts", "arrival")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(batch.column(c).to_pylist() for c in (*by, "ts", "value")), strict=True) for batch in batches)
        pairs = ((head, [r[3:] for r in group]) for head, group in groupby(rows, key=lambda r: r[:3]))
        encoded = ((*head, len(x), encode_block(x)[0]) for head, x in pairs)
        types = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.binary())
        while part := list(islice(encoded, BLOCKS_AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=[*by, "count", "data"])

    return laid.mapInArrow(run, BLOCKS)


def decode(found: DataFrame) -> DataFrame:
    """Points of the blocks, numbered in each."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for shard, key, n, data in zip(*(batch.column(c).to_pylist() for c in (*SERIES, "count", "data")), strict=True):
                for k, (ts, value) in enumerate(decode_block(data, n)):
                    for col, x in zip(out, (shard, key, ts, value, k), strict=True):
                        col.append(x)
            types = (pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[*SERIES, "ts", "value", "place"])

    return found.mapInArrow(run, "shard_id int, key string, ts long, value double, place long")
