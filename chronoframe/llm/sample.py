"""The bounded sample of labelled rows that the two classifiers are fitted on."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from chronoframe.llm.kernel import binary_list, slices
from chronoframe.llm.storage import fold, small_batches

#: Low bits of a packed feature that say how often it occurs; the others are its bucket.
COUNT_BITS = 14


def training_ids(labels: DataFrame, target: str, limit: int, folds: int | None = 3, held: int = 1) -> DataFrame:
    """At most ``limit`` labelled ids outside the held-out fold, those of the smallest hash, as (_id, _y).

    Labels that contradict each other, and null ones, take no part.
    """
    rows = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull())
    if folds:
        rows = rows.where(fold(F.col("doc_id"), folds) != held)
    rows = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.min(target).alias("_y"), F.max(target).alias("_z")).where("_y = _z").drop("_z")
    return rows.orderBy(F.xxhash64("_id"), "_id").limit(limit)


def packed(f: np.ndarray, d: np.ndarray, n: int, size: int) -> list[bytes]:
    """The buckets of each of n texts, ascending, a 32-bit word for a bucket and its count; a count that COUNT_BITS don't hold takes several words."""
    most = (1 << COUNT_BITS) - 1
    key = np.sort(d * size + f)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    u, c = key[cut], np.diff(np.append(cut, len(key)))
    times = -(-c // most)
    count = np.full(int(times.sum()), most)
    count[np.cumsum(times) - 1] = c - (times - 1) * most
    u = np.repeat(u, times)
    words = ((u % size << COUNT_BITS) | count).astype("<u4")
    at = np.searchsorted(u // size, np.arange(n + 1))
    return [words[at[i] : at[i + 1]].tobytes() for i in range(n)]


class Rows:
    """The sample as (doc_id, y, buckets) in ascending doc_id order, so that the result doesn't depend on the layout of the input.

    Packed features lie in a temporary file of the task and a row's are read when it is asked for, so
    memory holds an entry for each row, however long the texts are.  The file goes with its last reader.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        found, end = [], 0
        with tempfile.TemporaryFile() as file:
            for batch in batches:
                for doc_id, y, f in zip(*(batch.column(c) for c in ("doc_id", "y", "f")), strict=True):
                    words = f.as_py()
                    file.write(words)
                    found.append((doc_id.as_py(), xxh3_128_digest(words), y.as_py(), end, end := end + len(words) // 4))
            file.flush()
            self.words = np.memmap(file, "<u4", "r") if end else np.zeros(0, "<u4")
        self.rows = sorted(found)

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> tuple[int, int, np.ndarray]:
        doc_id, _, y, a, b = self.rows[k]
        words = np.array(self.words[a:b])
        return doc_id, y, np.repeat((words >> COUNT_BITS).astype(np.int32), words & ((1 << COUNT_BITS) - 1))


def fitted(docs: DataFrame, ids: DataFrame, features: Callable, train: Callable, size: int) -> np.ndarray:
    """Weights from ``train(rows)``, run in one task on the features of the sample's documents.

    ``ids`` is bounded by its limit, so it's broadcast and the texts aren't shuffled.  doc_id keeps the
    type that it has in the table.  rows: see Rows.
    """
    small_batches(docs.sparkSession)
    some = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "_y", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_list(batch.column("text"))
            for a, b in slices(texts):
                blobs = packed(*features(texts[a:b]), b - a, size)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_y").cast(pa.int32()), pa.array(blobs, pa.binary())], names=["doc_id", "y", "f"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(batches)
        w = train(rows) if rows else np.zeros(size)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()], pa.binary())], names=["w"])

    schema = T.StructType([T.StructField("doc_id", some.schema.fields[0].dataType), T.StructField("y", T.IntegerType()), T.StructField("f", T.BinaryType())])
    got = some.mapInArrow(encode, schema).repartition(1).mapInArrow(learn, "w binary").collect()
    return np.frombuffer(got[0]["w"], "<f8") if got else np.zeros(size)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
