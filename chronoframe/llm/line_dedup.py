"""Line dedup against levelled sorted runs of line hashes.

A line's key is the line without white space at its ends (space and 0x09-0x0D), A-Z lower-cased, as a
128-bit hash; only keys of at least MIN_POINTS code points count.  Documents go in batches of ascending
doc_id.  A batch's keys are anti-joined with the runs of the batches before, and the new ones become a
run of level 0: a Parquet table bucketed and sorted by key, so that the joins neither shuffle nor
re-deal a run.  FANOUT runs of a level are merged into one of the next.

A line is dropped if its key is in an earlier run, or a smaller doc_id of its own batch holds it.  Each
task first reduces its lines to one row for a key and batch, so a line that a third of all documents
share is a row for each task, not for each document.

Null texts count as empty (one empty line).  Rows that share a doc_id count as one document, rows
without doc_id as one document that comes last.  What is dropped is noted by document and text, so a
row is sent its own lines, not those of all rows of its document.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from chronoframe.llm.kernel import Flat, binary_list, combine, mix, ragged, slices
from chronoframe.llm.storage import delete, fresh, new_path, partitions, small_batches, written

MIN_POINTS = 10
#: Batches that ``dedup`` deals a whole table into, and runs of a level that are merged.
BATCHES, FANOUT = 4, 2
LAST = (1 << 63) - 1
KEY = ["h1", "h2"]


def lines_of(texts: list[bytes]) -> tuple[Flat, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines of all texts: their text, whether the key counts, and the key's two hashes (128 bits of XXH3)."""
    flat = Flat(texts, lower=True)
    raw = flat.bytes
    end = np.flatnonzero(raw[:-8] == 10)
    begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end.copy()
    docs = flat.docs(begin)
    for at, step in ((begin, 1), (end, -1)):  # strip white space, byte by byte where there is some
        live = np.arange(len(begin))
        while len(live):
            c = raw[at[live] - (step < 0)]
            live = live[(begin[live] < end[live]) & (((c - np.uint8(9)) < 5) | (c == 32))]
            at[live] += step
    size = end - begin
    counts = size >= MIN_POINTS
    short = np.flatnonzero(counts & (size < 4 * MIN_POINTS))  # longer ones have enough code points in any case
    if len(short):
        lead = (raw[ragged(begin[short], size[short])] & 0xC0) != 0x80
        counts[short] = np.add.reduceat(lead.astype(np.int64), np.cumsum(size[short]) - size[short]) >= MIN_POINTS
    h = np.zeros((2, len(begin)), np.uint64)
    data = flat.raw
    digests_ = b"".join([xxh3_128_digest(data[a:b]) for a, b in zip(begin[counts].tolist(), end[counts].tolist(), strict=True)])
    h[:, counts] = np.frombuffer(digests_, "<u8").reshape(-1, 2).T
    return flat, docs, counts, h[0], h[1]


class Runs:
    """The index: levels of sorted runs, each a bucketed table in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets or partitions(spark), fanout
        self.path, self.levels = new_path(spark, "line-runs"), [[]]

    def write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose key no run holds."""
        for level in self.levels:
            for name in level:
                rows = rows.join(self.spark.table(name).select(*KEY), KEY, "left_anti")
        return rows

    def add(self, rows: DataFrame) -> str:
        """Adds (h1, h2, doc) rows of unseen keys as a run; returns its name, which a merge keeps readable."""
        name = self.write(rows)
        self.levels[0].append(name)
        return name

    def compact(self) -> None:
        """Merges each full level; both sides are bucketed and sorted alike, so nothing is shuffled."""
        for k in range(len(self.levels)):
            if len(self.levels[k]) < self.fanout:
                continue
            first, *rest = self.levels[k]
            merged = self.spark.table(first)
            for name in rest:
                other = self.spark.table(name).withColumnRenamed("doc", "_d")
                merged = merged.join(other, KEY, "full").select(*KEY, F.coalesce("doc", "_d").alias("doc"))
            done = self.write(merged)
            for name in self.levels[k]:
                self.drop(name)
            self.levels[k] = []
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(done)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self.drop(name)
        self.levels = [[]]


def digests(docs: DataFrame, bounds: list[int]) -> DataFrame:
    """(batch, sure, h1, h2, doc, t): a task's smallest document of each key and batch, and, marked sure, its other documents that hold it.

    A document has a row for each of its texts that hold the key; t tells them apart.
    """
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0

        def reduced() -> list[np.ndarray]:
            k, h1, h2, doc, t, sure = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((t, doc, h2, h1, k))
            k, h1, h2, doc, t, sure = (x[order] for x in (k, h1, h2, doc, t, sure))
            same = np.zeros(len(k), bool)
            same[1:] = (k[1:] == k[:-1]) & (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            again = same.copy()
            again[1:] &= (doc[1:] == doc[:-1]) & (t[1:] == t[:-1])  # the same line again in the same text
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(k)))) if len(k) else np.zeros(0, int)
            sure = sure | (doc != doc[head])
            return [x[~again] for x in (k, h1, h2, doc, t, sure)]

        def out(cols: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
            k, h1, h2, doc, t, sure = (x[keep] for x in cols)
            return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(sure), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(doc), pa.array(t)], names=["batch", "sure", "h1", "h2", "doc", "t"])

        for batch in batches:
            texts = binary_list(batch.column("text"))
            ids, marks = (np.array(batch.column(c).to_pylist(), n) for c, n in (("doc", np.int64), ("t", np.int32)))
            for a, b in slices(texts):
                _, d, counts, h1, h2 = lines_of(texts[a:b])
                doc, t = ids[a:b][d[counts]], marks[a:b][d[counts]]
                held.append((np.searchsorted(edges, doc), h1[counts], h2[counts], doc, t, np.zeros(len(doc), bool)))
                rows += len(doc)
            if rows > 1_000_000:  # sure rows go out, one row for a key stays
                cols = reduced()
                yield out(cols, cols[5])
                keep = ~cols[5]
                held = [tuple(x[keep] for x in cols)]
                rows = int(keep.sum())
                if rows > 500_000:
                    yield out([x[keep] for x in cols], np.ones(rows, bool))
                    held, rows = [], 0
        if held:
            cols = reduced()
            yield out(cols, np.ones(len(cols[0]), bool))

    fields = "batch int, sure boolean, h1 long, h2 long, doc long, t int"
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), text_mark().alias("t"), "text").mapInArrow(run, fields)


def text_mark():
    """Tells the texts of one document apart; two with one mark share their notes, which are the same for a line in any case."""
    return F.hash("text")


def drops_of_batch(rows: DataFrame, runs: Runs) -> DataFrame:
    """(doc, t, h1) of the batch's lines that are dropped, beside the sure ones; adds the batch's keys to the runs."""
    lines = rows.where("NOT sure").select(*KEY, "doc", "t")
    name = runs.add(runs.unseen(lines.groupBy(*KEY).agg(F.min("doc").alias("doc"))))
    new = runs.spark.table(name).withColumnRenamed("doc", "_first")
    dropped = lines.join(new, KEY, "left").where(F.col("_first").isNull() | (F.col("_first") < F.col("doc"))).select("doc", "t", "h1")
    return written(dropped, "line-drops")


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The table with the kept lines as ``text``, and n_lines and n_dropped.

    Input columns named n_lines or n_dropped are replaced; all other columns stay.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shares = F.array(*(F.lit(k / batches) for k in range(1, batches))) if batches > 1 else None
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 200)).first()[0] if batches > 1 else None
    bounds = sorted(set(cuts or ()))
    seen = written(digests(docs, bounds), "lines")
    runs = Runs(spark)
    drops = seen.where("sure").select("doc", "t", "h1")
    for k in range(len(bounds) + 1):
        drops = drops.unionByName(drops_of_batch(seen.where(F.col("batch") == k), runs))
        runs.compact()
    runs.close()
    by_text = drops.groupBy(F.col("doc").alias("_doc"), F.col("t").alias("_t")).agg(F.collect_set("h1").alias("_drop"))
    return without(docs, by_text)


def without(docs: DataFrame, by_text: DataFrame) -> DataFrame:
    """Takes the lines whose keys are in (_doc, _t, _drop) out of the texts."""
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    key, mark, doc, t, drop = (fresh(x, names) for x in ("_key", "_mark", "_doc", "_t", "_drop"))
    by_text = by_text.select(F.col("_doc").alias(doc), F.col("_t").alias(t), F.col("_drop").alias(drop))
    joined = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(mark, text_mark())
    joined = joined.join(by_text.hint("shuffle_hash"), (F.col(key) == F.col(doc)) & (F.col(mark) == F.col(t)), "left").select(*names, drop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = binary_list(batch.column("text")), batch.column(drop).to_pylist()
            for a, b in slices(texts):
                part = texts[a:b]
                _, d, counts, h1, _ = lines_of(part)
                sizes = np.array([len(x or ()) for x in gone[a:b]], np.int64)
                flagged = np.array([y for x in gone[a:b] for y in x or ()], np.int64).view(np.uint64)
                with np.errstate(over="ignore"):
                    marks = np.sort(combine(flagged, mix(np.repeat(np.arange(b - a, dtype=np.uint64), sizes))))
                    mine = combine(h1, mix(d.astype(np.uint64)))
                at = np.searchsorted(marks, mine)
                hit = counts & (at < len(marks))
                hit[hit] = marks[at[hit]] == mine[hit]
                n, lost = np.bincount(d, minlength=b - a), np.bincount(d[hit], minlength=b - a)
                texts_out = list(part)
                first = np.cumsum(n) - n
                for i in np.flatnonzero(lost):
                    stay = ~hit[first[i] : first[i] + n[i]]
                    texts_out[i] = b"\n".join([x for x, s in zip(part[i].split(b"\n"), stay, strict=True) if s])
                cut = batch.slice(a, b - a)
                # not safe: Spark's strings may hold bytes that aren't UTF-8, which stay as they are
                yield pa.RecordBatch.from_arrays([pa.array(texts_out, pa.binary()).cast(pa.string(), safe=False) if c == "text" else cut.column(c) for c in names] + [pa.array(n), pa.array(lost)], names=[*names, "n_lines", "n_dropped"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(run, schema)


