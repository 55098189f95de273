"""Memory and order of the classifiers' sample: long texts mustn't all be held in the task that learns."""

import re
import tracemalloc
from collections.abc import Sequence

import numpy as np

from chronoframe.llm import quality_ftrl
from chronoframe.llm.sample import fitted


class Long(Sequence):
    """Rows of many distinct buckets, made when they are asked for."""

    def __len__(self):
        return 100

    def __getitem__(self, k):
        if k >= len(self):
            raise IndexError
        return k, k % 2, np.arange(k, 100_000 + k, dtype=np.int32)


def test_ftrl_holds_one_vector_at_a_time():
    tracemalloc.start()
    try:
        quality_ftrl.train(Long())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60e6  # the vectors of all rows take 120 MB at least


def test_long_texts_are_not_held_and_rows_come_in_order(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    size, n = quality_ftrl.BUCKETS, 150
    docs = spark.createDataFrame([(k, "x" * (k % 5)) for k in reversed(range(n))], "doc_id long, text string").repartition(3)

    def features(texts):
        """Bucket 7 more often than a packed count can say, and nearly all buckets."""
        each = np.concatenate([np.full(40_000, 7), np.arange(8, size)])
        return np.tile(each, len(texts)), np.repeat(np.arange(len(texts)), len(each))

    def train(rows):
        with open("/proc/self/status") as f:
            held = int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) / 1024
        right = [r[:2] for r in (rows[k] for k in range(len(rows)))] == [(k, k % 2) for k in range(len(rows))]
        u, c = np.unique(rows[len(rows) - 1][2], return_counts=True)
        return np.array([held, right and c[0] == 40_000 and u.tolist() == list(range(7, size)) and c[1:].max() == 1], float)

    def run(k):
        ids = spark.range(k).selectExpr("id AS _id", "CAST(id % 2 AS int) AS _y")
        return fitted(docs, ids, features, train, size)

    spark.conf.set(key, "4")
    try:
        (few, right), (many, also) = run(8), run(n)
    finally:
        spark.conf.set(key, before)
    assert right and also
    assert many - few < 80  # the buckets of all rows take 180 MB


def test_ids_of_other_types(spark):
    rows = [(k, f"good words number {k % 5} here" if k % 2 else f"bad %% text {k % 5} there", k % 2) for k in range(-20, 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")

    def fit(kind):
        some = table.selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text", "quality")
        return quality_ftrl.fit(some.select("doc_id", "text"), some.select("doc_id", "quality"), 1000)

    want = fit("long")
    assert want.any()
    assert np.array_equal(fit("int"), want) and np.array_equal(fit("decimal(20,0)"), want)
    assert fit("string").any()
