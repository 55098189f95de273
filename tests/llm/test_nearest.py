import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import vptree


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, q in good:
        if i % 5 == 0:
            near = sorted((-float(np.einsum("i,i->", q, x)), j) for j, x in good if j != i)[:k]
            out |= {(i, r + 1, j) for r, (_, j) in enumerate(near)}
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 8)).round(2)
    x[40:60] = x[40]  # ties
    x[100:110] *= 7
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    return rows + [(400, None), (405, [0.0] * 8), (410, [1.0] * 7), (415, [float("nan")] + [1.0] * 7), (420, [None] + [1.0] * 7), (425, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]


def test_factor_one_is_exact(spark, rows, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 90)
    monkeypatch.setattr(vptree, "LEAF", 8)
    monkeypatch.setattr(vptree, "BLOCK", 7)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS shard", "'x' AS v")
    got = vptree.nearest(table, F.col("vec_id") % 5 == 0, k=6, factor=1.0).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == brute(rows, 6)
    twice = vptree.nearest(table.unionByName(table), F.col("vec_id") % 5 == 0, k=6, factor=1.0).collect()
    assert {tuple(r) for r in twice} == {tuple(r) for r in got}


def test_few_candidates_and_empty(spark, rows):
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.rank, r.vec_id) for r in vptree.nearest(few, F.col("vec_id") % 5 == 0, k=6).collect()} == brute(rows[:4], 6)
    assert vptree.nearest(few.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert vptree.nearest(few, F.col("vec_id") < 0).count() == 0


def test_recall_of_the_default_factor():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(3000)
    tree = vptree.Tree(ids, x)
    found, _ = tree.search(ids[:100], x[:100], 20, vptree.FACTOR)
    dots = x[:100] @ x.T
    dots[ids[:100], ids[:100]] = -9
    want = np.argsort(-dots, axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, want)]) >= 0.95


def test_each_length_among_its_own_kind(spark, rows, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 20)
    monkeypatch.setattr(vptree, "LEAF", 8)
    r = np.random.default_rng(6)
    short = [(k, r.normal(size=3).round(2).tolist()) for k in range(1000, 1050)]
    got = vptree.nearest(spark.createDataFrame(rows + short, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, k=6, factor=1.0).collect()
    near = {i: sorted((-float(np.einsum("i,i->", q, x)), j) for j, x in short if j != i)[:6] for i, q in short if i % 5 == 0}
    assert {(x.query_id, x.rank, x.vec_id) for x in got} == brute(rows, 6) | {(i, n + 1, j) for i, found in near.items() for n, (_, j) in enumerate(found)}


def test_recall_through_the_operator_at_the_default_factor(spark):
    """The production factor and shards of the usual size, against brute force over all rows."""
    r = np.random.default_rng(11)
    centres = r.normal(size=(40, 32))
    x = centres[r.integers(0, 40, 9000)] + 0.5 * r.normal(size=(9000, 32))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in vptree.nearest(table, F.col("vec_id") % 50 == 0, k=20).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id, row.score))
    asked = np.arange(0, 9000, 50)
    dots = x[asked] @ x.T
    dots[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-dots, axis=1)[:, :20]
    assert sorted(got) == asked.tolist() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for _, i, _ in got[q]} & set(w.tolist())) / 20 for q, w in zip(asked.tolist(), want, strict=True)])
    assert recall >= 0.9
    for q, row in zip(asked.tolist(), dots, strict=True):
        ranked = sorted(got[q])
        assert [s for _, _, s in ranked] == sorted((s for _, _, s in ranked), reverse=True) and all(abs(row[i] - s) < 1e-9 for _, i, s in ranked)
