"""Nearest neighbours by inner product, with a vantage-point tree in every shard.

Vectors are dealt into shards of about SHARD_ROWS rows by a hash of their id.  Within a shard each
vector x becomes (x, sqrt(M^2 - |x|^2)) for the shard's largest norm M, so that the nearest in the
Euclidean metric are those of the largest inner product.  A tree node holds a vantage point and the
median distance to it; a query goes to its own side first, and to the other side unless

    |d(query, vantage) - median| > factor * (distance of the worst neighbour found so far)

With factor 1 that is the triangle inequality and the search is exact; a smaller factor visits less.
Queries are searched in blocks, by numpy, through every shard: a shard's rows come to its task sorted
before the query blocks, so a task holds one shard and one block at a time.

Vectors of each length have shards of their own and are neighbours of each other only.  Vectors that are
null, zero, or hold null or non-finite components take no part.  Ties go to the smaller vec_id; rows of equal vec_id are one candidate (any of them).  An empty
table, or one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.storage import partitions

SHARD_ROWS, BLOCK, LEAF = 4096, 512, 128
#: Recall against brute force is measured in the tests and given in the README.
FACTOR = 0.4


class Tree:
    """A vantage-point tree over the rows of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.x = ids, vectors
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.top = float(norms.max()) if len(norms) else 0.0
        self.last = np.sqrt(np.maximum(0.0, self.top - norms))
        self.leaf = leaf
        self.root = self._build(np.arange(len(ids)))

    def _between(self, p: int, rows: np.ndarray) -> np.ndarray:
        """Distances between rows of the shard."""
        gap = self.x[rows] - self.x[p]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap) + (self.last[rows] - self.last[p]) ** 2)

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        p = int(rows[0])
        d = self._between(p, rows)
        by = np.argsort(d, kind="stable")
        half = len(rows) // 2
        if d[by[0]] == d[by[-1]]:  # all at one distance: nothing to tell them apart by
            return p, float(d[by[0]]), self._build(rows[:half]) if half <= self.leaf else rows[:half], rows[half:]
        return p, float(d[by[half]]), self._build(rows[by[:half]]), self._build(rows[by[half:]])

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the k nearest of each query, best first; -1 where there are fewer."""
        n = len(q_ids)
        self.visited = 0
        score, found = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        q_norm = np.einsum("ij,ij->i", q, q)

        def bound(some: np.ndarray) -> np.ndarray:
            """Distance of the worst neighbour so far."""
            worst = score[some, -1]
            return np.where(np.isinf(worst), np.inf, np.sqrt(np.maximum(0.0, q_norm[some] + self.top - 2 * np.where(np.isinf(worst), 0, worst))))

        def visit(node, some: np.ndarray) -> None:
            if not len(some):
                return
            if isinstance(node, np.ndarray):
                for at in range(0, len(node), 4 * self.leaf):
                    look(node[at : at + 4 * self.leaf], some)
                return
            p, middle, inner, outer = node
            dot = np.einsum("ij,j->i", q[some], self.x[p])
            d = np.sqrt(np.maximum(0.0, q_norm[some] + self.top - 2 * dot))
            near = d < middle
            visit(inner, some[near])
            visit(outer, some[~near])
            across = np.abs(d - middle) <= factor * bound(some)
            visit(outer, some[near & across])
            visit(inner, some[~near & across])

        def look(rows: np.ndarray, some: np.ndarray) -> None:
            self.visited += len(rows) * len(some)
            # einsum sums each pair alike, so equal vectors get equal scores
            dots = np.einsum("ij,kj->ik", q[some], self.x[rows])
            names = self.ids[rows]
            dots[q_ids[some][:, None] == names[None, :]] = -np.inf
            better = np.flatnonzero((dots >= score[some, -1:]).any(1))
            if not len(better):
                return
            some, dots = some[better], dots[better]
            s = np.concatenate([score[some], dots], 1)
            i = np.concatenate([found[some], np.broadcast_to(names, dots.shape)], 1)
            i = np.where(np.isinf(s), np.iinfo(np.int64).max, i)
            by = np.lexsort((i, -s), axis=1)[:, :k]
            score[some], i = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)
            found[some] = np.where(np.isinf(score[some]), -1, i)

        if len(self.ids):
            visit(self.root, np.arange(n))
        return found, score


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part, in double precision."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    return rows


def nearest(vectors: DataFrame, is_query, k: int = 20, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``is_query`` (a condition on vec_id) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    sizes = sorted((r["n"], r["count"]) for r in rows.groupBy(F.size("v").alias("n")).count().collect())  # a row for each length that occurs
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kinds, shards = [], 0
    for n, count in sizes:
        own = -(-count // SHARD_ROWS)
        kinds.append((n, shards, own, -(-count // (20 * BLOCK))))
        shards += own
    kinds = F.broadcast(spark.createDataFrame(kinds, "n int, first int, shards int, blocks int"))
    rows = rows.withColumn("n", F.size("v")).join(kinds, "n").select("vec_id", "v", "first", "shards", "blocks")
    shard = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("shards"))).cast("int").alias("shard")
    candidates = rows.select(shard, F.lit(-1).alias("block"), "vec_id", "v")
    block = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("blocks")).cast("int").alias("block")
    asked = rows.where(is_query).dropDuplicates(["vec_id"])
    asked = asked.select(F.explode(F.sequence("first", F.expr("first + shards - 1"))).alias("shard"), block, "vec_id", "v")
    dealt = candidates.unionByName(asked).repartition(max(shards, min(shards * 2, partitions(spark))), "shard").sortWithinPartitions("shard", "block", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None

        def finished(key, ids, vs):
            nonlocal tree
            ids, vs = np.concatenate(ids), np.concatenate(vs)
            if key[1] == -1:
                first = np.unique(ids, return_index=True)[1]
                # vantage points come in a shuffled order fixed by the ids
                ids, vs = ids[first], vs[first]
                order = np.random.default_rng(key[0]).permutation(len(ids))
                tree = (key[0], Tree(ids[order], vs[order]))
                return
            if tree is None or tree[0] != key[0]:
                return
            for a in range(0, len(ids), BLOCK):
                found, score = tree[1].search(ids[a : a + BLOCK], vs[a : a + BLOCK], k, factor)
                ok = found >= 0
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a : a + BLOCK], ok.sum(1))), pa.array(found[ok]), pa.array(score[ok])], names=["query_id", "vec_id", "score"])

        ids, vs = [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("shard", "block")], 1)
            names = batch.column("vec_id").to_numpy()
            values, at = batch.column("v").flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("v")).to_numpy())])
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                key = tuple(keys[a].tolist())
                if now is not None and key != now:
                    yield from finished(now, ids, vs) or ()
                    ids, vs = [], []
                now = key
                ids.append(names[a:b])
                vs.append(values[at[a] : at[b]].reshape(b - a, -1))
        if now is not None:
            yield from finished(now, ids, vs) or ()

    near = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
