"""MinHash near-dedup with min-max hashing.

A document's set holds the hashes of its distinct k-word shingles.  Under each of PERMUTATIONS hash
functions the signature keeps both the smallest and the largest value (Ji et al., 2013: the pair is an
unbiased estimate of lower variance for half the hash evaluations), and bands of ROWS values are the
keys under which documents meet.

1. Documents of equal sets form classes; only the smallest doc_id of a class goes on.
2. In each band bucket, every member is paired with the bucket's smallest id, and the pair is confirmed
   on the full sets.  This links nearly everything, with as many pairs as there are members.
3. Buckets whose members then lie in more than one component are gone through again: small ones by
   their pairs across components, large ones in pairs of blocks of different components, each in a
   group of its own that skips members already connected.  So every two documents that share a band are either
   confirmed, refused, or known to be connected.
4. Components come from large-star and small-star steps.

No group is gathered in one task, and no bucket's pairs are all emitted.  A pair at the threshold
shares no band with probability (1 - s**ROWS)**BANDS, see ``bands_for``.

Documents without words (null or empty) have an empty set and are linked with nothing; null ids are linked
with nothing and keep component null.  Rows that share a doc_id are one document, so their classes are in one
component; the row of the smallest set (by size, then hashes) is compared with others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.components import components
from chronoframe.llm.kernel import SLICE_BYTES, binary_list, combine, mix, shingles, slices, tokens
from chronoframe.llm.storage import fresh, partitions, small_batches, written

ROWS = 4
#: Bands are as many as keep the chance of missing a pair at the threshold under this.
MISS = 2e-6
#: Members up to which a mixed bucket is gone through pair by pair, and members of a block beyond.
SMALL, BLOCK = 24, 256
#: Shares that the rows of one class, or of one component of a bucket, are dealt into.
SALTS = 8


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed; even the pair's two values of a permutation go to different bands."""
    return max(2, math.ceil(math.log(miss) / math.log(1 - similarity**rows)))


def signatures(x: np.ndarray, cut: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """Band keys by text (texts x bands) of the shingle sets x[cut[i]:cut[i + 1]], none of them empty."""
    n = len(cut) - 1
    values = bands * rows
    half = -(-values // 2)
    sig = np.empty((2 * half, n), np.uint64)
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, half + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for k in range(half):
            y = mix(x ^ seeds[k])
            sig[k] = np.minimum.reduceat(y, cut[:-1])
            sig[half + k] = np.maximum.reduceat(y, cut[:-1])
        keys = np.empty((n, bands), np.uint64)
        for b in range(bands):
            h = np.full(n, b + 1, np.uint64)
            for r in range(rows):
                h = combine(h, sig[b * rows + r])
            keys[:, b] = h
    return keys


def sets_of(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    h, d, flat = tokens(texts)
    return shingles(h, d, flat.n, k)


def sketch(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, keys, h): the set's size, its 128-bit fingerprint and its band keys, and the text's hash."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = binary_list(batch.column("text")), batch.column("doc_id")
            for a, b in slices(texts, SLICE_BYTES // 2):
                x, cut = sets_of(texts[a:b], k)
                n = np.diff(cut)
                some = np.flatnonzero(n)
                keys: list = [None] * (b - a)
                f = np.zeros((2, b - a), np.uint64)
                if len(some):
                    for i, row in zip(some.tolist(), signatures(x, np.append(cut[:-1][some], len(x)), bands).view(np.int64).tolist(), strict=True):
                        keys[i] = row
                    with np.errstate(over="ignore"):
                        f[0, some] = np.add.reduceat(mix(x + np.uint64(1)), cut[:-1][some])
                        f[1, some] = np.add.reduceat(mix(x + np.uint64(2)), cut[:-1][some])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), pa.array(keys, pa.list_(pa.int64())), batch.column("h").slice(a, b - a)],
                    names=["doc_id", "n_shingles", "f1", "f2", "keys", "h"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, h long")


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |a & b| >= num * |a | b| for sorted distinct hashes."""
    low, high = sorted((len(a), len(b)))
    if den * low < num * high:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return den * both >= num * (low + high - both)


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough; ``texts`` has a row for each id at most."""
    left = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv"))
    right = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu"))
    joined = pairs.join(left, "v").join(right, "u").select("u", "v", "tu", "tv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tu, tv = binary_list(batch.column("tu")), binary_list(batch.column("tv"))
            u, v = batch.column("u"), batch.column("v")
            for a, b in slices([x + y for x, y in zip(tu, tv, strict=True)]):
                x, cut = sets_of(tu[a:b] + tv[a:b], k)
                n = b - a
                ok = [similar(x[cut[i] : cut[i + 1]], x[cut[n + i] : cut[n + i + 1]], num, den) for i in range(n)]
                ok = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([u.slice(a, n).filter(ok), v.slice(a, n).filter(ok)], names=["u", "v"])

    return joined.mapInArrow(run, "u long, v long")


def across_blocks(members: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links between members of different components in large mixed buckets.

    ``members`` has (key, id, comp, n).  In each bucket, a component of BLOCK members or more is dealt by a
    hash into blocks of its own, which never meet each other; the other components share blocks.  Each
    other pair of blocks is a task's group of at most about 2 * BLOCK texts.  So where nearly all members
    of a bucket are connected already, rows grow with the bucket, not with its square.
    """
    parts = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).withColumn("lone", F.col("m") >= BLOCK)
    parts = parts.withColumn("own", F.when(F.col("lone"), F.col("comp")).otherwise(F.lit(0)))
    groups = parts.groupBy("key", "lone", "own").agg(F.ceil(F.sum("m") / BLOCK).cast("int").alias("blocks"))
    before = Window.partitionBy("key").orderBy("lone", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.withColumn("first", (F.sum("blocks").over(before) - F.col("blocks")).cast("int"))
    groups = groups.withColumn("total", F.sum("blocks").over(Window.partitionBy("key")).cast("int"))
    # a component can hold nearly all members of a bucket, so members are dealt with a salt
    layout = parts.join(groups, ["key", "lone", "own"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    layout = layout.select("key", "comp", "salt", "lone", "first", "blocks", "total")
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SALTS)).cast("int")).join(layout, ["key", "comp", "salt"])
    dealt = dealt.withColumn("mine", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda b: ~F.col("lone") | (b < F.col("first")) | (b >= F.col("first") + F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(others)).select("key", "id", "comp", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    dealt = dealt.join(texts.select(F.col("doc_id").alias("id"), "text"), "id")

    def run(table: pa.Table) -> pa.Table:
        ids, comp, mine = (table.column(c).to_numpy() for c in ("id", "comp", "mine"))
        i = table.column("i")[0].as_py()
        texts_, sets = binary_list(table.column("text")), []
        for a, b in slices(texts_):
            x, cut = sets_of(texts_[a:b], k)
            sets += [x[cut[t] : cut[t + 1]] for t in range(b - a)]
        root = {c: c for c in set(comp.tolist())}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        first = [t for t in range(len(ids)) if mine[t] == i]
        second = first if same else [t for t in range(len(ids)) if mine[t] != i]
        out: list[tuple[int, int]] = []
        for s in first:
            for t in second:
                if same and t <= s:
                    continue
                x, y = find(int(comp[s])), find(int(comp[t]))
                if x != y and similar(sets[s], sets[t], num, den):
                    root[x] = y
                    out.append((int(ids[s]), int(ids[t])))
        return pa.table([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], names=["u", "v"])

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    spark = docs.sparkSession
    bands = bands or bands_for(num / den)
    found = written(sketch(docs, k, bands), "sketches")
    named = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(named.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    # the representatives' band keys: doc_id is its class's smallest
    leaders_rows = named.join(classes.select(F.col("rep")), F.col("doc_id") == F.col("rep"), "left_semi")
    one = leaders_rows.groupBy("doc_id").agg(F.min_by(F.struct("keys", "h"), F.struct("n_shingles", "f1", "f2", "h")).alias("r"))
    keys = one.select(F.col("doc_id").alias("id"), "r.h", F.explode("r.keys").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(keys.join(leaders, "key"), "buckets")  # key, id, h, leader, n
    ids = met.select(F.col("id").alias("doc_id"), "h").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).join(ids.hint("shuffle_hash"), ["doc_id", "h"], "left_semi")
    texts = written(texts.dropDuplicates(["doc_id"]).select("doc_id", "text").repartition(partitions(spark), "doc_id"), "candidates")
    stars = met.where("id <> leader").select(F.col("leader").alias("u"), F.col("id").alias("v")).distinct()
    links = written(confirmed(stars, texts, k, num, den), "links")
    comps = written(components(links), "components")

    # buckets that still hold more than one component
    where = met.join(comps, F.col("id") == F.col("node"), "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp"))
    mixed = where.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    mixed = written(where.join(mixed, "key"), "mixed")
    few = mixed.where(F.col("n") <= SMALL).select("key", "id", "comp")
    twin = few.select("key", F.col("id").alias("v"), F.col("comp").alias("comp_v"))
    pairs = few.join(twin, "key").where("id < v AND comp <> comp_v").select(F.col("id").alias("u"), "v").distinct()
    pairs = pairs.join(stars, ["u", "v"], "left_anti")
    more = confirmed(pairs, texts, k, num, den).unionByName(across_blocks(mixed.where(F.col("n") > SMALL), texts, k, num, den))
    more = written(more, "more-links")
    if more.limit(1).count():
        comps = written(merged(comps, more), "components")

    of_class = classes.join(comps, F.col("rep") == F.col("node"), "left").select(F.col("n_shingles").alias("_n"), F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), F.coalesce("component", "rep").alias("_c"))
    return _labelled(found, of_class)


def merged(comps: DataFrame, more: DataFrame) -> DataFrame:
    """The components (node, component) after more links (u, v): only components are linked, which are far fewer than nodes."""
    of_u = comps.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    of_v = comps.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    ends = more.join(of_u, "u", "left").join(of_v, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    joined = written(components(ends), "merged").select(F.col("node").alias("_old"), F.col("component").alias("_new"))
    old = comps.join(joined, F.col("component") == F.col("_old"), "left").select("node", F.coalesce("_new", "component").alias("component"))
    # nodes that had no link before are their own component
    fresh = joined.select(F.col("_old").alias("node"), F.col("_new").alias("component")).join(comps, "node", "left_anti").select("node", "component")
    return old.unionByName(fresh)


def _labelled(found: DataFrame, of_class: DataFrame) -> DataFrame:
    """Puts each class's component on its documents.

    A class can hold a third of all documents, so documents are dealt with a salt, and classes, of which
    each is one row, are repeated for every salt.
    """
    left = found.select("doc_id", "n_shingles", "f1", "f2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("_s"))
    right = of_class.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    on = [left["n_shingles"] == right["_n"], left["f1"] == right["_f1"], left["f2"] == right["_f2"], left["_s"] == right["_s"]]
    # a document without a set, or without an id, is its own component
    out = left.join(right, on, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("_c")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, whole: one of each component."""
    name = fresh("_gone", docs.columns)
    gone = near_duplicates(docs, k, num, den).where("NOT kept").select(F.col("doc_id").alias(name))
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(name), "left_anti")
