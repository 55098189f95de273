import random

import brute
import numpy as np
import pytest

from chronoframe.llm import minmax_dedup as M
from chronoframe.llm.components import components


def chain(n=60, words=120, seed=5):
    """Texts that differ from the one before by a few words, so that a component is long and its ends are far apart."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        base = list(base)
        base[r.randrange(words)] = f"v{r.randrange(10**6)}"
        out.append(" ".join(base))
    return out


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_same_components_as_all_pairs(spark, k, num, monkeypatch):
    monkeypatch.setattr(M, "SMALL", 6)
    monkeypatch.setattr(M, "BLOCK", 10)
    texts = [t for _, t, *_ in brute.awkward(50)] + chain() + ["a b c d e f g h", "A b\tC d e f  g h", "x y", "X y", "x"]
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS key", "1 AS n", "2 AS rep").repartition(3)
    got = {r.doc_id: r for r in M.near_duplicates(docs, k, num, 100).collect()}
    want = brute.components(rows, k, num)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = M.keep(docs, k, num)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c) and kept.columns == docs.columns


def test_blocks_of_one_component_never_meet(spark, monkeypatch):
    """A bucket of one large component, a second one of several blocks, and single members: every link across is found, by few rows."""
    monkeypatch.setattr(M, "BLOCK", 10)
    base = " ".join(f"w{k}" for k in range(60))
    ids = list(range(200)) + list(range(300, 325)) + [400, 401, 402]
    comp = {i: 0 if i < 200 else 300 if i < 400 else i for i in ids}
    same = {7, 310, 401, 402}  # one text of each component, and two single members
    texts = spark.createDataFrame([(i, base if i in same else f"t{i} " * 3 + f"u{i} v{i}") for i in ids], "doc_id long, text string")
    members = spark.createDataFrame([(1, i, comp[i], len(ids)) for i in ids], "key long, id long, comp long, n long")
    links = [(r.u, r.v) for r in M.across_blocks(members, texts, 3, 85, 100).collect()]
    root = {c: c for c in set(comp.values())}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for u, v in links:
        assert {u, v} <= same and comp[u] != comp[v]
        root[find(comp[u])] = find(comp[v])
    assert len({find(comp[i]) for i in same}) == 1 and find(400) not in {find(comp[i]) for i in same}


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (2, None), (9, "A B C D E")], "doc_id long, text string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.component_id, r.kept) for r in M.near_duplicates(docs).collect())
    assert got == [(-1, None, True), (-1, None, True), (2, 2, True), (4, 4, True), (9, 4, False)]
    assert M.near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_one_document(spark):
    base = " ".join(f"w{k}" for k in range(40))
    rows = [(5, base), (5, "quite another text of some words here"), (8, base), (9, "quite another text of some words here"), (3, "alone in this table of texts"), (5, base)]
    for n in (1, 3):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect())
        assert got == [(3, 2, 3), (5, 3, 5), (5, 36, 5), (5, 36, 5), (8, 36, 5), (9, 3, 5)]


def test_keep_beside_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "x y")], "doc_id long, text string").selectExpr("*", "'g' AS _gone", "1 AS _gone_", "2 AS h", "3 AS keys", "4 AS component_id")
    kept = M.keep(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == docs.columns and {r._gone for r in kept.collect()} == {"g"}


def test_components(spark):
    path = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (200, 201), (201, 200), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_signature_values_estimate_similarity():
    r = np.random.default_rng(0)
    a = np.unique(r.integers(0, 1 << 62, 600).astype(np.uint64))
    b = np.unique(np.concatenate([a[:480], r.integers(0, 1 << 62, 120).astype(np.uint64)]))
    x, cut = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    keys = M.signatures(x, cut, 400, 1)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((keys[0] == keys[1]).mean() - true) < 0.08
