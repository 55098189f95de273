import math
import random
from collections import Counter

import brute
import numpy as np
import plain_lm
import pytest

from chronoframe.llm import lm_score as L
from chronoframe.llm import seating


def tokens(text):
    return [*brute.WORD.findall(brute.lower(text or "")), None]


def pairs(text):
    """(context, word); 0 is a text's start, None its end."""
    x = tokens(text)
    return list(zip([0, *x[:-1]], x))


def test_base_counts_and_scores(spark):
    rows = [(i, t) for i, t, *_ in brute.awkward(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS kind", "'x' AS block").repartition(3)
    got = {r.doc_id: r for r in L.score(docs).collect()}
    train = Counter(x for i, t in rows if brute.crc(i) % 5 != 1 for x in tokens(t))
    n, v = sum(train.values()), len(train)
    assert len(got) == len(rows)
    for i, t in rows:
        r, x = got[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (brute.crc(i) % 5 == 1, len(x), sum(y in train for y in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[y] + 0.5) / (n + 0.5 * (v + 1))) for y in x))
        assert r.score < 0 and math.isfinite(r.score)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lm_")]  # working tables are gone


def test_predictive_probabilities_sum_to_one(spark):
    """Two words that are followed by different words tell them apart, and each context's probabilities sum to one."""
    rows = [(i, f"{'a' if i % 2 else 'b'}same {'left' if i % 2 else 'right'}") for i in range(400)]
    held = [i for i in range(1000, 1500) if brute.crc(i) % 5 == 1]
    types = ["asame", "bsame", "left", "right", "newword"]
    probes = ["", *types, *[f"{a} {b}" for a in types for b in types]]
    got = L.score(spark.createDataFrame(rows + list(zip(held, probes)), "doc_id long, text string")).collect()
    p = {probes[held.index(r.doc_id)]: 10**r.score for r in got if r.doc_id >= 1000}
    # p[a] = P(a | start) P(end | a), p[a b] = P(a | start) P(b | a) P(end | b)
    assert p["asame left"] > 5 * p["asame right"] and p["bsame right"] > 5 * p["bsame left"]
    one, two = np.array([p[a] for a in types]), np.array([[p[f"{a} {b}"] for b in types] for a in types])
    # P(b | a) over all b and P(end | a) sum to one: linear equations in x[a] = 1 / P(end | a)
    x = np.linalg.solve(np.eye(len(types)) - two / one[:, None], np.ones(len(types)))
    assert p[""] + (one * x).sum() == pytest.approx(1, rel=1e-6)


def sampled(texts, held, buckets, burn, samples):
    """The rounds of ``lm_score.score``, with blocks handed over in lists instead of tables."""
    keys, per = L.stream([t.encode() for t in texts])
    text = dict(L.blocks_of([L.Part.of(x) for x in np.array_split(keys, 2)], per, np.array(held), buckets))
    cells = {b: L.Cells.of(L.cells_of([x]).pack()) for b, x in text.items()}
    ups, homes, roots, seats, drawn, sums = {}, {}, {}, {}, [], np.zeros(6)
    for b, x in cells.items():
        for h, blob in L.key_blocks(x, buckets):
            ups.setdefault(h, {})[b] = blob
    for h, blocks in ups.items():
        x, s = L.home_of(blocks)
        homes[h] = L.Home.read(x.pack())
        sums += s
    m = L.model_of(*sums, sum((x.c == 1).sum() for x in cells.values()), sum((x.c == 2).sum() for x in cells.values()))

    def at_homes(k, sweep, keep, last):
        downs, total = {}, 0
        for h, x in homes.items():
            roots[h], out, s = L.home_round(x, roots.get(h), ups[h], m, [k, h], sweep, keep, last)
            total += s[0]
            for b, blob in out.items():
                downs.setdefault(b, {})[h] = blob
        return downs, total

    downs, total = at_homes(0, False, False, False)
    for k in range(1, 1 + burn + samples):
        m, keep, ups, n = m._replace(roots=total), k > burn, {}, 0
        for b, x in cells.items():
            seats[b], out, s = L.leaf_round(x, seats.get(b), downs[b], m, [2 * k, b], buckets, keep)
            n += s[0]
            for h, blob in out.items():
                ups.setdefault(h, {})[b] = blob
        m = m._replace(tables=n)
        downs, total = at_homes(2 * k + 1, not keep, keep, k == burn + samples)
        if keep:
            drawn.append(m._replace(roots=total))
    score = np.zeros(len(texts))
    for b, x in cells.items():
        some, y, *_ = L.unpack(L.Scorer(x, seats[b], downs[b], drawn, buckets).texts(text[b]))
        score[np.cumsum(L.of_planes(some, "<u4"))] += L.of_planes(y, "<f8")
    return m, score


@pytest.mark.parametrize("buckets,many", [(1, 40), (3, 40), (3, 0)])
def test_same_probabilities_as_a_plain_gibbs_sampler(buckets, many, monkeypatch):
    monkeypatch.setattr(seating, "MANY", many)
    r = random.Random(2)
    words = list("abcdefg")

    def sentence():
        out = [r.choice(words)]
        while r.random() < 0.7:
            out.append(words[(int(r.expovariate(1) * 1.5) + words.index(out[-1]) % 3) % 7])
        return " ".join(out)

    train = [sentence() for _ in range(40)]
    probes = ["", *words, "zz", "a b", "b b", "c c", "c d", "a zz", "g a", "zz a"]
    m, score = sampled(train + probes, [False] * len(train) + [True] * len(probes), buckets, 60, 600)
    p = plain_lm.averaged([x for t in train for x in pairs(t)], {x for t in probes for x in pairs(t)}, m.d1, m.d0, L.STRENGTH, m.known, m.unknown, 60, 600)
    want = [sum(math.log10(p[x]) for x in pairs(t)) for t in probes]
    assert np.abs(score[len(train) :] - want).max() < 0.04


@pytest.mark.parametrize("many", [0, 40, 1000])
def test_tables_of_one_dish(many, monkeypatch):
    """P(t) of c customers is in proportion to S(c, t) a(t), with S the generalised Stirling numbers."""
    monkeypatch.setattr(seating, "MANY", many)
    c, d, strength, g = 6, 0.5, 1.0, 0.3
    s = {1: 1.0}
    for n in range(1, c):
        s = {t: s.get(t - 1, 0) + (n - d * t) * s.get(t, 0) for t in range(1, n + 2)}
    weight = {t: s[t] * math.prod((strength + d * k) * g for k in range(t)) for t in s}
    mean = sum(t * w for t, w in weight.items()) / sum(weight.values())
    n = 4000
    seats = seating.Seats(np.full(n, c), np.zeros(n, int), np.zeros(0, int), d, strength, np.arange(n), np.zeros(n), np.arange(n), np.zeros(n), lambda col, above: np.full(len(col), g), [3])
    seats.come()
    for _ in range(8):
        seats.sweep()
    assert abs(seats.used.mean() - mean) < 0.06
    assert (seats.tables == seats.used).all() and (seats.above == seats.used).all()
    assert (np.sort(seats.n.reshape(-1))[::-1].cumsum()[: int(seats.used.sum())][-1]) == n * c


def test_many_keys_are_looked_up_in_ascending_order(monkeypatch):
    """In any other order each lookup misses the cache, which was a sixth of the time of a profile."""
    r = random.Random(5)
    texts = [" ".join(f"w{int(r.expovariate(0.002))}" for _ in range(300)) for _ in range(60)]
    ascending, real = [], np.searchsorted

    def seen(keys, x, *rest, **named):
        if np.size(x) > 1000:
            ascending.append(bool((x[1:] >= x[:-1]).all()))
        return real(keys, x, *rest, **named)

    monkeypatch.setattr(np, "searchsorted", seen)
    sampled(texts, [i % 5 == 0 for i in range(60)], 2, 1, 1)
    assert ascending and all(ascending)


def test_quick_forms_equal_numpys():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 56, 500).astype(np.uint64))
    for x in (r.choice(keys, 2000), np.zeros(0, np.uint64)):
        assert (L.find(keys, x) == np.searchsorted(keys, x)).all()
        assert (L.distinct(x) == np.unique(x)).all()
        for kind in ("<u2", "<u4", "<u8", "<f8"):
            y = x.astype(kind)
            assert (L.of_planes(L.planes(y), kind) == y).all()


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.score(empty).count() == 0
    got = L.score(spark.createDataFrame([(None, "a b"), (None, None), (3, "a"), (3, "a")], "doc_id long, text string")).collect()
    assert sorted(r.n_tokens for r in got) == [1, 2, 2, 3]
