"""Toxicity: non-negative positive-unlabelled learning of a linear classifier.

The fit sees confirmed toxic rows (P) and rows whose label is not looked at (U), and minimises the
class-prior-corrected risk of Kiryo et al. (2017): pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)).  When
the corrected negative part falls under zero, the step ascends on it alone.  The prior pi is the share
of confirmed rows among the labelled rows of the training folds.  Features are hashed presences of
sub-words and of their first five, six and seven bytes; weights are kept sparse by a proximal L1 step.
The fit uses at most SAMPLE labelled rows (a documented bound); every document is scored.

A text's score is the highest of its windows of WINDOW sub-words, so that a few toxic words in a long
text aren't outweighed by the many common ones around them.

Null and empty texts score the sigmoid of the bias.  Without confirmed rows all weights are 0 but the
bias, which makes every score low.  Repeated rows and ties get equal scores.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.kernel import Flat, per_doc
from chronoframe.llm.sample import fitted, sigmoid, training_ids
from chronoframe.llm.storage import fold
from chronoframe.llm.textmap import add_columns

BUCKETS = 1 << 18
#: Labelled rows that the fit uses at most.
SAMPLE = 16_000
THRESHOLD = 0.7
#: Sub-words of a window.
WINDOW = 128
EPOCHS, BATCH, RATE = 30, 256, 0.5
#: The L1 penalty is this over the square root of the sample's rows, as the noise of gradients is.
PENALTY = 0.01
#: Where the sums of squared gradients start, so that a bucket's first steps are small.
SQUARES = 1e-3
#: Buckets found in fewer documents of the sample get no weight.
MIN_DOCS = 3
BIAS, FIRST = 0, 1
PREFIXES = (5, 6, 7)


def _buckets(flat: Flat, begins: np.ndarray, ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the sub-words in each group ``of`` and the group of each."""
    hs, gs = [flat.hashes(begins, ends, seed=7)], [of]
    for k in PREFIXES:
        long = ends - begins > k
        hs.append(flat.hashes(begins[long], begins[long] + k, seed=8 + k))
        gs.append(of[long])
    top = np.uint64(64 - BUCKETS.bit_length() + 1)
    f = np.maximum((np.concatenate(hs) >> top).astype(np.int64), FIRST)
    key = np.sort(np.concatenate(gs) * BUCKETS + f)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key % BUCKETS, key // BUCKETS


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets by text, and the text of each."""
    flat = Flat(texts, lower=True)
    a, b = flat.subwords()
    return _buckets(flat, a, b, flat.docs(a))


def gradient(w: np.ndarray, positive: list, unlabelled: list, prior: float) -> np.ndarray:
    """Of the non-negative risk; where the negative part is under zero, of its opposite alone, so that it rises again."""

    def parts(docs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f, d = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(x) for x in docs])
        return f, d, np.bincount(d, weights=w[f], minlength=len(docs)) + w[BIAS]

    def summed(f: np.ndarray, d: np.ndarray, by_doc: np.ndarray) -> np.ndarray:
        g = np.bincount(f, weights=by_doc[d], minlength=BUCKETS)
        g[BIAS] = by_doc.sum()
        return g

    pf, pd, pz = parts(positive)
    uf, ud, uz = parts(unlabelled)
    # the logistic loss of +1 is log(1 + exp(-z)), of -1 log(1 + exp(z))
    negative = np.logaddexp(0, uz).mean() - prior * np.logaddexp(0, pz).mean()
    p_neg, u_neg = prior * sigmoid(pz) / len(pz), sigmoid(uz) / len(uz)
    if negative >= 0:
        return summed(pf, pd, prior * (sigmoid(pz) - 1) / len(pz) - p_neg) + summed(uf, ud, u_neg)
    return summed(pf, pd, p_neg) - summed(uf, ud, u_neg)


def train(rows: Sequence) -> np.ndarray:
    """Minibatches of P and U together; Adagrad steps; the averaged weights of the last third."""
    w, g2 = np.zeros(BUCKETS), np.full(BUCKETS, SQUARES)
    w[BIAS] = -2.0
    rows = list(rows)
    positive = [f for _, y, f in rows if y == 1]
    unlabelled = [f for _, _, f in rows]
    if not positive:
        w[BIAS] = -4.0
        return w
    prior = len(positive) / len(rows)
    l1 = PENALTY / np.sqrt(len(rows))
    rare = np.bincount(np.concatenate(unlabelled), minlength=BUCKETS) < MIN_DOCS
    rare[BIAS] = False
    steps = max(1, -(-len(unlabelled) // BATCH))
    per = max(1, -(-len(positive) // steps))
    total, taken = np.zeros(BUCKETS), 0

    for epoch in range(EPOCHS):
        r = np.random.default_rng(epoch)
        p_order, u_order = r.permutation(len(positive)), r.permutation(len(unlabelled))
        for k in range(steps):
            ps = [positive[i] for i in p_order[np.arange(k * per, (k + 1) * per) % len(positive)]]
            us = [unlabelled[i] for i in u_order[k * BATCH : (k + 1) * BATCH]]
            g = gradient(w, ps, us, prior)
            g[rare] = 0
            g2 += g * g
            step = RATE / np.sqrt(g2)
            w -= step * g
            bias = w[BIAS]
            w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1 * (g2 > SQUARES))
            w[BIAS] = bias
            if 3 * epoch >= 2 * EPOCHS:
                total += w
                taken += 1
    return total / max(1, taken)


def scores(w: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The highest score of a text's windows, which cover all of it; a text without sub-words has one empty window."""
    flat = Flat(texts, lower=True)
    a, b = flat.subwords()
    d = flat.docs(a)
    per = np.bincount(d, minlength=len(texts))
    windows = np.maximum(1, -(-per // WINDOW))
    first = np.cumsum(windows) - windows
    place = np.arange(len(d)) - (np.cumsum(per) - per)[d]
    f, of = _buckets(flat, a, b, first[d] + place // WINDOW)
    z = per_doc(w[f], of, int(windows.sum()))
    return sigmoid(np.maximum.reduceat(z, first) + w[BIAS]) if len(texts) else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from the labelled rows outside the held-out fold."""
    return fitted(docs, training_ids(labels, "toxic", sample), features, train, BUCKETS)


def score(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """Every row with held_out, score and predicted; the text doesn't go on."""
    model = docs.sparkSession.sparkContext.broadcast(w)

    def make():
        return lambda texts: {"score": scores(model.value, texts)}

    out = add_columns(docs, make, "score double", drop=("text",))
    return out.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
