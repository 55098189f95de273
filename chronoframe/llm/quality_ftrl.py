"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Features are hashed unigrams and bigrams of sub-words (words cut where letters meet punctuation), with
one shared bucket for a word that repeats the one before it.  A text's vector is its square-rooted
counts scaled to length one; the score is the sigmoid of a sparse dot product with a bounded weight
vector, which is broadcast.  The fit uses at most SAMPLE labelled rows (a documented bound), sought by
the smallest hash of their ids; every document is scored.

Null and empty texts have no features and score the sigmoid of the bias.  Without labels the weights
are 0 and every score is 0.5.  Repeated rows and ties get equal scores.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.kernel import Flat, combine, per_doc
from chronoframe.llm.sample import fitted, sigmoid, training_ids
from chronoframe.llm.storage import fold
from chronoframe.llm.textmap import add_columns, keep_rows

BUCKETS = 1 << 18
#: Labelled rows that the fit uses at most.
SAMPLE = 16_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.1
#: Bucket 0 is the bias, 1 the repeated word.
BIAS, AGAIN, FIRST = 0, 1, 2


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams, and the text of each."""
    flat = Flat(texts, lower=True)
    a, b = flat.subwords()
    h, d = flat.hashes(a, b, seed=5), flat.docs(a)
    same = d[1:] == d[:-1]
    with np.errstate(over="ignore"):
        pairs = combine(h[:-1], h[1:])
    top = np.uint64(64 - BUCKETS.bit_length() + 1)
    f1 = np.maximum((h >> top).astype(np.int64), FIRST)
    f2 = np.maximum((pairs >> top).astype(np.int64), FIRST)
    f2[h[1:] == h[:-1]] = AGAIN
    return np.concatenate([f1, f2[same]]), np.concatenate([d, d[1:][same]])


def vector(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their values."""
    u, c = np.unique(f, return_counts=True)
    x = np.sqrt(c)
    return u, x / np.sqrt(max(1, c.sum()))


def train(rows: Sequence) -> np.ndarray:
    """FTRL-proximal (McMahan et al., 2013) over the rows, in an order fixed by a seed; one row's vector is held at a time."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            _, y, f = rows[k]
            i, x = vector(f)
            i, x = np.append(i, BIAS), np.append(x, 1.0)
            w = weights(i)
            g = (float(sigmoid(np.array(w @ x))) - y) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    return weights(np.arange(BUCKETS))


def scores(w: np.ndarray, texts: list[bytes]) -> np.ndarray:
    f, d = features(texts)
    n = len(texts)
    key = np.sort(d * BUCKETS + f)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    u, c = key[cut], np.diff(np.append(cut, len(key)))
    who = u // BUCKETS
    total = np.maximum(1, np.bincount(d, minlength=n))
    return sigmoid(per_doc(w[u % BUCKETS] * np.sqrt(c), who, n) / np.sqrt(total) + w[BIAS])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from the labelled rows outside the held-out fold."""
    return fitted(docs, training_ids(labels, "quality", sample), features, train, BUCKETS)


def score(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """Every row with held_out, score and predicted; the text doesn't go on."""
    model = docs.sparkSession.sparkContext.broadcast(w)

    def make():
        return lambda texts: {"score": scores(model.value, texts)}

    out = add_columns(docs, make, "score double", drop=("text",))
    return out.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, w: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """The rows that score at least the threshold, whole."""
    model = docs.sparkSession.sparkContext.broadcast(w)
    return keep_rows(docs, lambda: lambda texts: scores(model.value, texts) >= threshold)
