"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two multinomials over 2**16 hashed buckets of sub-word unigrams and bigrams are counted over all
rows: one from every document, one from the documents that are trusted.  A document's verdict is
the mean over its n-grams of log p_target - log p_raw, held against one fixed threshold; nothing is
drawn at random.  Rules on plain counts come first: too few words, or too much repetition.

Null and empty texts have no words, so the base rules reject them (score 0).  With no trusted
document, or an empty table, all ratios are 0 and only the base rules decide.  Rows are judged one
by one, so repeated rows and ties get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.kernel import Flat, binary_list, combine, mix, per_doc, slices
from chronoframe.llm.storage import small_batches
from chronoframe.llm.textmap import add_columns, keep_rows

BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Mean log ratio (natural log) under which a document is rejected.
THRESHOLD = -0.10
MIN_WORDS = 50
#: Trusted ids that are broadcast (some 16 MB); with more of them the texts are shuffled to them.
BROADCAST_IDS = 500_000
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the sub-word unigrams and bigrams, and the text of each."""
    flat = Flat(texts, lower=True)
    a, b = flat.subwords()
    h, d = flat.hashes(a, b, seed=3), flat.docs(a)
    same = d[1:] == d[:-1]
    with np.errstate(over="ignore"):
        pairs = combine(h[:-1], h[1:])[same]
    top = np.uint64(64 - BUCKETS.bit_length() + 1)
    return (np.concatenate([h, pairs]) >> top).astype(np.int64), np.concatenate([d, d[1:][same]])


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Log ratio of each bucket.  ``trusted`` holds the doc_ids of the target's documents; both tables are counted whole.

    Each task sends one row for each bucket it has seen, so the shuffle doesn't depend on how often an
    n-gram occurs; the driver gets BUCKETS rows.
    """
    small_batches(docs.sparkSession)
    ids = trusted.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_t")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if few else ids.hint("shuffle_hash")
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_t"), "left")
    marked = marked.select("text", F.col("_t").isNotNull().alias("_t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            texts, mark = binary_list(batch.column("text")), np.array(batch.column("_t").to_pylist(), bool)
            for a, b in slices(texts):
                f, d = features(texts[a:b])
                total[0] += np.bincount(f, minlength=BUCKETS)
                total[1] += np.bincount(f[mark[a:b][d]], minlength=BUCKETS)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], names=["bucket", "raw", "target"])

    rows = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    total = np.zeros((2, BUCKETS))
    total[:, rows["bucket"].to_numpy(np.int64)] = rows[["raw", "target"]].to_numpy(np.float64).T
    if not total[1].sum():
        return np.zeros(BUCKETS)
    p = np.log(total + SMOOTHING) - np.log(total.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    return p[1] - p[0]


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The plain counts by text; see the contract of op10."""
    flat = Flat(texts)
    n = flat.n
    a, b = flat.words()
    d = flat.docs(a)
    h = flat.hashes(a, b)
    n_words = np.bincount(d, minlength=n)
    chars = per_doc(flat.points(a, b), d, n).astype(np.int64)
    marks = np.flatnonzero(_IS_SYMBOL[flat.bytes[:-8]])
    symbols = np.bincount(flat.docs(marks), minlength=n)
    # lines: those of the joined buffer, as every text ends with a line feed
    stop = np.flatnonzero(flat.bytes[:-8] == 10)
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    some = np.searchsorted(a, stop) > np.searchsorted(a, start)
    start, stop = start[some], stop[some]
    ld = flat.docs(start)
    with np.errstate(over="ignore"):
        dup_lines = np.bincount(ld[repeats(flat.hashes(start, stop), ld)], minlength=n)
        covered = np.zeros(len(h), bool)
        if len(h) >= 3:
            x = combine(combine(h[:-2], h[1:-1]), h[2:])
            ok = np.flatnonzero(d[:-2] == d[2:])
            twice = ok[repeats(x[ok], d[ok], first=True)]
            for j in range(3):
                covered[twice + j] = True
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(d[covered], minlength=n)}


def repeats(h: np.ndarray, docs: np.ndarray, first: bool = False) -> np.ndarray:
    """Positions whose hash occurs earlier in the same text; with ``first``, all positions of such hashes."""
    x = h ^ mix(docs.astype(np.uint64) + np.uint64(1))
    order = np.argsort(x, kind="stable")
    same = x[order][1:] == x[order][:-1]
    out = np.zeros(len(x), bool)
    out[order[1:][same]] = True
    if first:
        out[order[:-1][same]] = True
    return np.flatnonzero(out)


def verdicts(ratios: np.ndarray, threshold: float = THRESHOLD):
    """The function from texts to counts, score and verdict."""

    def run(texts: list[bytes]) -> dict[str, np.ndarray]:
        out = base_counts(texts)
        f, d = features(texts)
        n = np.bincount(d, minlength=len(texts))
        score = per_doc(ratios[f], d, len(texts)) / np.maximum(n, 1)
        failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
        return out | {"base_failed": failed, "llr": score, "kept": ~failed & (score >= threshold)}

    return run


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Every row with its counts, score and verdict; the text doesn't go on."""
    model = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS doubles
    return add_columns(docs, lambda: verdicts(model.value, threshold), COLUMNS, drop=("text",))


def keep(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the rules keep, whole."""
    model = docs.sparkSession.sparkContext.broadcast(ratios)

    def make():
        run = verdicts(model.value, threshold)
        return lambda texts: run(texts)["kept"]

    return keep_rows(docs, make)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The documents that ``labels`` marks as good."""
    return labels.where(F.col("quality") == 1).select("doc_id")
