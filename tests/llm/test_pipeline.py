import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from chronoframe.llm import quality_ftrl, quality_rules, storage
from chronoframe.llm.kernel import Flat, combine
from chronoframe.llm.unit_codes import WordCodes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    r = random.Random(6)
    line = lambda junk: " ".join(f"w{r.randrange(400)}" + "%%%" * junk for _ in range(12))
    shared = [line(0) for _ in range(5)]
    texts = [None, "", "too short", "again and " * 60]
    while len(texts) < 160:
        junk = len(texts) % 8 == 0
        texts.append("\n".join(r.choice(shared) if r.random() < 0.2 and not junk else line(junk) for _ in range(10)))
    texts += texts[20:30] + [x.replace("w1 ", "w2 ") + " end" for x in texts[41:47]]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, brute.SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("%%%" not in (t or "%%%")), 0) for i, t, *_ in rows if i % 4]
    labels += [(i, int("%%%" not in (t or "%%%")), 0) for i, t, *_ in rows if i % 8 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def buckets_of(text, seed, n):
    """Buckets of the sub-words of a text and of their pairs, one by one."""
    found = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", (text or "").encode().lower())
    flat = Flat(found)
    h = flat.hashes(flat.bounds[:-1], flat.bounds[1:] - 1, seed=seed)
    with np.errstate(over="ignore"):
        pairs = combine(h[:-1], h[1:])
    shift = 64 - n.bit_length() + 1
    return [int(x) >> shift for x in h.tolist()], [int(x) >> shift for x in pairs.tolist()], h.tolist()


def kept_by_rules(before, labels):
    """Documents that pass the base rules and whose mean log ratio isn't under the threshold."""
    n, smooth = quality_rules.BUCKETS, quality_rules.SMOOTHING
    trusted = {i for i, quality, _ in labels if quality == 1}
    grams = {i: sum(buckets_of(r.text, 3, n)[:2], []) for i, r in before.items()}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        target.update(g if i in trusted else ())
    a, b = (sum(x.values()) + smooth * n for x in (target, raw))
    out = set()
    for i, r in before.items():
        words = brute.WORD.findall(r.text or "")
        windows = list(zip(words, words[1:], words[2:]))
        times = Counter(windows)
        repeated = len({j + k for j, w in enumerate(windows) if times[w] > 1 for k in range(3)})
        if len(words) >= 50 and 100 * repeated <= 50 * len(words):
            mean = sum(math.log((target[k] + smooth) / a) - math.log((raw[k] + smooth) / b) for k in grams[i]) / len(grams[i])
            if mean >= quality_rules.THRESHOLD:
                out.add(i)
    return out


def kept_by_classifier(before, everything, labels):
    """Documents that a plain logistic regression, fitted by plain updates on the labelled raw documents, scores at least one half."""
    q = quality_ftrl

    def vector(text):
        f1, f2, h = buckets_of(text, 5, q.BUCKETS)
        f = [max(k, q.FIRST) for k in f1] + [q.AGAIN if x == y else max(k, q.FIRST) for k, x, y in zip(f2, h, h[1:])]
        return {k: math.sqrt(c / max(1, len(f))) for k, c in Counter(f).items()} | {q.BIAS: 1.0}

    marks = {}
    for i, quality, _ in labels:
        marks.setdefault(i, set()).add(quality)
    rows = [(i, next(iter(y))) for i, y in sorted(marks.items()) if len(y) == 1 and brute.crc(i) % 3 != 1 and i in everything]
    vectors = {i: vector(everything[i].text) for i, _ in rows}
    z, n = Counter(), Counter()

    def weight(k):
        return 0.0 if abs(z[k]) <= q.L1 else -(z[k] - math.copysign(q.L1, z[k])) / ((q.BETA + math.sqrt(n[k])) / q.ALPHA + q.L2)

    def p(x):
        return 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))

    for epoch in range(q.EPOCHS):
        for j in np.random.default_rng(epoch).permutation(len(rows)):
            i, y = rows[j]
            x = vectors[i]
            w, g0 = {k: weight(k) for k in x}, p(x) - y
            for k, v in x.items():
                g = g0 * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / q.ALPHA * w[k]
                n[k] += g * g
    return {i for i, r in before.items() if p(vector(r.text)) >= 0.5}


def best_fit(sizes, capacity):
    """Sequences of plain best fit, larger pieces first."""
    free = []
    for x in sorted(sizes, reverse=True):
        room = [f for f in free if f >= x]
        if room:
            free.remove(min(room))
        free.append((min(room) if room else capacity) - x)
    return len(free)


def test_each_stage_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    everything = {r.doc_id: r for r in docs.collect()}
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in out.collect()}
        got = stage(spark, out, folder).cache()
        if name != "best-fit packing":
            assert got.dtypes == docs.dtypes
            after = {r.doc_id: r for r in got.collect()}
        if name == "quality rules":
            assert set(after) == kept_by_rules(before, labels)
            assert all(after[i] == before[i] for i in after)
        elif name == "quality classifier":
            assert set(after) == kept_by_classifier(before, everything, labels)
        elif name == "line dedup":
            want = brute.line_dedup([(i, r.text) for i, r in before.items()])
            assert {i: r.text for i, r in after.items()} == {i: v[2] for i, v in want.items()}
            assert all(r.n_chars is None or r.n_chars == len(r.text) for r in after.values())
        elif name == "MinHash near-dedup":
            want = brute.components([(i, r.text) for i, r in before.items()], 5, 80)
            assert set(after) == {i for i, (_, c) in want.items() if i == c}
        else:
            tokenizer, want, bins = WordCodes(P.path("word_bpe_49k.json")), [], {}
            for i, r in before.items():
                x = np.append(tokenizer.direct([(r.text or "").encode()])[0], np.uint32(0)).astype("<u4")
                want += [(i, k, a, len(x[a : a + 2048]), zlib.crc32(x[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(x), 2048))]
            rows = got.collect()
            assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
            for r in rows:
                bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for b in bins.values():
                ends = np.cumsum([n for _, n in sorted(b)])
                assert [a for a, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 2048
            assert len(bins) <= best_fit([w[3] for w in want], 2048)
        assert 0 < got.count() and (len(before) > 120 or name != "quality rules")
        out = got


def test_working_tables_go_with_their_stage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    made = storage.settled(spark, "result", lambda: storage.written(spark.range(5), "working").where("id > 1"))
    assert made.count() == 3 and [p.name.split("-")[0] for p in tmp_path.glob("chronoframe/*")] == ["result"]


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Nothing:
        def __init__(self, **kwargs):
            self.__dict__.update(kwargs)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        session = Nothing(conf=Nothing(get=lambda key, default: default), sparkContext=Nothing(getCheckpointDir=lambda: None, master=master))
        with pytest.raises(RuntimeError):
            storage.shared_dir(session)


def test_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
