import hashlib
import math
import re
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers as P
import pytest

from chronoframe.llm import bpe, line_dedup, packing, quality_ftrl, quality_rules, token_files, toxicity
from chronoframe.llm.kernel import Flat, combine
from chronoframe.llm.unit_codes import ByteCodes, WordCodes


@pytest.fixture(scope="module")
def rows():
    return brute.awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


def test_line_dedup(docs, rows, empty):
    want = brute.line_dedup([r[:2] for r in rows])
    for batches in (1, 4):
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup(docs, batches).collect()}
        assert got == want
    clash = line_dedup.dedup(docs.selectExpr("*", "'x' AS n_lines", "1 AS h1", "2 AS doc"))
    assert {r.doc_id: r.n_lines for r in clash.collect()} == {k: v[0] for k, v in want.items()} and "h1" in clash.columns
    assert line_dedup.dedup(empty).count() == 0


def test_line_dedup_beside_columns_of_its_own_names(docs, rows):
    want = brute.line_dedup([r[:2] for r in rows])
    clash = docs.selectExpr("*", "'k' AS _key", "'d' AS _doc", "7 AS _DROP", "1 AS _key_", "2 AS batch", "3 AS sure", "4 AS h2", "5 AS n_dropped")
    out = line_dedup.dedup(clash)
    assert {(r.doc_id, r.text) for r in out.collect()} == {(i, v[2]) for i, v in want.items()}
    assert {(r._key, r._doc, r._DROP) for r in out.collect()} == {("k", "d", 7)} and out.columns == [*clash.columns[:-1], "n_lines", "n_dropped"]


def test_line_dedup_without_ids_and_repeated_ids(spark):
    rows = [(None, "a shared line of text"), (None, "a shared line of text\nonly here among nulls"), (5, "a shared line of text"), (5, "a shared line of text\nx")]
    got = sorted((r.doc_id or -1, r.text) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, ""), (-1, "only here among nulls"), (5, "a shared line of text"), (5, "a shared line of text\nx")]


def test_line_dedup_sends_a_row_its_own_lines_only(spark, monkeypatch):
    lines = [f"shared line number {k}" for k in range(20)]
    rows = [(1, "\n".join(lines)), *((None, f"{x}\nonly here {k}") for k, x in enumerate(lines)), *((7, f"{x}\nnot there {k}") for k, x in enumerate(lines))]
    seen, without = [], line_dedup.without
    monkeypatch.setattr(line_dedup, "without", lambda docs, drops: seen.append(drops) or without(docs, drops))
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, "\n".join(lines), 0), *((None, f"only here {k}", 1) for k in range(20)), *((7, f"not there {k}", 1) for k in range(20))]
    assert sorted((r.doc_id or 0, r.text, r.n_dropped) for r in got) == sorted((i or 0, *x) for i, *x in want)
    assert max(len(r._drop) for r in seen[0].collect()) == 1  # 20 if noted by document


def test_line_dedup_keeps_bytes_that_are_not_utf8(spark):
    rows = [(1, b"a line that stays \xff\xfe"), (2, b"a line that stays \xff\xfe\nb\xff"), (3, b"nothing to drop \x80")]
    docs = spark.createDataFrame(rows, "doc_id long, text binary").selectExpr("doc_id", "CAST(text AS string) AS text")
    got = {r.doc_id: bytes(r.text) for r in line_dedup.dedup(docs).selectExpr("doc_id", "CAST(text AS binary) AS text").collect()}
    assert got == {1: rows[0][1], 2: b"b\xff", 3: rows[2][1]}


def test_compaction_keeps_all_keys(spark):
    runs = line_dedup.Runs(spark, buckets=3, fanout=2)
    for k in range(5):
        runs.add(runs.unseen(spark.range(10 * k, 10 * k + 15).selectExpr("id AS h1", "-id AS h2", "id AS doc")))
        runs.compact()
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    left = runs.unseen(spark.range(100).selectExpr("id AS h1", "-id AS h2", "id AS doc"))
    assert sorted(r.h1 for r in left.collect()) == list(range(55, 100))
    runs.close()


def test_rules(docs, rows, empty):
    ratios = quality_rules.fit(docs, docs.where("doc_id % 2 = 0").select("doc_id"))
    assert ratios.any() and not quality_rules.fit(docs, empty.select("doc_id")).any()
    got = {r.doc_id: r for r in quality_rules.judge(docs.selectExpr("*", "1 AS llr", "2 AS n_words"), ratios).collect()}
    for i, text, *_ in rows:
        text = text or ""
        words = brute.WORD.findall(text)
        windows = list(zip(words, words[1:], words[2:]))
        times = Counter(windows)
        covered = {j + k for j, w in enumerate(windows) if times[w] > 1 for k in range(3)}
        seen, dup = set(), 0
        for x in text.split("\n"):
            if brute.WORD.search(x):
                dup += x in seen
                seen.add(x)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    kept = quality_rules.keep(docs, ratios)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.judge(empty, ratios).count() == 0


def test_encode_decode(docs, rows, monkeypatch):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    c = bpe.codec(path, P.PATTERN)
    whole = c.pieces.encode
    want = {i: whole(t or "") for i, t, *_ in rows}
    ids = bpe.encode_ids(docs, path, P.PATTERN)
    assert {r.doc_id: r.ids for r in ids.collect()} == want
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode_ids(ids, path, P.PATTERN).collect()} == {i: (t or "").encode() for i, t, *_ in rows}
    for long in (1 << 16, 40):  # the second sends most texts through chunks of their own
        monkeypatch.setattr(bpe, "LONG", long)
        monkeypatch.setattr(bpe, "CHUNK", 64)
        monkeypatch.setattr(bpe, "OVERLAP", 16)
        got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, path, P.PATTERN).collect()}
        assert got == {i: (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t, *_), x in zip(rows, want.values())}


def test_a_truly_long_text_repeated_rows_and_null_ids(spark, monkeypatch):
    """Longer than LONG many times over, with white space and pre-tokens across every kind of border."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    whole = bpe.codec(path, P.PATTERN).pieces.encode
    monkeypatch.setattr(bpe, "LONG", 1 << 10)
    monkeypatch.setattr(bpe, "CHUNK", 1 << 9)
    monkeypatch.setattr(bpe, "OVERLAP", 64)
    r = np.random.default_rng(8)
    parts = ["\t\n", " ", "\n\n  ", "word", "don't", "漢字かな", "12345", "%%%", "é", "\r\n", "x" * 700, " " * 700]
    text = "".join(parts[i] for i in r.integers(0, len(parts), 4000))
    rows = [(1, text), (1, text), (None, text), (2, text[::-1]), (3, "short"), (None, None)]
    some = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _key", "2 AS _at", "3 AS ids", "4 AS n_tokens")
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(some, path, P.PATTERN).collect())
    want = Counter((i, len(whole(t or "")), hashlib.sha256(",".join(map(str, whole(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert got == want and len(text) > 100 * bpe.LONG


def test_stitching_any_chunks():
    import regex

    pattern = regex.compile(P.PATTERN)
    for text in [" " * 50, "x" * 90, "a b  c\n\n d" * 9, "it's 12  \n" * 7]:
        for chunk in range(1, 30, 3):
            for overlap in (0, 1, 5, 40):
                assert bpe.pretokens(pattern, text, chunk, overlap) == pattern.findall(text)


@pytest.mark.parametrize("kind,name", [(WordCodes, "word_bpe_49k.json"), (ByteCodes, "byte_bpe_50k.json")])
def test_units_give_the_librarys_ids(kind, name, rows):
    codes = kind(P.path(name))
    texts = [(t or "").encode() for _, t, *_ in rows] + ["<|endoftext|> x".encode()]
    ids, n = codes.encode(texts)
    want = codes.direct(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.tolist() for x in want]


@pytest.mark.parametrize("bits", [True, False])
def test_shards(spark, docs, rows, empty, bits, tmp_path, monkeypatch):
    ids = np.array([0, 1, 65535, 70000, 2**32 - 1] * 50, np.uint32)
    shard = token_files.Shard(token_files.pack_shard([100, 0, 150], ids, bits, block=64, names=[-5, None, 2**62], before=7))
    assert shard.lengths.tolist() == [100, 0, 150] and (shard.ids() == ids).all() and (shard.block(1) == ids[64:128]).all()
    assert shard.names == [-5, None, 2**62] and shard.before == 7
    with pytest.raises(ValueError):
        token_files.Shard(b"nothing of the kind, but long enough to be read as one shard")
    monkeypatch.setattr(token_files, "SHARD_IDS", 500)
    path = P.path("byte_bpe_50k.json")
    clash = docs.selectExpr("*", "1 AS ids", "2 AS wide", "'x' AS part", "3 AS content")
    folder = token_files.write(clash, path, f"file://{tmp_path}/files", bits=bits, n=3)
    tokenizer = ByteCodes(path)
    at = 0
    want = []
    for i, t, *_ in rows:
        x = np.append(tokenizer.direct([(t or "").encode()])[0], np.uint32(2)).astype("<u4")
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, token_files.read(spark, folder).collect())) == want
    # the files alone hold everything, in the order of their names
    names = sorted(tmp_path.glob("files/*"))
    shards = [token_files.Shard(f.read_bytes()) for f in names]
    assert len(shards) > 3 and all(re.fullmatch(r"\d{8}-\d{8}\.cftp", f.name) for f in names)
    assert [i for x in shards for i in x.names] == [w[0] for w in want] and [n for x in shards for n in x.lengths] == [w[2] for w in want]
    assert token_files.read(spark, token_files.write(empty, path)).count() == 0


def test_shards_of_repeated_rows_and_null_ids(spark):
    path = P.path("byte_bpe_50k.json")
    some = spark.createDataFrame([(None, "b"), (None, "a"), (3, "x"), (3, "x"), (2, None)], "doc_id long, text string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens) for r in token_files.read(spark, token_files.write(some, path, n=2)).collect())
    assert got == [(-1, 0, 2), (-1, 2, 2), (2, 4, 1), (3, 5, 2), (3, 7, 2)]


def test_packing(docs, rows, empty):
    got = packing.packed(docs, P.path("word_bpe_49k.json"), capacity=64).collect()
    tokenizer = WordCodes(P.path("word_bpe_49k.json"))
    want = []
    for i, t, *_ in rows:
        x = np.append(tokenizer.direct([(t or "").encode()])[0], np.uint32(0)).astype("<u4")
        want += [(i, k, a, len(x[a : a + 64]), zlib.crc32(x[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(x), 64))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in bins.values():
        ends = [0]
        for a, n in sorted(x):
            assert a == ends[-1]
            ends.append(a + n)
        assert ends[-1] <= 64
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 64 + 1
    assert packing.packed(empty, P.path("word_bpe_49k.json")).count() == 0


def test_children_better_the_founders():
    """On pieces that best fit packs badly, children enter the population and need fewer sequences than every founder."""
    r = np.random.default_rng(0)
    r.lognormal(size=5000)
    for low, high, at_most in ((300, 1400, 2078), (400, 800, 1504)):
        sizes = np.sort(r.integers(low, high, 5000)).tolist()
        g = np.random.default_rng(1)
        founders = packing.first_population(sizes, 2048, g)
        fits = {p.fitness for p in founders}
        found = packing.evolved(founders, g)
        children = [p for p in found if p.fitness not in fits]
        best = min(p.fitness[0] for p in children)
        assert len(children) > len(found) // 2 and best < min(p.fitness[0] for p in founders) and packing.lower_bound(sizes, 2048) <= best <= at_most
        for p in found:
            assert sorted(i for b in p.bins for i in b) == list(range(5000)) and min(p.free) >= 0


def test_exchange_and_injection():
    p = packing.Packing([(0, 1), (2,)], [50, 30, 60, 48, 18], 100)
    assert sorted(p.exchange([3, 4])) == [1, 4] and sorted(p.bins[0]) == [0, 3] and p.free == [2, 40]
    assert packing.least_slack([60, 30, 10, 50, 50], 100, None).fitness[0] == 2
    r = np.random.default_rng(3)
    sizes = r.integers(1, 60, 300).tolist()
    a, b = packing.first_population(sizes, 64, r)[:2]
    child = packing.crossover(a, b, r)
    assert sorted(i for x in child.bins for i in x) == list(range(300)) and min(child.free) >= 0
    assert {frozenset(x) for x in child.bins} & {frozenset(x) for x in b.bins} and a.fitness == packing.Packing(a.bins, sizes, 64).fitness


def test_packing_of_repeated_rows_and_null_ids(spark, monkeypatch):
    """Rows alike in all columns are dealt over groups, and each of them is packed."""
    monkeypatch.setattr(packing, "GROUP", 20)
    some = spark.createDataFrame([(None, "a b c")] * 50 + [(7, "d e")] * 40 + [(8, None), (9, "")], "doc_id long, text string").selectExpr("*", "1 AS grp", "2 AS row", "3 AS island", "'x' AS length")
    got = packing.packed(some.repartition(2), P.path("word_bpe_49k.json"), capacity=16).collect()
    assert Counter(r.doc_id for r in got) == {None: 50, 7: 40, 8: 1, 9: 1}
    assert len({r.sequence_id >> 32 for r in got if r.doc_id is None}) > 1
    assert len(got) == len({(r.sequence_id, r.offset) for r in got})


@pytest.mark.parametrize("model,label", [(quality_ftrl, "quality"), (toxicity, "toxic")])
def test_classifiers_learn_and_take_anything(spark, docs, rows, empty, model, label):
    good = "plain words that stand in order number"
    bad = "vile%%% rubbish*** idiot### scum!!"
    table = [(k, f"{bad if k % 3 == 0 else good} {k % 17} {k % 5}", int((k % 3 == 0) == (label == "toxic"))) for k in range(600)]
    some = spark.createDataFrame([x[:2] for x in table], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in table] + [(None, 1), (3, None)], f"doc_id long, {label} int")
    w = model.fit(some, labels)
    got = {r.doc_id: r for r in model.score(some, w).collect()}
    held = [i for i, *_ in table if brute.crc(i) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert sum(got[i].predicted == y for i, _, y in table if got[i].held_out) >= 0.97 * len(held)
    out = model.score(docs, w).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert model.score(empty, w).count() == 0
    none = model.fit(some, labels.limit(0))
    assert {r.predicted for r in model.score(docs, none).collect()} <= {0, 1}


def test_weights_of_a_plain_ftrl():
    """One weight at a time, in dictionaries."""
    r = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in r.integers(0, 30, int(r.integers(0, 12)))) for _ in range(60)]
    f, d = quality_ftrl.features([t.encode() for t in texts])
    rows = [(k, int(k % 3 == 0), f[d == k]) for k in range(60)]
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality_ftrl.L1:
            return 0.0
        return -(z[i] - math.copysign(quality_ftrl.L1, z[i])) / ((quality_ftrl.BETA + math.sqrt(n[i])) / quality_ftrl.ALPHA + quality_ftrl.L2)

    for epoch in range(quality_ftrl.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(60):
            _, y, found = rows[k]
            times = Counter(found.tolist())
            length = math.sqrt(max(1, len(found)))
            x = {i: math.sqrt(c) / length for i, c in times.items()} | {quality_ftrl.BIAS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality_ftrl.ALPHA * w[i]
                n[i] += g * g
    got = quality_ftrl.train(rows)
    want = np.zeros(quality_ftrl.BUCKETS)
    for i in z:
        want[i] = weight(i)
    assert np.abs(got - want).max() < 1e-9 and np.count_nonzero(want) > 20


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_gradient_of_the_non_negative_risk(prior, monkeypatch):
    """Against differences of the risk; with the larger prior its negative part is under zero, and the step goes up."""
    monkeypatch.setattr(toxicity, "BUCKETS", 12)
    r = np.random.default_rng(4)
    p = [np.unique(r.integers(1, 6, 4)) for _ in range(8)]
    others = [np.unique(r.integers(5, 12, 4)) for _ in range(12)]
    u = p + others
    w = r.normal(size=12)
    if prior > 0.5:  # a model that is sure of both kinds
        w[1:5] += 4
        w[5:] -= 3

    def loss(v, some, y):
        z = np.array([v[x].sum() + v[0] for x in some])
        return np.log1p(np.exp(-y * z)).mean()

    def negative(v):
        return loss(v, u, -1) - prior * loss(v, p, -1)

    risk = (lambda v: prior * loss(v, p, 1) + negative(v)) if negative(w) >= 0 else (lambda v: -negative(v))
    numeric = np.array([(risk(w + 1e-6 * e) - risk(w - 1e-6 * e)) / 2e-6 for e in np.eye(12)])
    assert np.abs(toxicity.gradient(w, p, u, prior) - numeric).max() < 1e-6
    assert (negative(w) < 0) == (prior > 0.5)


def test_ratios_of_plain_counts(docs, rows):
    """Every n-gram counted in a dictionary of buckets."""
    one = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")
    top = 64 - quality_rules.BUCKETS.bit_length() + 1

    def grams(text):
        found = one.findall((text or "").encode().lower())
        flat = Flat(found)
        h = flat.hashes(flat.bounds[:-1], flat.bounds[1:] - 1, seed=3)
        with np.errstate(over="ignore"):
            pairs = combine(h[:-1], h[1:])
        return [int(x) >> top for x in (*h.tolist(), *pairs.tolist())]

    raw, target = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(grams(t))
        if i % 2 == 0:
            target.update(grams(t))
    a, b = (sum(x.values()) + quality_rules.SMOOTHING * quality_rules.BUCKETS for x in (target, raw))
    ratio = lambda k: math.log((target[k] + quality_rules.SMOOTHING) / a) - math.log((raw[k] + quality_rules.SMOOTHING) / b)
    got = quality_rules.fit(docs, docs.where("doc_id % 2 = 0").select("doc_id"))
    assert max(abs(got[k] - ratio(k)) for k in [*raw, 5, 6]) < 1e-9
    want = {i: (sum(map(ratio, g)) / len(g) if g else 0.0) for i, g in ((i, grams(t)) for i, t, *_ in rows)}
    out = {r.doc_id: r for r in quality_rules.judge(docs, got).collect()}
    assert all(abs(out[i].llr - x) < 1e-9 and (out[i].base_failed or out[i].kept == (x >= quality_rules.THRESHOLD)) for i, x in want.items())


def test_rules_and_classifiers_on_repeated_rows_null_ids_and_clashes(spark):
    good, bad = "calm and plain words in a row", "rubbish%%% scum*** !!"
    rows = [(k, good if k % 2 else bad) for k in range(60)] + [(None, good), (None, None), (7, good), (7, good), (7, bad)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS score", "9 AS predicted", "8 AS held_out", "7 AS kept", "6 AS base_failed", "5 AS _id", "4 AS _y", "3 AS _t", "2 AS f", "1 AS bucket")
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(60)], "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text", "1 AS f", "2 AS _y")
    for model in (quality_ftrl, toxicity):
        got = model.score(table, model.fit(table, labels)).select("doc_id", "held_out", "score", "predicted").collect()
        assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
        ties = {r.score for r in got if r.doc_id is not None and r.doc_id % 2 and r.doc_id != 7}
        assert len(ties) == 1 and all(isinstance(r.held_out, bool) and r.predicted in (0, 1) for r in got)  # equal texts, equal scores
    ratios = quality_rules.fit(table, quality_rules.trusted_ids(labels))
    got = quality_rules.judge(table, ratios).collect()
    assert len(got) == len(rows) and all(r.base_failed and not r.kept for r in got) and {r._t for r in got} == {3}


def test_toxic_words_in_a_long_text_count():
    """A few toxic words at any place of a long text score as high as in a window of their own."""
    r = np.random.default_rng(5)
    plain, vile = [f"plain{i}" for i in range(300)], ["vile", "scum", "moron"]
    texts = []
    for k in range(900):
        words = [plain[i] for i in r.integers(0, 300, int(r.integers(20, 400)))]
        for _ in range(3 * (k % 3 == 0)):
            words.insert(int(r.integers(0, len(words))), vile[int(r.integers(0, 3))])
        texts.append(" ".join(words).encode())
    f, d = toxicity.features(texts)
    w = toxicity.train([(k, int(k % 3 == 0), f[d == k]) for k in range(900)])
    calm = b" ".join(plain[i].encode() for i in r.integers(0, 300, 20_000))
    middle = calm.index(b" ", len(calm) // 2)
    found = toxicity.scores(w, [calm, calm + b" vile scum", b"vile scum " + calm, calm[:middle] + b" vile scum moron" + calm[middle:], b""])
    assert list(found >= toxicity.THRESHOLD) == [False, True, True, True, False]
