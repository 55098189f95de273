"""The store's put and get, and the binary files."""

import math
import struct

import pytest

from chronoframe.config import DEFAULT
from chronoframe.engine import Engine
from chronoframe.functions.codec import encode_block
from chronoframe.operators import catalog, read
from chronoframe.sources import files

POINT = "shard_id int, key string, ts long, value double, arrival long"


REQUEST = "req_idx int, shard_id int, key string, begin long, end long"


def values(found):
    return [(r.req_idx, r.ts, r.value) for r in found.collect()]


def test_put_get_and_view(spark, tmp_path):
    store = Engine(spark, f"file://{tmp_path}/store", owned=frozenset({1, 2}))
    assert store.points().count() == 0
    first = [(1, "a", 60, 1.0, 0), (1, "a", 50, 2.0, 1), (1, "a", 7300, 3.0, 2), (2, "b", 9, 4.0, 3), (1, "", 9, 5.0, 4), (1, None, 9, 5.0, 5), (7, "a", 9, 6.0, 6)]
    assert store.put(spark.createDataFrame(first, POINT)) == (7, 3, 3, 0)
    assert store.put(spark.createDataFrame([(1, "a", 100, 7.0, 7), (1, "a", 7300, 8.0, 8)], POINT)) == (2, 0, 1, 0)  # the series has moved on
    requests = spark.createDataFrame([(0, 2, "b", 0, 100), (1, 1, "a", 0, 9999)], REQUEST)
    assert values(store.get(requests)) == [(0, 9, 4.0), (1, 60, 1.0), (1, 7300, 3.0), (1, 7300, 8.0)]
    with pytest.raises(KeyError):
        store.get(spark.createDataFrame([(0, 1, "no", 0, 1)], REQUEST), strict=True)
    with pytest.raises(PermissionError):
        store.get(spark.createDataFrame([(0, 7, "a", 0, 1)], REQUEST), strict=True)
    with pytest.raises(PermissionError):
        store.put(spark.createDataFrame([(7, "a", 9, 6.0, 6)], POINT), strict=True)
    store.view("stored")
    assert spark.sql("SELECT max(bucket) FROM stored").first()[0] == 7300 // DEFAULT.window + 1


def test_nulls_are_refused_and_hold_up_nothing(spark, tmp_path):
    store = Engine(spark, f"file://{tmp_path}/store")
    rows = [(1, "b", None, 1.0, 0), (1, "b", 70, 2.0, 1), (1, "b", 80, None, 2), (1, "b", 90, 3.0, None), (None, "b", 95, 3.0, 4), (1, "b", 99, 4.0, 5)]
    assert store.put(spark.createDataFrame(rows, POINT)) == (6, 4, 2, 0)
    assert values(store.get(spark.createDataFrame([(0, 1, "b", 0, 100)], REQUEST))) == [(0, 70, 2.0), (0, 99, 4.0)]
    assert store.get(spark.createDataFrame([], REQUEST)).count() == 0


def test_get_is_pruned(spark, tmp_path):
    store = Engine(spark, f"file://{tmp_path}/store")
    w = DEFAULT.window
    store.put(spark.createDataFrame([(s, k, b * w + 5, float(b), b) for s in range(4) for k in ("x", "y") for b in range(8)], POINT))
    requests = spark.createDataFrame([(0, 2, "x", 3 * w, 4 * w + 9), (1, 2, "y", 3 * w, 3 * w + 5)], REQUEST)
    got = store.get(requests)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("FileScan") if "PartitionFilters" in x and "value" in x)
    filters = scan[scan.index("PartitionFilters") : scan.index("ReadSchema")]
    assert "shard_id" in filters and "(bucket#" in filters and "GreaterThanOrEqual(ts," in filters and "In(key, [" in filters
    assert values(got) == values(read.get(store.points(), requests)) == [(0, 3 * w + 5, 3.0), (0, 4 * w + 5, 4.0), (1, 3 * w + 5, 3.0)]


def test_finalized_buckets_take_nothing_more(spark, tmp_path):
    store = Engine(spark, f"file://{tmp_path}/store", owned=frozenset({1, 2}))
    w = DEFAULT.window
    store.put(spark.createDataFrame([(1, "a", w * b + 1, float(b), b) for b in range(5)] + [(2, "c", 10, 1.0, 9)], POINT))
    every = spark.createDataFrame([(0, 1, "a", 0, 99 * w), (1, 2, "c", 0, 99 * w), (2, 1, "late", 0, 99 * w)], REQUEST)
    before = values(store.get(every))
    assert store.finalize(3 * w + DEFAULT.allowed_behind + DEFAULT.finalize_slack) == 3
    assert values(store.get(every)) == before and {r.last_finalized for r in store.shards().collect()} == {3}
    assert [(r.shard_id, r.bucket) for r in store.sealed_buckets().collect()] == [(1, 3), (1, 2), (1, 1), (2, 1)]
    assert store.put(spark.createDataFrame([(1, "late", 2 * w + 5, 1.0, 20), (1, "late", 3 * w, 2.0, 21)], POINT)) == (2, 1, 1, 0)
    assert values(store.get(every)) == [*before, (2, 3 * w, 2.0)]
    assert store.finalize_to(3) == 3 and store.finalize_to(5) == 5  # again, and on
    assert values(store.get(every)) == [*before, (2, 3 * w, 2.0)]
    assert not [p for p in (tmp_path / "store/live").glob("*/shard_id=1/bucket=*") if int(p.name[7:]) <= 5]


def test_retention(spark, tmp_path):
    store = Engine(spark, f"file://{tmp_path}/store")
    w, keep = DEFAULT.window, DEFAULT.keep_buckets
    store.put(spark.createDataFrame([(1, "a", w * b, float(b), b) for b in range(20)] + [(1, "old", 5, 1.0, 0)], POINT))
    # reads of a series end so many buckets before its newest one
    assert [r.value for r in store.get(spark.createDataFrame([(0, 1, "a", 0, 99 * w)], REQUEST)).collect()] == [float(b) for b in range(20 - 1 - keep, 20)]
    store.finalize_to(4)
    store.delete_old(19 * w)
    assert store.points().agg({"bucket": "min"}).first()[0] == 20 - keep - 1
    assert not [p for p in (tmp_path / "store").glob("*/*/shard_id=1/bucket=*") if int(p.name[7:]) < 20 - keep - 1]
    assert store.put(spark.createDataFrame([(1, "new", 5, 1.0, 99)], POINT)) == (1, 1, 0, 0)


def test_key_list_of_the_store(spark, tmp_path):
    store = Engine(spark, f"file://{tmp_path}/store")
    put = lambda *keys, at=0, category=None: store.put(spark.createDataFrame([(1, k, 60 + at, 1.0, at + j, category) for j, k in enumerate(keys)], f"{POINT}, category int"))
    live = lambda: {r.key: (r.key_id, r.category) for r in store.keys().collect()}
    put("d", "a", "c")
    assert live() == {"d": (0, 0), "a": (1, 0), "c": (2, 0)}
    put("a", "b", at=10, category=7)
    put("a", at=20)  # without one, the category stays
    assert live() == {"d": (0, 0), "a": (1, 7), "c": (2, 0), "b": (3, 7)}
    store.erase(spark.createDataFrame([(1, "a"), (1, "d"), (1, "none")], "shard_id int, key string"))
    put("e", "f", "g", at=30)  # the smallest free ids first
    assert live() == {"c": (2, 0), "b": (3, 7), "e": (0, 0), "f": (1, 0), "g": (4, 0)}
    want = live()
    store.compact_keys()
    assert live() == want and store._records().count() == 5 and len(list((tmp_path / "store/keys").iterdir())) == 1
    assert store.put_by_id(spark.createDataFrame([(1, 0, 100, 5.0, 40), (1, 9, 100, 5.0, 41)], "shard_id int, key_id int, ts long, value double, arrival long")) == (2, 1, 1, 0)
    assert values(store.get(spark.createDataFrame([(0, 1, "e", 100, 100)], REQUEST))) == [(0, 100, 5.0)]


def test_states_and_queue(spark, tmp_path):
    store = Engine(spark, f"file://{tmp_path}/store", owned=frozenset({1}))
    request = spark.createDataFrame([(0, 3, "a", 0, 100)], REQUEST)
    one = spark.createDataFrame([(3, "a", 60, 1.0, 0)], POINT)
    assert store.state(3) == "UNOWNED" and store.put(one) == (1, 1, 0, 0)
    store.set_state(3, "PRE_OWNED")
    assert store.put(one, now=1000) == (1, 0, 0, 1) and store.get(request).count() == 0
    with pytest.raises(PermissionError, match="being loaded"):
        store.get(request, strict=True)
    store.set_state(3, "READING_BLOCK_DATA")
    assert [(r.ts, r.reliable) for r in store.get(request, strict=True).collect()] == [(60, False)]  # points that waited aren't known to be whole
    store.set_state(3, "OWNED")
    with pytest.raises(ValueError):
        store.set_state(3, "READING_LOGS")
    assert store.reload({1, 5}) == {3: "drop", 5: "add"} and store.state(3) == "PRE_UNOWNED"
    assert store.get(request).count() == 1  # still served
    assert store.cancel_unowning(3) and not store.cancel_unowning(3)
    assert store.reload({5}) == {1: "drop", 3: "drop"}
    store.clean(1000)
    assert {r.shard_id: r.state for r in store.shards().collect()} == {1: "UNOWNED", 3: "UNOWNED", 5: "OWNED"} and store.get(request).count() == 0


def test_recovery_from_files(spark, tmp_path):
    w = DEFAULT.window
    shard = tmp_path / "disk/4"
    shard.mkdir(parents=True)
    (shard / "key_list.1").write_bytes(files.key_bytes([(0, b"a", 3), (1, b"b", 0), (2, b"c" * 400, 0), (3, b"after a bad record", 0)]))
    for number in (6, 8):
        (shard / f"block_data.{number}").write_bytes(files.block_file([(0, 1, encode_block([(w * (number - 1) + 3, 1.5)])[0])]))
        (shard / f"complete_block.{number}").write_bytes(b"")
    first = 7 * w  # the log of the last block, one before it, and the next one
    for base, rows in ((5 * w, [(0, 5 * w + 9, 9.0)]), (first, [(1, first + 10, 2.0)]), (8 * w, [(1, 8 * w + 5, 3.0), (9, 8 * w + 6, 4.0), (0, 8 * w + 700, 5.0), (0, 10 * w, 6.0), (0, 8 * w + 701, 7.0)])):
        (shard / f"log.{base}").write_bytes(files.log_bytes(rows, base))
    store = Engine(spark, f"file://{tmp_path}/store")
    unknown = store.recover(f"file://{tmp_path}/disk", now=9 * w).collect()
    assert [tuple(r) for r in unknown] == [(4, 4, 1)]
    assert {(r.key, r.key_id, r.category) for r in store.keys().collect()} == {("a", 0, 3), ("b", 1, 0)}
    assert sorted((r.key, r.ts, r.value) for r in store.points().collect()) == [("a", 5 * w + 3, 1.5), ("a", 7 * w + 3, 1.5), ("a", 8 * w + 700, 5.0), ("b", 8 * w + 5, 3.0)]
    assert [(r.last_finalized, r.reliable_from) for r in store.shards().collect()] == [(8, 9 * w)]  # the log ends long before now


def key_list(records, marked=True):
    body = b"".join(struct.pack(">i", i) + (struct.pack(">H", c) if marked else b"") + struct.pack(">I", len(k)) + k for i, k, c in records)
    return (b"1" if marked else b"0") + body


def test_key_lists(spark, tmp_path):
    shard = tmp_path / "3"
    shard.mkdir()
    (shard / "key_list.0").write_bytes(key_list([(9, b"unfinished", 0)]))
    (shard / "key_list.2").write_bytes(key_list([(5, b"hi", 1), (4, b"test", 2)], marked=False))
    (shard / "key_list.10").write_bytes(key_list([(5, b"again", 7), (6, b"cut", 1)])[:-1])
    (shard / "key_list.11").write_bytes(b"x not a list")
    (shard / "key_list.12").write_bytes(b"")
    got = files.read_keys(spark, f"file://{tmp_path}")
    assert [(r.shard_id, r.file_id, r.key_id, r.key, r.category) for r in got.orderBy("seq").collect()] == [(3, 2, 5, b"hi", 0), (3, 2, 4, b"test", 0), (3, 10, 5, b"again", 7)]
    assert {(r.key_id, r.key) for r in catalog.dedup_records(got, DEFAULT.max_key_bytes, DEFAULT.max_key_id).collect()} == {(5, b"again"), (4, b"test")}


def test_block_files(spark, tmp_path):
    shard = tmp_path / "4"
    shard.mkdir()
    series = {k: [(7200 * 5 + 61 * j + k, math.sin(j * k + 1)) for j in range(300)] for k in range(60)}
    raw = files.block_file([(k, len(p), encode_block(p)[0]) for k, p in series.items()])
    assert len(raw) > 8 + 12 * 60 + files.PAGE_BYTES  # more than one page
    for number, done in ((6, True), (7, False)):
        (shard / f"block_data.{number}").write_bytes(raw)
        if done:
            (shard / f"complete_block.{number}").write_bytes(b"")
    got = files.points_of(files.read_blocks(spark, f"file://{tmp_path}")).collect()
    assert sorted((r.key_id, r.ts, r.value) for r in got) == sorted((k, *p) for k, ps in series.items() for p in ps) and {(r.shard_id, r.bucket) for r in got} == {(4, 6)}
    for bad in (b"", raw[:7], raw[:-1]):
        with pytest.raises(ValueError):
            list(files.block_records(bad))


def test_logs(spark, tmp_path):
    literal = [(0, 101, 2.0), (0, 101, 2.0), (3, 104, 5.0), (3000000, 9000, 0.0)]
    shard = tmp_path / "8"
    shard.mkdir()
    (shard / "log.101").write_bytes(files.log_bytes(literal, 101))
    steps = [0, 1, -1, 64, -63, 65, -64, 8192, -8191, 8193, -8192, 10**6, -(10**6)]
    values = [0.0, -0.0, 1.5, math.inf, -math.inf, 5e-324, 1e308, 1.5, 1.5]
    ts, many = 50_000_000, []
    for k in range(500):
        ts += steps[k % len(steps)]
        many.append(((k * k) % 5 << 20, ts, values[(k * 7) % len(values)]))
    raw = files.log_bytes(many, 50_000_000)
    (shard / "log.50000000").write_bytes(raw)
    (shard / "log.50000001").write_bytes(b"")
    got = files.read_logs(spark, f"file://{tmp_path}").orderBy("file_ts", "seq").collect()
    assert [(r.key_id, r.ts, struct.pack(">d", r.value)) for r in got] == [(i, t, struct.pack(">d", v)) for i, t, v in literal + many]
    assert {(r.shard_id, r.file_ts) for r in got} == {(8, 101), (8, 50_000_000)}
    assert len(files.log_bytes(literal[:1], 101)) == -(-(22 + 1 + 1 + 11 + 1) // 8)  # 2.0 has one set bit
    assert list(files.log_records(raw[:-1], 50_000_000)) == many[:-1]
    assert not list(files.log_records(files.log_bytes([(2**21, 5, 1.0)], 5).replace(b"\x80", b"\xff", 1), 5))  # the id is too large
    for bad in ([(-1, 0, 1.0)], [(10**8, 0, 1.0)], [(1, 1 << 40, 1.0)]):
        with pytest.raises(ValueError):
            files.log_bytes(bad, 0)
