"""The engine on literal series: range reads, rolling, codec, key lists, ownership, streaming."""

import math

import pytest
from pyspark.sql import functions as F

from chronoframe.config import DEFAULT
from chronoframe.functions.codec import decode_block, encode_block
from chronoframe.operators import admit, catalog, codec_stats, lifecycle, read
from chronoframe.sources import points as source
from chronoframe.streaming import ingest

SCHEMA = "shard_id int, key string, ts long, value double, arrival long, event_id long"

# fixed values: an irregular minute series of 120 points, given as offsets from the minute and values
OFFSETS = {1: 1, 2: 2, 3: -2, 36: 6, 47: 2, 86: -8, 97: 7}
VALUES = """
761 727 765 706 700 679 757 708 739 707 699 740 729 766 730 715 705 693 765 724
799 761 737 766 756 719 722 801 747 731 742 744 791 750 759 809 751 705 770 792
727 762 772 721 748 753 744 716 776 659 789 766 758 690 795 770 758 723 767 765
693 706 681 727 724 780 678 696 758 740 735 700 742 747 752 734 743 732 746 770
780 710 731 712 712 741 770 770 754 718 670 775 749 795 756 741 787 721 745 782
765 780 811 790 836 743 858 739 762 770 752 763 795 792 746 786 785 774 786 718
""".split()
SERIES = [(1440583200 + 60 * k + OFFSETS.get(k, 0), float(v)) for k, v in enumerate(VALUES)]


def points(spark, rows, key="testa", shard=10):
    return spark.createDataFrame([(shard, key, ts, v, k, k) for k, (ts, v) in enumerate(rows)], SCHEMA)


def test_minute_series_reads(spark):
    p = points(spark, SERIES)
    assert read.get_one(p, 10, "testa", 1440583000, 1440591000).count() == 120
    assert [r.ts for r in read.first_points(p, 20, 1440583000, 1440591000).orderBy("ts").collect()] == [ts for ts, _ in SERIES[:20]]
    assert read.get_one(p, 10, "testa", 1440583260, 1440583741).count() == 9
    assert read.get_one(p, 10, "testa", 5, 4).count() == 0
    assert {r.bucket for r in lifecycle.blocks(p, 7200).collect()} == {200082} and {r.bucket for r in lifecycle.blocks(p, 14400).collect()} == {100041}


def test_five_points(spark):
    p = points(spark, [(60, 100.0), (118, 110.0), (183, 170.0), (247, 210.0), (300, 110.0)])
    assert read.get_one(p, 10, "testa", 60, 280).count() == 4
    assert read.get_one(p, 10, "testa", 300, 300).count() == 1


def test_requests_keep_their_order_and_misses_show(spark):
    p = points(spark, SERIES[:5]).unionByName(points(spark, SERIES[5:8], key="b"))
    requests = spark.createDataFrame([(0, 10, "b", 0, 2**32), (1, 10, "testa", 0, 2**32), (2, 10, "b", 0, 2**32), (3, 10, "no", 0, 1), (4, 10, "testa", 9, 1)], "req_idx int, shard_id int, key string, begin long, end long")
    assert [r.req_idx for r in read.get(p, requests).collect()] == [0] * 3 + [1] * 5 + [2] * 3
    keys = p.select("shard_id", "key").distinct()
    assert [r.key for r in read.missing(keys, requests).collect()] == ["no"]
    with pytest.raises(KeyError):
        read.get(p, requests, strict_keys=keys)
    assert {r.req_idx: len(r.points) for r in read.get_lists(p, requests).collect()} == {0: 3, 1: 5, 2: 3, 3: 0, 4: 0}


def test_paging(spark):
    keys = spark.createDataFrame([(1, f"k{k:02d}", k) for k in range(30)], "shard_id int, key string, key_id int")
    assert read.page(keys, 32, 4).count() == 0
    assert [r.has_more for r in read.page(keys, 28, 4).collect()] == [False] * 2
    assert [(r.key_id, r.has_more) for r in read.page(keys, 20, 4).collect()] == [(k, True) for k in range(20, 24)]


@pytest.mark.parametrize("n,bits", [(5, 156), (20, 360), (120, 1647)])
def test_codec_sizes(n, bits):
    data, size = encode_block(SERIES[:n])
    assert size == bits and data[:16].hex() == "55dd8e20829c087cd027897759dcf17f"
    assert decode_block(data, n) == SERIES[:n]


def test_codec_keeps_odd_values():
    odd = [(0, -0.0), (0, 0.0), (1, math.inf), (100000, -math.inf), (2**31, 5e-324), (2**32 - 1, 1.5)]
    got = decode_block(encode_block(odd)[0], len(odd))
    assert got == odd and math.copysign(1, got[0][1]) == -1
    assert math.isnan(decode_block(encode_block([(7, math.nan)])[0], 1)[0][1])
    for bad in ([(-1, 1.0)], [(2**32, 1.0)], [(5, 1.0), (4, 1.0)]):
        with pytest.raises(ValueError):
            encode_block(bad)
    with pytest.raises(ValueError):
        decode_block(b"\0\0", 1)


def test_blocks_round_trip(spark):
    p = points(spark, SERIES)
    assert sorted((r.ts, r.value) for r in codec_stats.decode(codec_stats.encode(p, 3600)).collect()) == sorted(SERIES)


def test_admission_window_equals_fold(spark):
    rows = [(5, 1.0), (4, 1.0), (5, 2.0), (9, 1.0), (7, 1.0), (9, 3.0), (12, 1.0)]
    p = points(spark, rows)
    want = [(5, 1.0), (5, 2.0), (9, 1.0), (9, 3.0), (12, 1.0)]
    assert sorted((r.ts, r.value) for r in admit.admit_window(p).where("admitted").collect()) == want
    assert sorted((r.ts, r.value) for r in admit.admit_fold(p, 0).collect()) == want
    assert sorted(r.ts for r in admit.admit_fold(p, 4).collect()) == [5, 9]
    assert sorted(r.ts for r in admit.admit_fold(points(spark, [(0, 1.0), (1, 1.0), (2, 1.0)]), 5).collect()) == [0, 1]


def test_union_of_ranges_is_the_whole(spark):
    p = points(spark, SERIES)
    low, high = read.in_range(p, 0, 1440586000), read.in_range(p, 1440586001, 2**32)
    assert low.unionByName(high).exceptAll(p).count() == 0 and low.count() + high.count() == 120


def test_log_files_and_bits(spark):
    p = points(spark, [(5001, 1.0), (5099, 2.0), (5100, 3.0), (5250, 4.0)])
    assert [r.file_ts for r in lifecycle.log_files(p, 100).orderBy("event_id").collect()] == [5001, 5001, 5100, 5250]
    log = spark.createDataFrame([(1, "a", 101, 2.0, 0, 0), (1, "a", 101, 2.0, 1, 1), (1, "b", 104, 5.0, 2, 2), (1, "c", 9000, 0.0, 3, 3)], SCHEMA)
    keys = spark.createDataFrame([(1, "a", 0), (1, "b", 3), (1, "c", 3000000)], "shard_id int, key string, key_id int")
    assert [r.bits for r in codec_stats.log_bits(log, keys).orderBy("event_id").collect()] == [23, 23, 31, 65]


def test_key_lists(spark):
    records = spark.createDataFrame([(1, 0, 5, "hi", 1), (1, 1, 4, "test", 2), (1, 2, 7, "bye", 3), (1, 3, 4, "again", 9), (1, 4, 2, "bye", 8), (1, 5, 11, "x" * 400, 0), (1, 6, 10_000_001, "big", 0)], "shard_id int, seq long, key_id int, key string, category int")
    live = catalog.dedup_records(records, DEFAULT.max_key_bytes, DEFAULT.max_key_id)
    assert {(r.key_id, r.key, r.category) for r in live.collect()} == {(5, "hi", 1), (4, "again", 9), (2, "bye", 8)}
    assert sorted(r.key_id for r in catalog.free_ids(live).collect()) == [0, 1, 3]
    assert {r.key for r in catalog.erase(live, spark.createDataFrame([(1, "hi")], "shard_id int, key string")).collect()} == {"again", "bye"}


def test_states(spark):
    assert lifecycle.checked_transition("OWNED", "PRE_UNOWNED") == "PRE_UNOWNED" and lifecycle.checked_transition("PRE_UNOWNED", "OWNED") == "OWNED"
    with pytest.raises(ValueError):
        lifecycle.checked_transition("OWNED", "READING_KEYS")
    shards = spark.createDataFrame([(k, "UNOWNED") for k in range(10)], "shard_id int, state string")
    plan = lifecycle.reload_plan(shards, spark.createDataFrame([(1,), (3,), (5,), (7,)], "shard_id int"))
    assert {(r.shard_id, r.action) for r in plan.collect()} == {(k, "add") for k in (1, 3, 5, 7)}


def test_closing_and_retention(spark):
    now = 1440590000
    last = lifecycle.last_closed(now, 7200, 900, 60)
    assert last * 7200 <= now - 960 < (last + 1) * 7200
    found = spark.createDataFrame([(1, "a", b, 1) for b in range(1, 12)], "shard_id int, key string, bucket long, n_points long")
    assert sorted(r.bucket for r in lifecycle.finalize(found, 5).collect()) == [5]
    assert sorted(r.bucket for r in lifecycle.finalize(found, 5, 2).collect()) == [3, 4, 5]


def test_synthetic_series(spark):
    p = source.synthetic(spark, 3, 10)
    assert p.where(f"ts BETWEEN 0 AND {60 * 11 + 60}").count() == 30 and p.where("value NOT BETWEEN 100 AND 149").count() == 0


def test_layout_prunes(spark, tmp_path):
    source.write_points(points(spark, SERIES).select("shard_id", "key", "ts", "value", "arrival"), str(tmp_path / "t"), 3600)
    p = spark.read.parquet(str(tmp_path / "t"))
    got = read.get_one(p, 10, "testa", 1440583260, 1440583741, window=3600)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 9 and "PartitionFilters: [isnotnull(shard_id" in plan and "GreaterThanOrEqual(ts" in plan


@pytest.mark.parametrize("min_delta", [0, 86400])
def test_stream_admits_as_the_batch_does(spark, sf_dir, tmp_path, min_delta):
    p = source.load(spark, sf_dir, jitter=200)
    for k in range(4):  # four files, in arrival order
        p.where(F.col("arrival").between(k * 300, k * 300 + 299)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ingest.ingest(stream.select("shard_id", "key", "ts", "value", "arrival", "event_id"), str(tmp_path / "out"), str(tmp_path / "state"), 7200, min_delta)
    assert query.awaitTermination(240)
    want = admit.admit_fold(p, min_delta)
    got = ingest.read(spark, str(tmp_path / "out"))
    assert sorted(r.event_id for r in got.select("event_id").collect()) == sorted(r.event_id for r in want.select("event_id").collect())


def test_watermarked_counts(spark, sf_dir, tmp_path):
    p = source.load(spark, sf_dir).withColumn("time", F.timestamp_seconds("ts"))
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    query = ingest.bucket_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    assert spark.table("counts").agg(F.sum("count")).first()[0] == p.count()


def test_running_maximum_over_blocks(spark):
    """However the arrivals are cut into blocks, the newest earlier timestamp is that of one pass in arrival order."""
    rows = [(k % 3, "hot" if k % 4 else f"k{k % 7}", (k * 7919) % 101, 1.0, (k * 31) % 50, k) for k in range(400)]
    p = spark.createDataFrame(rows, SCHEMA)
    seen, want = {}, {}
    for shard, key, ts, _, _, event in sorted(rows, key=lambda r: (r[4], r[5])):
        want[event] = seen.get((shard, key))
        seen[shard, key] = max(ts, seen.get((shard, key), ts))
    for span in (1, 7, 1000):
        got = {r.event_id: r.newest_before for r in admit.newest_before(p, admit.SERIES, span).collect()}
        assert got == want
    assert admit.newest_before(p.limit(0), admit.SERIES).count() == 0


def test_fold_over_many_batches(spark):
    """The carried timestamp goes on from one Arrow batch to the next, and null timestamps are refused."""
    rows = [(k % 2, "a", None if k % 50 == 0 else (k * 37) % 90, 1.0, k, k) for k in range(300)]
    want, last = [], {}
    for shard, _, ts, _, _, event in rows:
        if ts is not None and (not last.get(shard) or ts - last[shard] >= 20):
            last[shard] = ts
            want.append(event)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "9")
    try:
        assert sorted(r.event_id for r in admit.admit_fold(spark.createDataFrame(rows, SCHEMA), 20).collect()) == want
    finally:
        spark.conf.set(key, before)


def test_log_deltas_over_blocks(spark):
    """The step at a block's first record is against the last record of the block before."""
    rows = [(k % 2, f"k{k % 5}", (k * 7919) % 20011, 1.0, (k * 31) % 50, k) for k in range(200)]
    p, last, want = spark.createDataFrame(rows, SCHEMA), {}, {}
    for shard, _, ts, _, _, event in sorted(rows, key=lambda r: (r[4], r[5])):
        want[event] = ts - last.get(shard, ts)
        last[shard] = ts
    keys = spark.createDataFrame([(s, f"k{k}", k) for s in (0, 1) for k in range(5)], "shard_id int, key string, key_id int")
    for span in (1, 7, 1000):
        assert {r.event_id: r.delta for r in codec_stats.log_bits(p, keys, span).collect()} == want


def test_profiles_keep_shards_apart(spark):
    """Two shards with one key have blocks of their own."""
    rows = [(shard, "k", 60 * k + shard, 1.0 + k, 2 * k + shard, 0) for k in range(3) for shard in (0, 1)]
    p = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.delta for r in codec_stats.timestamp_bits(p, 7200, 60).where("delta IS NOT NULL").collect()) == [60] * 4
    assert codec_stats.xor_profile(p, 7200).count() == 6


def test_points_that_no_block_holds(spark):
    p = points(spark, [(-5, 1.0), (10, 2.0), (2**32, 3.0)])
    assert [r.ts for r in codec_stats.decode(codec_stats.encode(p, 7200)).collect()] == [10]
    assert sorted(r.ts for r in codec_stats.rejected(p).collect()) == [-5, 2**32]


def test_state_changes(spark):
    for now, to in (("PRE_UNOWNED", "UNOWNED"), ("UNOWNED", "PRE_OWNED"), ("PRE_OWNED", "OWNED"), ("OWNED", "PRE_UNOWNED"), ("READING_BLOCK_DATA", "OWNED")):
        assert lifecycle.checked_transition(now, to) == to
    for now, to in (("UNOWNED", "PRE_UNOWNED"), ("OWNED", "UNOWNED"), ("OWNED", "OWNED"), ("READING_LOGS", "READING_KEYS")):
        with pytest.raises(ValueError):
            lifecycle.checked_transition(now, to)
    assert lifecycle.state_transitions(spark).where("set_state").count() == 9 * 8 // 2 + 1


def test_replay_ends_a_file_at_its_first_bad_record(spark):
    log = [(1, 7200, "a", 7200, 0), (1, 7200, "a", 14400, 1), (1, 7200, "a", 14401, 2), (1, 7200, "a", 7300, 3), (1, 14400, "b", 14400, 4), (1, 100, "a", 100, 5), (1, 7300, "a", 7299, 6), (1, 7300, "a", 7199, 7)]
    rows = spark.createDataFrame([(*x, 0) for x in log], "shard_id int, file_ts long, key string, ts long, arrival long, event_id long")
    keys = spark.createDataFrame([(1, "a")], "shard_id int, key string")
    # the next bucket's first second counts; the file of the last block is read, those before it aren't
    assert sorted((r.arrival, r.known) for r in lifecycle.replayed(rows, keys, 7200, 2).collect()) == [(0, True), (1, True), (4, False), (6, True)]
    assert sorted(r.arrival for r in lifecycle.replayed(rows, keys, 7200, 0).collect()) == [0, 1, 4, 5, 6]
    assert [tuple(r) for r in lifecycle.unknown_keys(lifecycle.replayed(rows, keys, 7200, 2)).collect()] == [(1, 4, 1)]


def test_gaps_from_the_last_block_and_up_to_now(spark):
    log = points(spark, [(1000, 1.0), (900, 1.0), (1700, 1.0)], shard=1)
    gaps = lambda **how: sorted((r.ts, r.newest_before) for r in lifecycle.log_gaps(log, 600, **how).collect())
    assert gaps() == [(1700, 1000)]  # nothing is missing before the first record of a shard without blocks
    assert gaps(start=300) == [(1000, 300), (1700, 1000)] and gaps(start=1100, now=2300) == [] and gaps(now=2301) == [(1700, 1000), (2301, 1700)]
    holes = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "shard_id int, n_holes long")
    queued = spark.createDataFrame([(4, 50), (2, 60)], "shard_id int, at long")
    found = lifecycle.reliable_from(lifecycle.log_gaps(log, 600), holes, 5000, queued)
    assert {r.shard_id: r.reliable_from for r in found.collect()} == {1: 1700, 2: 60, 4: 50}


def test_behind_counts_finalized_buckets_of_owned_shards(spark):
    rows = [(1, "OWNED", 5), (2, "OWNED", 8), (3, "OWNED", 0), (4, "OWNED", None), (5, "PRE_UNOWNED", 5), (6, "OWNED", 9)]
    shards = spark.createDataFrame(rows, "shard_id int, state string, last_finalized long")
    assert [r.shard_id for r in lifecycle.behind(shards, 10).where("is_behind").orderBy("shard_id").collect()] == [1, 2]


def test_block_limits(spark):
    blocks = spark.createDataFrame([(1, 32767, 32767), (2, 32768, 10), (3, 10, 32768)], "id int, n_points long, n_bytes long")
    assert [r.id for r in lifecycle.oversize(blocks, DEFAULT.max_block_points, DEFAULT.max_block_bytes).orderBy("id").collect()] == [2, 3]
    assert [r.id for r in lifecycle.oversize(blocks, DEFAULT.max_block_points).collect()] == [2]


def test_bad_records_end_their_file(spark):
    rows = [(1, 1, 0, 5, "a", 0), (1, 1, 1, 6, "x" * 400, 0), (1, 1, 2, 7, "lost", 0), (1, 2, 3, 8, "b", 0), (1, 2, 4, 10_000_001, "big", 0), (1, 2, 5, 9, "lost too", 0), (2, 1, 6, 1, "c", 0)]
    records = spark.createDataFrame(rows, "shard_id int, file_id long, seq long, key_id int, key string, category int")
    assert {r.key for r in catalog.dedup_records(records, DEFAULT.max_key_bytes, DEFAULT.max_key_id).collect()} == {"a", "b", "c"}


def test_ids_in_blocks_of_arrivals(spark):
    p = spark.createDataFrame([(1, f"k{k % 40:02d}", k, 1.0, k * 37 % 101, k) for k in range(100)], SCHEMA)
    want = {(r.key, r.key_id) for r in catalog.key_ids(p).collect()}
    assert {(r.key, r.key_id) for r in catalog.key_ids(p, span=7).collect()} == want and len(want) == 40
    catalog_ = spark.createDataFrame([(1, 1), (1, 4)], "shard_id int, key_id int")
    fresh = spark.createDataFrame([(1, "n1", 5), (1, "n2", 3), (1, "n3", 9), (1, "n4", 11), (2, "m", 1)], "shard_id int, key string, arrival long")
    assert {(r.shard_id, r.key): r.key_id for r in catalog.assigned(catalog_, fresh).collect()} == {(1, "n2"): 0, (1, "n1"): 2, (1, "n3"): 3, (1, "n4"): 5, (2, "m"): 0}


def test_timer():
    from chronoframe.timer import Timer

    with Timer() as t:
        pass
    first = t.total
    assert t.start().stop() >= first >= 0
    t.reset()
    assert t.total == 0 and Timer(running=True).stop() >= 0
