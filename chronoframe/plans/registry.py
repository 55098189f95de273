"""The registered queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.config import DEFAULT
from chronoframe.functions import bits
from chronoframe.functions import buckets as B
from chronoframe.operators import admit, catalog, codec_stats, lifecycle, read
from chronoframe.sources import points as source

Query = Callable[[SparkSession, str], DataFrame]
W, KEEP = DEFAULT.window, DEFAULT.keep_buckets
DAY0 = 1704067200  # 2024-01-01T00:00:00Z, the first day of the events
NOW = DAY0 + 20 * 86400
JITTER = 200

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _p(by_user: bool = True, jitter: int = 0) -> str:
    """SQL of the points, as a common table expression named p."""
    key = "event_type || ':' || CAST(user_id AS VARCHAR)" if by_user else "event_type"
    arrival = f"event_id + (event_id * 7919) % {jitter}" if jitter else "event_id"
    return f"p AS (SELECT CAST(user_id % 10 AS INTEGER) AS shard_id, {key} AS key, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value, {arrival} AS arrival, event_id FROM events)"


P, PJ, PT = f"WITH {_p()} ", f"WITH {_p(jitter=JITTER)} ", f"WITH {_p(by_user=False)} "
KEYS = "k AS (SELECT shard_id, key, CAST(row_number() OVER (PARTITION BY shard_id ORDER BY a, e, key) - 1 AS INTEGER) AS key_id FROM (SELECT shard_id, key, min(arrival) AS a, arg_min(event_id, (arrival, event_id)) AS e FROM p GROUP BY shard_id, key))"
PK = f"WITH {_p()}, {KEYS} "

REQUESTS = [(0, 3, "click:3", DAY0, DAY0 + 10 * 86400), (1, 7, "view:7", DAY0, DAY0 + 30 * 86400), (2, 9, "nothing:9", DAY0, NOW), (3, 1, "error:11", NOW, DAY0), (4, 3, "click:3", DAY0 + 86400, DAY0 + 86400 * 29), (5, 2, "signup:2", DAY0, DAY0 + 30 * 86400)]
_REQUESTS = "r(req_idx, shard_id, key, b, e) AS (VALUES " + ", ".join(f"({i}, {s}, '{k}', {b}, {e})" for i, s, k, b, e in REQUESTS) + ")"
# the SQL says for itself what the states are, in what order, and which are readable
SHARD_STATES = ("PRE_UNOWNED", "READING_KEYS_DONE", "OWNED", "UNOWNED", "READING_LOGS", "READING_BLOCK_DATA", "OWNED", "PRE_OWNED", "OWNED", "PROCESSING_QUEUED_DATA_POINTS")
_SHARDS = "s(shard_id, state) AS (VALUES (0, 'PRE_UNOWNED'), (1, 'READING_KEYS_DONE'), (2, 'OWNED'), (3, 'UNOWNED'), (4, 'READING_LOGS'), (5, 'READING_BLOCK_DATA'), (6, 'OWNED'), (7, 'PRE_OWNED'), (8, 'OWNED'), (9, 'PROCESSING_QUEUED_DATA_POINTS'))"
_READABLE = "('OWNED', 'PRE_UNOWNED', 'READING_BLOCK_DATA')"


def requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUESTS, "req_idx int, shard_id int, key string, begin long, end long")


def shards(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SHARD_STATES)), "shard_id int, state string")


def pts(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return source.load(spark, sf_dir, **how)


# -- reads -------------------------------------------------------------------------------------------------------


@register(P + f"SELECT shard_id, key, ts, value FROM p WHERE shard_id = 3 AND key = 'click:3' AND ts BETWEEN {DAY0} AND {DAY0 + 20 * 86400}")
def get_one_key(spark, d):
    return read.get_one(pts(spark, d), 3, "click:3", DAY0, DAY0 + 20 * 86400).select("shard_id", "key", "ts", "value")


@register(f"WITH {_p()}, {_REQUESTS} SELECT req_idx, shard_id, key, ts, value FROM r JOIN p USING (shard_id, key) WHERE ts BETWEEN b AND e")
def get_multi_key(spark, d):
    return read.get(pts(spark, d), requests(spark)).select("req_idx", "shard_id", "key", "ts", "value")


@register(f"WITH {_p()}, {_REQUESTS} SELECT req_idx, shard_id, key, count(ts) AS n_points, min(ts) AS first_ts, max(ts) AS last_ts FROM r LEFT JOIN p USING (shard_id, key) WHERE ts IS NULL OR ts BETWEEN b AND e GROUP BY ALL UNION ALL SELECT req_idx, r.shard_id, r.key, 0, NULL, NULL FROM r WHERE EXISTS (SELECT 1 FROM p WHERE p.shard_id = r.shard_id AND p.key = r.key) AND NOT EXISTS (SELECT 1 FROM p WHERE p.shard_id = r.shard_id AND p.key = r.key AND p.ts BETWEEN b AND e)")
def get_lists(spark, d):
    out = read.get_lists(pts(spark, d), requests(spark))
    ts = F.transform("points", lambda x: x["ts"])
    return out.select("req_idx", "shard_id", "key", F.size("points").cast("long").alias("n_points"), F.array_min(ts).alias("first_ts"), F.array_max(ts).alias("last_ts"))


@register(f"WITH {_p()}, {_REQUESTS} SELECT req_idx, shard_id, key FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.shard_id = r.shard_id AND p.key = r.key)")
def missing_keys(spark, d):
    return read.missing(pts(spark, d).select("shard_id", "key").distinct(), requests(spark)).select("req_idx", "shard_id", "key")


@register(P + f"SELECT shard_id, key, count(*) FILTER (WHERE ts BETWEEN {NOW} AND {NOW + 86400}) AS n_points FROM p GROUP BY shard_id, key")
def known_key_empty_range(spark, d):
    p = pts(spark, d)
    return read.counts_in_range(p.select("shard_id", "key").distinct(), p, NOW, NOW + 86400)


_FIRST = DAY0 // W + 1


@register(P + f"SELECT shard_id, key, ts, value, bucket FROM (SELECT *, ts // {W} + 1 AS bucket, max(ts // {W} + 1) OVER (PARTITION BY shard_id, key) AS m FROM p WHERE ts < {DAY0 + 5 * 86400}) WHERE bucket BETWEEN {_FIRST + 24} AND {_FIRST + 60} AND bucket >= m - 13 AND bucket <= m")
def bucket_range_scan(spark, d):
    p = pts(spark, d).where(F.col("ts") < DAY0 + 5 * 86400)
    return read.bucket_range(p, _FIRST + 24, _FIRST + 60, W, KEEP).select("shard_id", "key", "ts", "value", "bucket")


@register(P + f"SELECT event_id, ts, ts // {W} + 1 AS bucket, (ts // {W}) * {W} AS bucket_start, ts // {W} AS n_buckets, (ts // {W}) * {W} AS floor_ts, CAST(13 * {W} AS BIGINT) AS kept_seconds FROM p")
def bucket_functions(spark, d):
    b = B.bucket(F.col("ts"), W)
    return pts(spark, d).select("event_id", "ts", b.alias("bucket"), B.bucket_start(b, W).alias("bucket_start"), B.buckets_in(F.col("ts"), W).alias("n_buckets"), B.floor_ts(F.col("ts"), W).alias("floor_ts"), B.duration(F.lit(13), W).cast("long").alias("kept_seconds"))


@register(P + f"SELECT shard_id, key, ts // {W} + 1 AS bucket, count(*) AS n_points FROM p GROUP BY ALL")
def bucket_counts(spark, d):
    return pts(spark, d).groupBy("shard_id", "key", B.bucket(F.col("ts"), W).alias("bucket")).agg(F.count(F.lit(1)).alias("n_points"))


@register(P + f"SELECT shard_id, key, ts // {W} + 1 AS bucket, count(*) AS n_points, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(value, (ts, arrival, event_id)) AS first_value, arg_max(value, (ts, arrival, event_id)) AS last_value FROM p GROUP BY ALL")
def bucket_blocks(spark, d):
    return lifecycle.blocks(pts(spark, d), W)


@register(P + f"SELECT shard_id, key, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY shard_id, key ORDER BY ts, arrival) AS n FROM p) WHERE n <= 5 AND ts BETWEEN {DAY0 + 86400} AND {NOW}")
def read_values_limit(spark, d):
    return read.first_points(pts(spark, d), 5, DAY0 + 86400, NOW).select("shard_id", "key", "ts", "value")


@register(PK + "SELECT shard_id, key, key_id, 40 + 25 < (SELECT count(*) FROM k) AS has_more FROM (SELECT * FROM k ORDER BY key_id, shard_id, key LIMIT 25 OFFSET 40)")
def get_some_page(spark, d):
    return read.page(catalog.key_ids(pts(spark, d)), 40, 25)


@register(PK + "SELECT * FROM k")
def get_everything(spark, d):
    return catalog.key_ids(pts(spark, d))


@register(f"WITH {_p()}, {_SHARDS} SELECT shard_id, key, ts, value FROM p WHERE shard_id IN (SELECT shard_id FROM s WHERE state IN {_READABLE})")
def owned_shards_only(spark, d):
    return read.readable(pts(spark, d), shards(spark)).select("shard_id", "key", "ts", "value")


@register(P + "SELECT event_id, key || '@' || shard_id || ' ' || ts || '=' || printf('%.2f', value) AS line FROM p")
def print_debug(spark, d):
    return pts(spark, d).select("event_id", F.format_string("%s@%d %d=%.2f", "key", "shard_id", "ts", "value").alias("line"))


# -- admission ---------------------------------------------------------------------------------------------------

_ADMIT = "SELECT *, COALESCE(ts >= max(ts) OVER (PARTITION BY shard_id, key ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS admitted FROM p"


@register(PJ + f"SELECT shard_id, key, ts, value, event_id FROM ({_ADMIT}) WHERE admitted")
def admit_min_delta_0(spark, d):
    return admit.admit_window(pts(spark, d, jitter=JITTER)).where("admitted").select("shard_id", "key", "ts", "value", "event_id")


@register(f"WITH RECURSIVE {_p(jitter=JITTER)}, o AS (SELECT *, row_number() OVER (PARTITION BY shard_id, key ORDER BY arrival, event_id) AS n FROM p), t AS (SELECT shard_id, key, n, ts, value, event_id, ts AS last, true AS ok FROM o WHERE n = 1 UNION ALL SELECT o.shard_id, o.key, o.n, o.ts, o.value, o.event_id, CASE WHEN o.ts - t.last >= 86400 THEN o.ts ELSE t.last END, o.ts - t.last >= 86400 FROM t JOIN o ON o.shard_id = t.shard_id AND o.key = t.key AND o.n = t.n + 1) SELECT shard_id, key, ts, value, event_id FROM t WHERE ok")
def admit_min_delta_k(spark, d):
    return admit.admit_fold(pts(spark, d, jitter=JITTER), 86400).select("shard_id", "key", "ts", "value", "event_id")


@register(PJ + f"SELECT shard_id, count(*) AS attempted, count(*) FILTER (WHERE admitted) AS accepted FROM ({_ADMIT}) GROUP BY shard_id")
def put_counts(spark, d):
    return admit.put_counts(pts(spark, d, jitter=JITTER))


_AT = DAY0 + 10 * 86400


@register(P + f"SELECT event_id, CASE WHEN ts = 0 OR ts < {_AT - 900} OR ts > {_AT + 60} THEN {_AT} ELSE ts END AS ts FROM p")
def adjust_timestamp(spark, d):
    return pts(spark, d).select("event_id", admit.adjusted(F.col("ts"), _AT, DEFAULT.allowed_behind, DEFAULT.allowed_ahead).alias("ts"))


@register(P + f"SELECT b.shard_id, b.key, count(*) AS n_points, b.key NOT IN (SELECT key FROM p WHERE ts < {DAY0 + 5 * 86400}) AS is_new FROM p b WHERE b.ts >= {DAY0 + 5 * 86400} GROUP BY b.shard_id, b.key")
def new_vs_existing_keys(spark, d):
    p = pts(spark, d)
    return admit.new_and_known(p.where(F.col("ts") >= DAY0 + 5 * 86400), p.where(F.col("ts") < DAY0 + 5 * 86400))


@register(P + "SELECT ts, count(*) AS n_points FROM p GROUP BY ts")
def qps_per_second(spark, d):
    return pts(spark, d).groupBy("ts").agg(F.count(F.lit(1)).alias("n_points"))


# -- the key catalog ---------------------------------------------------------------------------------------------


@register(PK + "SELECT shard_id, key, key_id FROM k")
def key_ids(spark, d):
    return catalog.key_ids(pts(spark, d))


_RECORDS = "c AS (SELECT shard_id, event_id // 700 AS file_id, event_id AS seq, CAST(event_id % 97 AS INTEGER) AS key_id, key, CAST(event_id % 5 AS INTEGER) AS category FROM p), ok AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.shard_id = c.shard_id AND b.file_id = c.file_id AND b.seq <= c.seq AND b.key_id > 95))"


@register(f"WITH {_p()}, {_RECORDS}, l AS (SELECT *, row_number() OVER (PARTITION BY shard_id, key_id ORDER BY seq DESC) AS n FROM ok), m AS (SELECT *, row_number() OVER (PARTITION BY shard_id, key ORDER BY key_id) AS n2 FROM l WHERE n = 1) SELECT shard_id, seq, key_id, key, category FROM m WHERE n2 = 1")
def key_list_dedup(spark, d):
    records = pts(spark, d).selectExpr("shard_id", "event_id div 700 AS file_id", "event_id AS seq", "CAST(event_id % 97 AS INT) AS key_id", "key", "CAST(event_id % 5 AS INT) AS category")
    return catalog.dedup_records(records, DEFAULT.max_key_bytes, 95).drop("file_id")


@register(PK + ", h AS (SELECT * FROM k WHERE key_id % 3 <> 1) SELECT a.shard_id, CAST(a.i AS INTEGER) AS key_id FROM (SELECT shard_id, unnest(range(0, max(key_id) + 1)) AS i FROM h GROUP BY shard_id) a WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.shard_id = a.shard_id AND h.key_id = a.i)")
def free_ids(spark, d):
    return catalog.free_ids(catalog.key_ids(pts(spark, d)).where("key_id % 3 <> 1"))


@register(PK + ", h AS (SELECT * FROM k WHERE key_id % 3 <> 1), f AS (SELECT shard_id, i, row_number() OVER (PARTITION BY shard_id ORDER BY i) AS n FROM (SELECT shard_id, unnest(range(0, max(key_id) + 1)) AS i FROM h GROUP BY shard_id) a WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.shard_id = a.shard_id AND h.key_id = a.i)), t AS (SELECT shard_id, max(key_id) + 1 AS top FROM h GROUP BY shard_id), c AS (SELECT shard_id, count(*) AS c FROM f GROUP BY shard_id), w AS (SELECT shard_id, 'new:' || key AS key, row_number() OVER (PARTITION BY shard_id ORDER BY min(arrival), 'new:' || key) AS n FROM p GROUP BY shard_id, key) SELECT w.shard_id, w.key, CAST(coalesce(f.i, t.top + w.n - 1 - coalesce(c.c, 0)) AS INTEGER) AS key_id FROM w LEFT JOIN f ON f.shard_id = w.shard_id AND f.n = w.n LEFT JOIN t ON t.shard_id = w.shard_id LEFT JOIN c ON c.shard_id = w.shard_id")
def assigned_ids(spark, d):
    p = pts(spark, d)
    return catalog.assigned(catalog.key_ids(p).where("key_id % 3 <> 1"), p.withColumn("key", F.concat(F.lit("new:"), "key")))


@register(PK + "SELECT shard_id, key, key_id FROM k WHERE NOT (shard_id = 3 AND key = 'click:3')")
def erase_key(spark, d):
    return catalog.erase(catalog.key_ids(pts(spark, d)), spark.createDataFrame([(3, "click:3")], "shard_id int, key string"))


@register(PK + f"SELECT shard_id, key, key_id FROM k WHERE EXISTS (SELECT 1 FROM p WHERE p.shard_id = k.shard_id AND p.key = k.key AND p.ts >= {NOW})")
def compact_keys(spark, d):
    p = pts(spark, d)
    live = p.where(F.col("ts") >= NOW).select("shard_id", "key").distinct()
    return catalog.key_ids(p).join(live, ["shard_id", "key"], "left_semi")


@register(PK + "SELECT shard_id, count(*) AS n_series, max(key_id) + 1 AS table_size FROM k GROUP BY shard_id")
def series_per_shard(spark, d):
    return catalog.series_per_shard(catalog.key_ids(pts(spark, d)))


@register(P + f"SELECT shard_id, key, bool_or(ts >= {NOW}) AS has_data FROM p GROUP BY shard_id, key")
def has_data_points(spark, d):
    p = pts(spark, d)
    return catalog.has_data(p.select("shard_id", "key").distinct(), p.where(F.col("ts") >= NOW))


@register(PJ + "SELECT shard_id, key, COALESCE(arg_max(c, (arrival, event_id)), 0) AS category FROM (SELECT *, CAST(CASE WHEN event_id % 3 > 0 THEN event_id % 11 END AS INTEGER) AS c FROM p) GROUP BY shard_id, key")
def latest_category(spark, d):
    puts = pts(spark, d, jitter=JITTER).withColumn("category", F.expr("CAST(CASE WHEN event_id % 3 > 0 THEN event_id % 11 END AS INT)"))
    return catalog.latest_category(puts)


# -- blocks, retention, gaps, ownership --------------------------------------------------------------------------

_BLOCKS = f"b AS (SELECT shard_id, key, ts // {W} + 1 AS bucket, count(*) AS n_points FROM p GROUP BY ALL)"
_TARGET = lifecycle.last_closed(NOW, W, DEFAULT.allowed_behind, DEFAULT.finalize_slack)


@register(f"WITH {_p()}, {_BLOCKS} SELECT * FROM b WHERE bucket BETWEEN {_TARGET - 50} AND {_TARGET}")
def finalize_buckets(spark, d):
    return lifecycle.finalize(bucket_counts(spark, d), _TARGET, _TARGET - 51)


@register(f"WITH {_p()}, {_SHARDS}, f AS (SELECT shard_id, max(ts // {W} + 1) AS last_finalized FROM p WHERE ts < {DAY0} + shard_id * 259200 GROUP BY shard_id) SELECT shard_id, last_finalized, state = 'OWNED' AND coalesce(last_finalized, 0) <> 0 AND {_FIRST + 355} > last_finalized + 1 AS is_behind FROM s LEFT JOIN f USING (shard_id)")
def is_behind(spark, d):
    done = pts(spark, d).where(F.col("ts") < F.lit(DAY0) + F.col("shard_id") * 259200)
    done = done.groupBy("shard_id").agg(F.max(B.bucket(F.col("ts"), W)).alias("last_finalized"))
    return lifecycle.behind(shards(spark).join(done, "shard_id", "left"), _FIRST + 355)


@register(P + f"SELECT shard_id, key, ts, value, bucket FROM (SELECT *, ts // {W} + 1 AS bucket, max(ts // {W} + 1) OVER (PARTITION BY shard_id, key) AS m FROM p) WHERE bucket >= m - {KEEP}")
def retention_window(spark, d):
    return lifecycle.retained(pts(spark, d), W, KEEP).select("shard_id", "key", "ts", "value", "bucket")


@register(f"WITH {_p()}, {_BLOCKS} SELECT * FROM b WHERE bucket < {NOW // W + 1 - KEEP - 1}")
def retention_delete(spark, d):
    return lifecycle.expired(bucket_counts(spark, d), NOW, W, KEEP)


@register(P + f"SELECT shard_id, key, least(255, {_FIRST + 359} - max(ts // {W} + 1)) AS buckets_ago FROM p GROUP BY shard_id, key")
def queried_buckets_ago(spark, d):
    queried = bucket_counts(spark, d).groupBy("shard_id", "key").agg(F.max("bucket").alias("bucket_queried"))
    return lifecycle.queried_ago(queried, _FIRST + 359).withColumn("buckets_ago", F.col("buckets_ago").cast("long"))


@register(P + f", f AS (SELECT DISTINCT shard_id, ts // {W} + 1 AS id FROM p) SELECT shard_id, count(*) FILTER (WHERE n <> id + 1) AS n_holes FROM (SELECT *, lead(id) OVER (PARTITION BY shard_id ORDER BY id) AS n FROM f) GROUP BY shard_id")
def missing_block_files(spark, d):
    return lifecycle.missing_files(pts(spark, d).select("shard_id", B.bucket(F.col("ts"), W).alias("id")).distinct())


_START, _UP_TO = DAY0 + 2 * 86400, DAY0 + 31 * 86400  # where the last block begins, and the time of reading
_GAPS = f"o AS (SELECT shard_id, event_id, ts, max(ts) OVER (PARTITION BY shard_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p), a AS (SELECT shard_id, event_id, ts, CASE WHEN m > {_START} THEN m ELSE {_START} END AS newest_before FROM o UNION ALL SELECT shard_id, NULL, {_UP_TO}, CASE WHEN max(ts) > {_START} THEN max(ts) ELSE {_START} END FROM p GROUP BY shard_id), g AS (SELECT * FROM a WHERE ts - newest_before > 600 AND newest_before > 0)"


@register(f"WITH {_p()}, {_GAPS} SELECT * FROM g")
def missing_log_gaps(spark, d):
    return lifecycle.log_gaps(pts(spark, d), DEFAULT.log_gap, start=_START, now=_UP_TO)


@register(f"WITH {_p()}, e AS (SELECT shard_id, max(ts) AS t FROM (SELECT shard_id, ts, max(ts) OVER (PARTITION BY shard_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p WHERE shard_id < 7) WHERE ts - m > 600 AND m > 0 GROUP BY shard_id), h AS (SELECT DISTINCT shard_id FROM (SELECT shard_id, id, lead(id) OVER (PARTITION BY shard_id ORDER BY id) AS n FROM (SELECT DISTINCT shard_id, ts // {W} + 1 AS id FROM p)) WHERE n <> id + 1), q(shard_id, t) AS (VALUES (2, {_UP_TO + 5}), (8, {_UP_TO + 9})), s AS (SELECT shard_id FROM e UNION SELECT shard_id FROM h UNION SELECT shard_id FROM q) SELECT shard_id, CAST(coalesce(q.t, e.t, {_UP_TO}) AS BIGINT) AS reliable_from FROM s LEFT JOIN e USING (shard_id) LEFT JOIN q USING (shard_id)")
def reliable_start(spark, d):
    p = pts(spark, d)
    queued = spark.createDataFrame([(2, _UP_TO + 5), (2, _UP_TO), (8, _UP_TO + 9)], "shard_id int, at long")
    return lifecycle.reliable_from(lifecycle.log_gaps(p.where("shard_id < 7"), DEFAULT.log_gap), missing_block_files(spark, d), _UP_TO, queued)


_FILE = f"(ts + (event_id % 3) * 600) - (ts + (event_id % 3) * 600) % {W}"
# a file is read up to its first record outside [start of its bucket, start of the next one], if it starts no earlier than the last block
_REPLAY = f"l AS (SELECT *, {_FILE} AS file_ts FROM p), c AS (SELECT *, sum(CASE WHEN ts < file_ts // {W} * {W} OR ts > (file_ts // {W} + 1) * {W} THEN 1 ELSE 0 END) OVER (PARTITION BY shard_id, file_ts ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_bad FROM l WHERE file_ts >= {DAY0 + 100 * W}), t AS (SELECT shard_id, key, ts, event_id, key NOT LIKE 'view:%' AS known FROM c WHERE n_bad = 0)"


def _replay(spark, d) -> DataFrame:
    p = pts(spark, d).withColumn("file_ts", F.expr(_FILE))
    keys = p.where("key NOT LIKE 'view:%'").select("shard_id", "key")
    return lifecycle.replayed(p, keys, W, _FIRST + 100)


@register(f"WITH {_p()}, {_REPLAY} SELECT * FROM t")
def log_replay_filter(spark, d):
    return _replay(spark, d).select("shard_id", "key", "ts", "event_id", "known")


@register(f"WITH {_p()}, {_REPLAY} SELECT shard_id, count(*) AS n_records, count(*) FILTER (WHERE NOT known) AS n_unknown FROM t GROUP BY shard_id")
def unknown_keys(spark, d):
    return lifecycle.unknown_keys(_replay(spark, d))


@register(PJ + f"SELECT shard_id, event_id, first_value(ts) OVER (PARTITION BY shard_id, ts // {W} ORDER BY arrival, event_id) AS file_ts FROM p")
def log_file_assignment(spark, d):
    return lifecycle.log_files(pts(spark, d, jitter=JITTER), W).select("shard_id", "event_id", "file_ts")


_STATES = "st(r, state) AS (VALUES (0, 'PRE_UNOWNED'), (1, 'UNOWNED'), (2, 'PRE_OWNED'), (3, 'READING_KEYS'), (4, 'READING_KEYS_DONE'), (5, 'READING_LOGS'), (6, 'PROCESSING_QUEUED_DATA_POINTS'), (7, 'READING_BLOCK_DATA'), (8, 'OWNED'))"


@register(f"WITH {_STATES} SELECT a.state AS from_state, b.state AS to_state, b.r > a.r OR (a.r = 8 AND b.r = 0) AS set_state, a.r = 0 AND b.r = 8 AS cancel_unowning FROM st a CROSS JOIN st b")
def state_transitions(spark, d):
    return lifecycle.state_transitions(spark)


@register(f"WITH {_SHARDS} SELECT shard_id, state, CASE WHEN shard_id IN (1, 3, 5, 7) THEN CASE state WHEN 'UNOWNED' THEN 'add' WHEN 'PRE_UNOWNED' THEN 'cancel' END WHEN state = 'OWNED' THEN 'drop' END AS action FROM s WHERE (shard_id IN (1, 3, 5, 7) AND state IN ('UNOWNED', 'PRE_UNOWNED')) OR (shard_id NOT IN (1, 3, 5, 7) AND state = 'OWNED')")
def shard_reload_plan(spark, d):
    return lifecycle.reload_plan(shards(spark), spark.createDataFrame([(1,), (3,), (5,), (7,)], "shard_id int"))


@register(PT + "SELECT key, n_points, ts_block, n_points > 32767 AS refused FROM (SELECT key, ts // 2678400 AS ts_block, count(*) AS n_points FROM (SELECT 'all' AS key, ts FROM p UNION ALL SELECT 'twice', ts FROM p UNION ALL SELECT 'twice', ts FROM p UNION ALL SELECT key, ts FROM p) GROUP BY ALL)")
def oversize_blocks(spark, d):
    p = pts(spark, d, by_user=False).withColumn("key", F.explode(F.array(F.lit("all"), F.lit("twice"), F.lit("twice"), "key")))
    found = p.groupBy("key", F.call_function("div", F.col("ts"), F.lit(2678400)).alias("ts_block")).agg(F.count(F.lit(1)).alias("n_points"))
    big = lifecycle.oversize(found, DEFAULT.max_block_points).select("key", "ts_block", F.lit(True).alias("_big"))
    return found.join(big, ["key", "ts_block"], "left").select("key", "n_points", "ts_block", F.col("_big").isNotNull().alias("refused"))


# -- what the formats cost ---------------------------------------------------------------------------------------


@register(PT + f", a AS (SELECT *, ts // {W} + 1 AS bucket, ts - lag(ts) OVER w AS delta, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY shard_id, key, ts // {W} ORDER BY ts, arrival)), c AS (SELECT *, delta - CASE WHEN n = 2 THEN 60 ELSE lag(delta) OVER (PARTITION BY shard_id, key, bucket ORDER BY ts, arrival) END AS dod FROM a) SELECT shard_id, key, bucket, count(*) AS n_points, CAST(sum(CASE WHEN dod IS NULL THEN 32 WHEN dod = 0 THEN 1 WHEN dod BETWEEN -63 AND 64 THEN 9 WHEN dod BETWEEN -255 AND 256 THEN 12 WHEN dod BETWEEN -2047 AND 2048 THEN 16 ELSE 36 END) AS BIGINT) AS bits FROM c GROUP BY shard_id, key, bucket")
def timestamp_delta_classes(spark, d):
    b = codec_stats.timestamp_bits(pts(spark, d, by_user=False), W, DEFAULT.default_delta)
    return b.groupBy("shard_id", "key", "bucket").agg(F.count(F.lit(1)).alias("n_points"), F.sum("bits").alias("bits"))


@register(PT + f", a AS (SELECT shard_id, key, ts // {W} + 1 AS bucket, ts, arrival, CAST(xor(value::DOUBLE::BIT, COALESCE(lag(value::DOUBLE::BIT) OVER (PARTITION BY shard_id, key, ts // {W} ORDER BY ts, arrival), 0::DOUBLE::BIT)) AS VARCHAR) AS x FROM p) SELECT shard_id, key, bucket, ts, arrival, CAST(instr(x, '1') - 1 AS INTEGER) AS leading, CAST(instr(reverse(x), '1') - 1 AS INTEGER) AS trailing FROM a WHERE instr(x, '1') > 0")
def value_xor_profile(spark, d):
    return codec_stats.xor_profile(pts(spark, d, by_user=False), W)


@register(PK + ", a AS (SELECT p.shard_id, p.event_id, key_id, ts - COALESCE(lag(ts) OVER (PARTITION BY p.shard_id ORDER BY arrival, event_id), ts) AS delta FROM p JOIN k ON k.shard_id = p.shard_id AND k.key = p.key) SELECT shard_id, event_id, delta, CASE WHEN key_id < 2097152 THEN 22 ELSE 30 END + CASE WHEN delta = 0 THEN 1 WHEN delta BETWEEN -63 AND 64 THEN 9 WHEN delta BETWEEN -8191 AND 8192 THEN 17 ELSE 35 END AS bits FROM a")
def log_record_bits(spark, d):
    p = pts(spark, d)
    return codec_stats.log_bits(p, catalog.key_ids(p))


@register('WITH e AS (SELECT event_id, event_id * 7 % 262144 AS page, event_id * 13 % 65536 AS off, event_id * 17 % 32768 AS len, event_id * 19 % 32768 AS cnt FROM events) SELECT event_id, page % 131072 * 70368744177664 + off * 1073741824 + len * 32768 + cnt AS id, page, off AS "offset", len AS length, cnt AS "count" FROM e')
def storage_id_pack(spark, d):
    e = F.col("event_id")
    # an id whose page has its top bit set is negative as a BIGINT; the column shows the other 63 bits
    packed = bits.pack_storage_id(e * 7 % 262144, e * 13 % 65536, e * 17 % 32768, e * 19 % 32768)
    rows = spark.read.parquet(f"{d}/events.parquet").select(e, packed.alias("x"))
    fields = bits.unpack_storage_id(F.col("x"))
    return rows.select("event_id", F.col("x").bitwiseAND(F.lit((1 << 63) - 1)).alias("id"), *[c.alias(n) for n, c in fields.items()])


@register(P + f"SELECT shard_id, key, ts, value, row_number() OVER (PARTITION BY shard_id, key, ts // {W} ORDER BY ts, arrival) - 1 AS place FROM p")
def codec_round_trip(spark, d):
    return codec_stats.decode(codec_stats.encode(pts(spark, d), W))


@register()
def synthetic_series(spark, d):
    return source.synthetic(spark, 50, 200)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
