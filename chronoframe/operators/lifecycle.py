"""Blocks, retention, finalization, gaps, and the ownership of shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.config import STATES
from chronoframe.functions.buckets import bucket, bucket_start
from chronoframe.operators.admit import ORDER, SPAN, newest_before

SERIES = ["shard_id", "key"]


def blocks(points: DataFrame, window: int) -> DataFrame:
    """A row for each series and bucket: count, ends, and the first and last value by (ts, arrival, event_id)."""
    at = F.struct("ts", "arrival", "event_id")
    return points.groupBy(*SERIES, bucket(F.col("ts"), window).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"),
    )


def oversize(found: DataFrame, points: int, size: int | None = None) -> DataFrame:
    """Blocks that a page can't take: of more than so many points or, where their bytes (n_bytes) are known, bytes."""
    big = F.col("n_points") > points
    return found.where(big if size is None else big | (F.col("n_bytes") > size))


def last_closed(now: int, window: int, behind: int, slack: int) -> int:
    """The newest bucket that may be finalized at ``now``."""
    return int((now - (slack + behind) - window) / window) + 1


def finalize(found: DataFrame, target: int, last_finalized: int = 0) -> DataFrame:
    """Blocks that finalizing up to ``target`` seals: those after the last finalized bucket, or just the target's if none is."""
    first = last_finalized + 1 if last_finalized else target
    return found.where(F.col("bucket").between(first, target))


def behind(shards: DataFrame, target: int) -> DataFrame:
    """Whether each shard (shard_id, state, last_finalized) is owned, has finalized a bucket, and that is more than one behind the target."""
    last = F.coalesce("last_finalized", F.lit(0))
    return shards.select("shard_id", "last_finalized", ((F.col("state") == "OWNED") & (last != 0) & (F.lit(target) > last + 1)).alias("is_behind"))


def retained(points: DataFrame, window: int, keep: int) -> DataFrame:
    """Points of each series' newest bucket and the ``keep`` before it."""
    with_bucket = points.withColumn("bucket", bucket(F.col("ts"), window))
    newest = with_bucket.groupBy(*SERIES).agg(F.max("bucket").alias("_new"))
    return with_bucket.join(newest, SERIES).where(F.col("bucket") >= F.col("_new") - keep).drop("_new")


def oldest_kept(now: int, window: int, keep: int) -> int:
    """The oldest bucket that retention keeps at ``now``."""
    return int(now / window) + 1 - keep - 1


def expired(found: DataFrame, now: int, window: int, keep: int) -> DataFrame:
    """Buckets that retention deletes at ``now``."""
    return found.where(F.col("bucket") < oldest_kept(now, window, keep))


def queried_ago(queried: DataFrame, now_bucket: int) -> DataFrame:
    """Buckets since each series was last read, 255 at most."""
    return queried.select(*SERIES, F.least(F.lit(255), F.lit(now_bucket) - F.col("bucket_queried")).alias("buckets_ago"))


def missing_files(files: DataFrame) -> DataFrame:
    """Holes in each shard's completed block files (shard_id, id)."""
    following = F.lead("id").over(Window.partitionBy("shard_id").orderBy("id"))
    return files.withColumn("_n", following).groupBy("shard_id").agg(F.count_if(F.col("_n") != F.col("id") + 1).alias("n_holes"))


def log_gaps(points: DataFrame, limit: int, span: int = SPAN, start: int = 0, now: int | None = None) -> DataFrame:
    """Places in each shard's log where time jumps by more than ``limit`` seconds.

    A log goes on from ``start``, where the last block begins (0 if there is none), and up to ``now``, whose gap is a row
    without event_id.  Before the first record of a log without a block, and after time 0, there is no gap.
    """
    seen = newest_before(points, ["shard_id"], span).select("shard_id", "event_id", "ts", F.greatest(F.lit(start), "newest_before").alias("newest_before"))
    if now is not None:
        last = points.groupBy("shard_id").agg(F.greatest(F.lit(start), F.max("ts")).alias("newest_before"))
        seen = seen.unionByName(last.select("shard_id", F.lit(None).cast("long").alias("event_id"), F.lit(now).cast("long").alias("ts"), "newest_before"))
    return seen.where((F.col("newest_before") > 0) & (F.col("ts") - F.col("newest_before") > limit))


def reliable_from(gaps: DataFrame, holes: DataFrame | None = None, loaded: int | None = None, queued: DataFrame | None = None) -> DataFrame:
    """From when each shard's data is whole: the end of its last gap.

    A hole in its block files (shard_id, n_holes) is found before the logs are read, at ``loaded``, so it counts where the
    logs have no gap; points queued while it loads (shard_id, at) count after both.
    """
    out = gaps.groupBy("shard_id").agg(F.max("ts").alias("reliable_from"))
    if holes is not None:
        bad = holes.where("n_holes > 0").select("shard_id", F.lit(loaded).cast("long").alias("_h"))
        out = out.join(bad, "shard_id", "full").select("shard_id", F.coalesce("reliable_from", "_h").alias("reliable_from"))
    if queued is not None:
        last = queued.groupBy("shard_id").agg(F.max("at").alias("_q"))
        out = out.join(last, "shard_id", "full").select("shard_id", F.coalesce("_q", "reliable_from").alias("reliable_from"))
    return out


def replayed(log: DataFrame, keys: DataFrame, window: int, last_block: int) -> DataFrame:
    """Log records (shard_id, file_ts, arrival, event_id, key, ts, ...) that a replay takes, and whether their key is known.

    Files that start before the last block does are covered by it; without one (0) all are read.  A file's records lie in
    its bucket, the next one's first second included; from the first that doesn't, nothing of the file is trusted.
    """
    log = log if last_block == 0 else log.where(F.col("file_ts") >= (last_block - 1) * window)
    begin = bucket_start(bucket(F.col("file_ts"), window), window)
    bad = ~F.col("ts").between(begin, begin + window)
    first_bad = log.where(bad).groupBy("shard_id", "file_ts").agg(F.min(F.struct(*ORDER)).alias("_bad"))
    ok = log.join(first_bad, ["shard_id", "file_ts"], "left").where(F.col("_bad").isNull() | (F.struct(*ORDER) < F.col("_bad"))).drop("_bad")
    return ok.join(keys.select(*SERIES, F.lit(True).alias("_k")).distinct(), SERIES, "left").withColumn("known", F.col("_k").isNotNull()).drop("_k")


def unknown_keys(replay: DataFrame) -> DataFrame:
    """Replayed records of each shard, and those whose key isn't known."""
    return replay.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(~F.col("known")).alias("n_unknown"))


def log_files(points: DataFrame, window: int) -> DataFrame:
    """Each record's log file: named by the first timestamp seen of its shard and bucket."""
    rows = points.withColumn("_b", bucket(F.col("ts"), window))
    first = rows.groupBy("shard_id", "_b").agg(F.min_by("ts", F.struct(*ORDER)).alias("file_ts"))
    return rows.join(first, ["shard_id", "_b"]).drop("_b")


def allowed(now: str, to: str) -> bool:
    return STATES.index(to) > STATES.index(now) or (now, to) == ("OWNED", "PRE_UNOWNED")


def state_transitions(spark) -> DataFrame:
    """All pairs of the nine states with whether the change is allowed: to a later one, or from OWNED to PRE_UNOWNED;
    and whether it is the cancelling of an unowning."""
    every = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(x).alias("state")) for k, x in enumerate(STATES)))
    pairs = spark.range(1).select(F.explode(every).alias("a")).select("a", F.explode(every).alias("b"))
    unowning = (F.col("a.state") == "OWNED") & (F.col("b.state") == "PRE_UNOWNED")
    cancelled = (F.col("a.state") == "PRE_UNOWNED") & (F.col("b.state") == "OWNED")
    return pairs.select(F.col("a.state").alias("from_state"), F.col("b.state").alias("to_state"), ((F.col("b.rank") > F.col("a.rank")) | unowning).alias("set_state"), cancelled.alias("cancel_unowning"))


def checked_transition(now: str, to: str) -> str:
    """The new state, or ValueError where the change isn't allowed."""
    if allowed(now, to):
        return to
    raise ValueError(f"a shard can't go from {now} to {to}")


def reload_plan(shards: DataFrame, desired: DataFrame) -> DataFrame:
    """What a change of ownership does: add, cancel an unowning, or drop."""
    wanted = desired.select("shard_id", F.lit(True).alias("_w")).distinct()
    act = F.when(F.col("_w") & (F.col("state") == "UNOWNED"), "add").when(F.col("_w") & (F.col("state") == "PRE_UNOWNED"), "cancel").when(F.col("_w").isNull() & (F.col("state") == "OWNED"), "drop")
    return shards.join(wanted, "shard_id", "left").select("shard_id", "state", act.alias("action")).where("action IS NOT NULL")
