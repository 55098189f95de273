"""Range reads.  Both ends of a range are included.  ``in_range`` and ``spanned`` emit the bucket and the time predicate, so
that a table laid out by bucket prunes folders and the time range prunes row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.config import READABLE
from chronoframe.functions.buckets import bucket

SERIES = ["shard_id", "key"]


def in_range(points: DataFrame, begin: int, end: int, window: int | None = None) -> DataFrame:
    out = points.where(F.col("ts").between(begin, end))
    if window and "bucket" in points.columns:
        out = out.where(F.col("bucket").between(int(begin / window) + 1, int(end / window) + 1))
    return out


def get_one(points: DataFrame, shard_id: int, key: str, begin: int, end: int, window: int | None = None) -> DataFrame:
    """One series' points in [begin, end], oldest first."""
    return in_range(points.where((F.col("shard_id") == shard_id) & (F.col("key") == key)), begin, end, window).orderBy("ts", "arrival")


def get(points: DataFrame, requests: DataFrame, strict_keys: DataFrame | None = None) -> DataFrame:
    """Points of each request (req_idx, shard_id, key, begin, end), in request order, then by time.

    With ``strict_keys``, a request for a series that isn't there raises KeyError, as the first bad key
    aborts a call; ``missing`` gives such requests as rows.  Requests are joined without a hint: Spark
    broadcasts them when they are small, and shuffles otherwise.
    """
    if strict_keys is not None and (bad := missing(strict_keys, requests).orderBy("req_idx").first()):
        raise KeyError(bad["key"])
    joined = requests.join(points, SERIES).where(F.col("ts").between(F.col("begin"), F.col("end")))
    return joined.select("req_idx", *SERIES, "ts", "value", "arrival").orderBy("req_idx", "ts", "arrival")


def spanned(points: DataFrame, requests: DataFrame, window: int, pushed_keys: int = 1000, keep: int | None = None) -> DataFrame:
    """The points that any of the requests can ask for, by conditions that reach the scan: their shards, the time from the
    earliest begin to the latest end with its buckets, and the keys if they are at most ``pushed_keys``.

    With ``keep``, points more than so many buckets before their series' newest one are left out.  ``get`` on the result
    gives what it gives on ``points``.
    """
    span = requests.agg(F.min("begin"), F.max("end"), F.collect_set("shard_id")).first()  # at most all shards
    if not span[2] or span[0] is None or span[1] is None:
        return points.limit(0)
    own = points.where(F.col("shard_id").isin(*sorted(span[2])))
    keys = [r[0] for r in requests.select("key").distinct().limit(pushed_keys + 1).collect()]
    if len(keys) <= pushed_keys:
        own = own.where(F.col("key").isin(*keys))
    out = in_range(own, span[0], span[1], window)
    if keep is not None:
        newest = own.join(requests.select(*SERIES).distinct(), SERIES, "left_semi").groupBy(*SERIES).agg(F.max("bucket").alias("_new"))
        out = out.join(newest, SERIES).where(F.col("bucket") >= F.col("_new") - keep).drop("_new")
    return out


def bucket_window(current: Column | int, keep: int, first: Column | int, last: Column | int) -> tuple[Column, Column]:
    """A range of buckets, clamped to those that a series whose newest bucket is ``current`` keeps."""
    now = F.lit(current) if isinstance(current, int) else current
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return F.greatest(first, now - keep), F.least(last, now)


def get_lists(points: DataFrame, requests: DataFrame) -> DataFrame:
    """As ``get``, a row for each request: its points as an array in time order, empty where there are none."""
    hit = requests.join(points, SERIES).where(F.col("ts").between(F.col("begin"), F.col("end")))
    lists = hit.groupBy("req_idx").agg(F.array_sort(F.collect_list(F.struct("ts", "arrival", "value"))).alias("p"))
    return requests.join(lists, "req_idx", "left").select("req_idx", *SERIES, F.coalesce(F.transform("p", lambda x: F.struct(x["ts"], x["value"])), F.array().cast("array<struct<ts:bigint,value:double>>")).alias("points"))


def missing(keys: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests for series that aren't there."""
    return requests.join(keys.select(*SERIES), SERIES, "left_anti")


def counts_in_range(keys: DataFrame, points: DataFrame, begin: int, end: int) -> DataFrame:
    """Points of every known series in the range, 0 where there are none."""
    some = in_range(points, begin, end).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))
    return keys.select(*SERIES).join(some, SERIES, "left").select(*SERIES, F.coalesce("n", F.lit(0)).alias("n_points"))


def bucket_range(points: DataFrame, first: int, last: int, window: int, keep: int | None = None) -> DataFrame:
    """Points of the buckets [first, last]; with ``keep``, of those only what each series keeps: its newest bucket and so many before.

    A stored column ``bucket`` prunes folders; the time range is given too, so that row groups are skipped.
    """
    if "bucket" not in points.columns:
        points = points.withColumn("bucket", bucket(F.col("ts"), window))
    out = points.where(F.col("bucket").between(first, last))
    if first > 1:
        out = out.where(F.col("ts").between((first - 1) * window, last * window - 1))
    if keep is not None:
        newest = points.groupBy(*SERIES).agg(F.max("bucket").alias("_new"))
        low, high = bucket_window(F.col("_new"), keep, first, last)
        out = out.join(newest, SERIES).where(F.col("bucket").between(low, high)).drop("_new")
    return out


def first_points(points: DataFrame, n: int, begin: int, end: int) -> DataFrame:
    """At most n points from each series' start, of which those in the range: the limit comes before the range."""
    by = Window.partitionBy(*SERIES).orderBy("ts", "arrival")
    return points.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n").where(F.col("ts").between(begin, end))


def page(keys: DataFrame, offset: int, count: int) -> DataFrame:
    """Rows offset .. offset + count of the series in key_id order, with whether more follow."""
    rows = keys.orderBy("key_id", *SERIES).offset(offset).limit(count + 1)  # one more tells whether any follow
    by = Window.partitionBy(F.lit(0)).orderBy("key_id", *SERIES)
    rows = rows.withColumn("_n", F.row_number().over(by)).withColumn("has_more", F.max("_n").over(Window.partitionBy(F.lit(0))) > count)
    return rows.where(F.col("_n") <= count).drop("_n")


def readable(points: DataFrame, shards: DataFrame) -> DataFrame:
    """Points of shards in a state that serves reads."""
    return points.join(shards.where(F.col("state").isin(*READABLE)).select("shard_id"), "shard_id", "left_semi")
