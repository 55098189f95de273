"""Points as DataFrames: (shard_id, key, ts, value, arrival), and the tables around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType([
    T.StructField("shard_id", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("ts", T.LongType()),
    T.StructField("value", T.DoubleType()), T.StructField("arrival", T.LongType()),
])


def seconds(ts):
    """Whole Unix seconds of a timestamp without time zone, read as UTC."""
    return F.unix_seconds(ts.cast("timestamp"))


def points_from_events(events: DataFrame, shards: int = 10, by_user: bool = True, jitter: int = 0) -> DataFrame:
    """Points of an ``events`` table; ``jitter`` shifts the arrival order by up to so many places, ties go to event_id."""
    key = F.concat_ws(":", "event_type", F.col("user_id").cast("string")) if by_user else F.col("event_type")
    arrival = F.col("event_id") + (F.col("event_id") * 7919) % jitter if jitter else F.col("event_id")
    return events.select((F.col("user_id") % shards).cast("int").alias("shard_id"), key.alias("key"), seconds(F.col("ts")).alias("ts"), "value", arrival.alias("arrival"), "event_id")


def load(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """Points of the folder's events."""
    return points_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), **how)


def write_points(points: DataFrame, path: str, window: int) -> None:
    """Points laid out by shard and bucket and sorted in each file, so that range reads prune folders and row groups."""
    from chronoframe.functions.buckets import bucket

    laid = points.withColumn("bucket", bucket(F.col("ts"), window))
    laid.repartition("shard_id", "bucket").sortWithinPartitions("shard_id", "bucket", "key", "ts").write.partitionBy("shard_id", "bucket").parquet(path)


def synthetic(spark: SparkSession, keys: int, n: int) -> DataFrame:
    """Test series: steps of 55 to 64 seconds from 0, values from 100 to 149, shard = key number + 1."""
    grid = spark.range(keys * n).select((F.col("id") / n).cast("int").alias("k"), (F.col("id") % n).alias("arrival"))
    step = F.when(F.col("arrival") == 0, 0).otherwise(F.pmod(F.xxhash64("k", "arrival"), F.lit(10)) + 55)
    by = Window.partitionBy("k").orderBy("arrival")
    return grid.select(
        (F.col("k") + 1).alias("shard_id"), F.concat(F.lit("series"), F.lpad(F.col("k").cast("string"), 4, "0")).alias("key"),
        F.sum(step).over(by).alias("ts"), (F.pmod(F.xxhash64("arrival", "k"), F.lit(50)) + 100).cast("double").alias("value"), "arrival",
    )
