"""Live ingest: a stream of points, admitted series by series, into a Parquet table with a checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoframe.functions.buckets import bucket

ADMITTED = "shard_id int, key string, ts long, value double, arrival long, event_id long"


def admitted(stream: DataFrame, min_delta: int = 0) -> DataFrame:
    """The stream's admitted points; the state of a series is the last timestamp it took.

    A micro-batch may come in several frames, so all of a series are sorted by arrival before they are gone through.
    Rows without a timestamp are refused and change nothing.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).dropna(subset=["ts"]).sort_values(["arrival", "event_id"])
        rows["ts"] = rows["ts"].astype("int64")
        last = state.get[0] if state.exists else None
        taken = []
        for ts in rows["ts"].tolist():
            ok = last is None or (last == 0 and min_delta > 0) or ts - last >= min_delta
            taken.append(ok)
            last = ts if ok else last
        if last is not None:
            state.update((last,))
        yield rows[taken]

    return stream.groupBy("shard_id", "key").applyInPandasWithState(run, ADMITTED, "last long", "append", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, path: str, checkpoint: str, window: int, min_delta: int = 0):
    """Starts the query: admitted points, laid out by shard and bucket.  With availableNow it ends when the input does."""
    out = admitted(stream, min_delta).withColumn("bucket", bucket(F.col("ts"), window))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("shard_id", "bucket").outputMode("append").trigger(availableNow=True).start()


def into_epochs(stream: DataFrame, path: str, checkpoint: str, window: int, min_delta: int = 0):
    """As ``ingest``, with a folder for each micro-batch, which a repeated batch overwrites, so that buckets can be deleted.

    Returns the query and a list that gets the points admitted by each batch.
    """
    out, admitted_points = admitted(stream, min_delta).withColumn("bucket", bucket(F.col("ts"), window)), []

    def save(batch: DataFrame, epoch: int) -> None:
        seen = Observation()
        batch.observe(seen, F.count(F.lit(1)).alias("n")).sortWithinPartitions("shard_id", "bucket", "key", "ts", "arrival").write.mode("overwrite").partitionBy("shard_id", "bucket").parquet(f"{path}/epoch={epoch}")
        admitted_points.append(seen.get["n"])

    return out.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(), admitted_points


def bucket_counts(stream: DataFrame, lateness: str = "16 minutes", window: str = "2 hours") -> DataFrame:
    """Points of each series and bucket, given out once the watermark has passed the bucket; needs a TIMESTAMP column ``time``."""
    return stream.withWatermark("time", lateness).groupBy("shard_id", "key", F.window("time", window)).count()


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
