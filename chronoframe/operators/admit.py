"""Admission: which arriving points a series takes, in arrival order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["shard_id", "key"]
ORDER = ["arrival", "event_id"]


#: Arrivals of a block of ``newest_before``.
SPAN = 1_000_000


def newest_before(points: DataFrame, by: list[str], span: int = SPAN) -> DataFrame:
    """Adds newest_before, the largest ts of earlier arrivals with the same ``by``; null if there is none.

    Arrivals are cut into blocks, each a task's group of its own, and the maximum of all earlier blocks comes
    from a table with a row for each block.  So one hot series or shard is spread over as many tasks as it has
    blocks.  Null arrivals come first; columns of ``by`` shouldn't be null.
    """
    rows = points.withColumn("_block", F.expr(f"arrival div {span}"))
    tops = rows.groupBy(*by, "_block").agg(F.max("ts").alias("_top"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*by, "_block", F.max("_top").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*by, "_block").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carried, [*by, "_block"], "left")
    return joined.withColumn("newest_before", F.greatest("_carried", F.max("ts").over(inside))).drop("_block", "_carried")


def admit_window(points: DataFrame, span: int = SPAN) -> DataFrame:
    """Minimum step 0: a point is taken if no earlier arrival of its series is newer.  A refused point can't raise
    the maximum, so a running maximum is exact."""
    newest = F.col("newest_before")
    return newest_before(points, SERIES, span).withColumn("admitted", newest.isNull() | (F.col("ts") >= newest)).drop("newest_before")


def admit_fold(points: DataFrame, min_delta: int) -> DataFrame:
    """Any minimum step: a pass over each series in arrival order that carries the last taken timestamp.

    A series lies in one task, since each decision needs the one before, but its rows stream through sorted and
    only the carried timestamp is held.  A last timestamp of 0 doesn't refuse anything, as it also means that there
    is none.  Null timestamps are refused.
    """
    laid = points.select(*SERIES, *[c for c in points.columns if c not in SERIES]).repartition(*SERIES).sortWithinPartitions(*SERIES, *ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, last = None, 0
        for batch in batches:
            taken = []
            for shard, key, ts in zip(*(batch.column(c).to_pylist() for c in (*SERIES, "ts")), strict=True):
                if (shard, key) != series:
                    series, last = (shard, key), 0
                ok = ts is not None and (last == 0 or ts - last >= min_delta)
                if ok:
                    last = ts
                taken.append(ok)
            yield batch.filter(pa.array(taken, pa.bool_()))

    return laid.mapInArrow(run, laid.schema)


def adjusted(ts: Column, now: int, behind: int, ahead: int) -> Column:
    """Timestamps that are 0, too old or too far ahead become now."""
    return F.when((ts == 0) | (ts < now - behind) | (ts > now + ahead), F.lit(now)).otherwise(ts)


def put_counts(points: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """Attempted and accepted points of each shard."""
    if owned is not None:
        points = points.join(owned.select("shard_id"), "shard_id", "left_semi")
    return admit_window(points.where(F.col("key") != "")).groupBy("shard_id").agg(F.count(F.lit(1)).alias("attempted"), F.count_if("admitted").alias("accepted"))


def new_and_known(batch: DataFrame, keys: DataFrame) -> DataFrame:
    """Whether each series of a batch is new, and its points."""
    known = keys.select(*SERIES, F.lit(True).alias("_k")).distinct()
    return batch.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n_points")).join(known, SERIES, "left").select(*SERIES, "n_points", F.col("_k").isNull().alias("is_new"))
