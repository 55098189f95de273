"""The key catalog: ids of series, their categories, and what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["shard_id", "key"]


#: First arrivals of a block of ``key_ids``.
SPAN = 1_000_000


def key_ids(points: DataFrame, span: int = SPAN) -> DataFrame:
    """(shard_id, key, key_id): ids count from 0 in each shard, in order of first arrival.

    First arrivals are cut into blocks, each numbered by itself, and what earlier blocks hold comes from a table with a
    row for each block, so a shard of many series is spread over tasks.
    """
    first = points.groupBy(*SERIES).agg(F.min(F.struct("arrival", "event_id")).alias("f")).withColumn("_block", F.expr(f"f.arrival div {span}"))
    sizes = first.groupBy("shard_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("shard_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard_id", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard_id", "_block").orderBy("f", "key")
    numbered = first.withColumn("_n", F.row_number().over(inside)).join(sizes, ["shard_id", "_block"])
    return numbered.select(*SERIES, (F.col("_before") + F.col("_n") - 1).cast("int").alias("key_id"))


def assigned(catalog: DataFrame, fresh: DataFrame) -> DataFrame:
    """Ids for new series (shard_id, key, arrival): the smallest free id of the shard first, then those after its largest.

    ``catalog`` is (shard_id, key_id, ...).  Returns (shard_id, key, key_id), in order of first arrival.
    """
    wanted = fresh.groupBy(*SERIES).agg(F.min("arrival").alias("arrival")).withColumn("event_id", F.lit(0))
    wanted = key_ids(wanted).withColumnRenamed("key_id", "_place")
    top = catalog.groupBy("shard_id").agg((F.max("key_id") + 1).alias("_top"))
    free = free_ids(catalog).select("shard_id", F.lit("").alias("key"), F.col("key_id").cast("long").alias("arrival"), F.lit(0).alias("event_id"), F.col("key_id").alias("_free"))
    # free ids in ascending order, numbered by the same blocks
    places = key_ids(free.withColumn("key", F.col("_free").cast("string"))).select("shard_id", F.col("key").cast("int").alias("_free"), F.col("key_id").alias("_place"))
    n_free = places.groupBy("shard_id").agg(F.count(F.lit(1)).cast("int").alias("_n_free"))
    out = wanted.join(places, ["shard_id", "_place"], "left").join(top, "shard_id", "left").join(n_free, "shard_id", "left")
    beyond = F.coalesce("_top", F.lit(0)) + F.col("_place") - F.coalesce("_n_free", F.lit(0))
    return out.select(*SERIES, F.coalesce("_free", beyond).cast("int").alias("key_id"))


def dedup_records(records: DataFrame, max_key_bytes: int, max_id: int) -> DataFrame:
    """Live keys of key lists (shard_id, seq, key_id, key, category): the last record of an id wins, then a key's lowest id.

    A record with too long a key or too large an id ends its file (``file_id``, or the shard's one file): what follows
    in it isn't read.
    """
    file = ["shard_id", "file_id"] if "file_id" in records.columns else ["shard_id"]
    size = F.octet_length("key") if dict(records.dtypes)["key"] == "string" else F.length("key")
    bad = records.where((size >= max_key_bytes) | (F.col("key_id") > max_id)).groupBy(*file).agg(F.min("seq").alias("_bad"))
    ok = records.join(bad, file, "left").where(F.col("_bad").isNull() | (F.col("seq") < F.col("_bad"))).drop("_bad").where(size > 0)
    last = ok.withColumn("_n", F.row_number().over(Window.partitionBy("shard_id", "key_id").orderBy(F.desc("seq")))).where("_n = 1")
    return last.withColumn("_n", F.row_number().over(Window.partitionBy(*SERIES).orderBy("key_id"))).where("_n = 1").drop("_n")


def free_ids(keys: DataFrame) -> DataFrame:
    """Ids under each shard's largest that no key has; the smallest is given out first."""
    top = keys.groupBy("shard_id").agg(F.max("key_id").alias("m"))
    every = top.select("shard_id", F.explode(F.sequence(F.lit(0), F.col("m"))).alias("key_id"))
    return every.join(keys, ["shard_id", "key_id"], "left_anti")


def erase(keys: DataFrame, gone: DataFrame) -> DataFrame:
    return keys.join(gone.select(*SERIES), SERIES, "left_anti")


def latest_category(puts: DataFrame) -> DataFrame:
    """The category of each series' last put that carries one, else 0."""
    last = F.max_by("category", F.when(F.col("category").isNotNull(), F.struct("arrival", "event_id")))
    return puts.groupBy(*SERIES).agg(F.coalesce(last, F.lit(0)).alias("category"))


def series_per_shard(keys: DataFrame) -> DataFrame:
    return keys.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_series"), (F.max("key_id") + 1).alias("table_size"))


def has_data(keys: DataFrame, points: DataFrame) -> DataFrame:
    """Whether each known series has any point."""
    some = points.select(*SERIES).distinct().withColumn("_h", F.lit(True))
    return keys.select(*SERIES).join(some, SERIES, "left").select(*SERIES, F.col("_h").isNotNull().alias("has_data"))
