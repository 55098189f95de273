"""Connected components of an edge table, by large-star and small-star steps (Kiveris et al., 2014).

Each step is a shuffle of the edges; none gathers a component in one task: the smallest neighbour of a
node comes from an aggregation and is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.storage import dropped, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours to its smallest one: the larger neighbours, or the smaller ones and the node."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    linked = both.join(low, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    out = out.where("u <> v")
    return out if large else out.distinct()  # repeats do no harm to the step that follows


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    ``edges`` has long columns u and v without nulls; direction and repeats don't matter.
    """
    spark = edges.sparkSession
    now = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = None
    while True:
        # the edge set stops changing when every node points at its component
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        following = written(_star(_star(now, True), False), "edges")
        dropped(spark, now)
        now = following
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
