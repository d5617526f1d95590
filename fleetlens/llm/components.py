"""Connected components of a distributed list of links, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_shared


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link to another.

    In each round every node hooks onto the neighbour (or itself) that comes first in an order drawn anew for the round;
    links are renamed, and those inside one hook go. A hub with many links is pre-aggregated by Spark's partial sums.
    Names are written each round, so that the last plan does not hold those of all rounds.
    """
    edges = write_shared(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    names = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("at", F.col("node"))
    k = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        order = F.xxhash64(F.lit(k), "b")
        hook = both.groupBy("a").agg(F.min_by("b", order).alias("b"), F.min(order).alias("first"))
        hook = hook.select(F.col("a").alias("old"), F.when(F.xxhash64(F.lit(k), "a") < F.col("first"), F.col("a")).otherwise(F.col("b")).alias("new"))
        hook = write_shared(hook, "hooks")
        renamed = edges.join(hook, edges.a == hook.old).select(F.col("new").alias("a"), "b")
        renamed = renamed.join(hook, renamed.b == hook.old).select("a", F.col("new").alias("b")).filter("a <> b")
        edges = write_shared(renamed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        names = write_shared(names.join(hook, names.at == hook.old, "left").select("node", F.coalesce("new", "at").alias("at")), "names")
        k += 1
    smallest = names.groupBy("at").agg(F.min("node").alias("component"))
    return names.join(smallest, "at").select("node", "component")
