"""Connected components by alternating large and small stars over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.session import stored_table


def _stars(links: DataFrame) -> DataFrame:
    """``u, v, m``: each link and the smallest ``v`` of its ``u``.

    The minima are stored before they are joined: both sides are then plain shuffles, and adaptive
    execution can split a node with very many links, or broadcast if they are few.
    """
    low = stored_table(links.groupBy("u").agg(F.min("v").alias("m")))
    return links.join(low, "u")


def connected(links: DataFrame) -> DataFrame:
    """``node, root``: each node that has a link, and the smallest node that can be reached from it.

    ``links`` holds ``u, v`` of one orderable type. Every round is written to the shared folder, so plans
    stay short and a lost executor costs one round. Links of a node to itself and nulls are left out.
    """
    u, v = F.greatest("u", "v"), F.least("u", "v")
    links = stored_table(links.filter("u <> v").select(u.alias("u"), v.alias("v")).distinct())
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        starred = _stars(both).withColumn("m", F.least("m", "u"))
        large = starred.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        starred = _stars(stored_table(large))
        small = starred.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("_l"))
        links = stored_table(small.select("_l.*").filter("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
