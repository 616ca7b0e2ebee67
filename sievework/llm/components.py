"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; tables are written between steps, so a lost
executor costs one step, and no neighbourhood is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "large-star")
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(down.groupBy("a").agg(F.min("b").alias("m")), "small-star")
    met = down.join(least, "a")
    return met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b`` (links of integer nodes) to ``node``, ``root``: the least node reachable.

    Self-links, repeats and both directions are allowed; nodes without a link to another
    node are left out, and so are links with a null.
    """
    now = stage(edges.filter("a <> b").select("a", "b").distinct(), "links")

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    was = None
    while (is_now := state(now)) != was and is_now[0]:
        was = is_now
        now = stage(_small_star(stage(_large_star(now), "large-star-links")), "small-star-links")
    rooted = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())
