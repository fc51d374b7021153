"""Connected components over a table of links, by alternating large-star and small-star rounds.

Each round is two joins with minima per node (pre-aggregated before their
shuffle), so no node's neighbours are ever gathered, and each round's links
are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm import common


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node near it."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them.  Links come as (larger, smaller)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    near = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return near.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component), the component being the least node reachable; nodes without links don't appear.

    Links may repeat, point either way, or join a node with itself; those
    with a null end are no links.
    """
    spark = links.sparkSession
    at = common.cut(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y")).where("x and y and a <> b").select("a", "b").distinct(),
        "links",
    )
    before = None
    for _ in range(rounds):
        new = common.cut(_small(_large(at)), "links")
        common.remove(spark, at)
        at = new
        now = tuple(at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first())
        if now == before and now[0] == now[2]:
            break
        before = now
    else:
        raise RuntimeError("the components didn't settle")
    # now each node but the least of its component has exactly one link, to the least
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
