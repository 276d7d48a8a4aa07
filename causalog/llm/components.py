"""Connected components by alternating star contractions (Kiveris et al., 2014)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalog.llm.common import sized_broadcast, stable


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(neighbours: DataFrame) -> DataFrame:
    # Written once: the join then has plain exchanges on both sides, which adaptive
    # execution can split where one node has very many neighbours.
    return sized_broadcast(stable(neighbours.groupBy("u").agg(F.min("v").alias("m"))))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_least(both), "u").where("v > u")
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    moved = edges.join(_least(edges), "u")
    own = moved.select("u", F.col("m").alias("v"))
    other = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(other).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): the least node it is connected with.

    Roots themselves are listed; links of a node to itself and repeated links do no harm.
    Every round writes its links to the checkpoint folder.  The rounds grow with the
    logarithm of the longest chain; nothing but a count and a checksum reaches the driver.
    """
    edges = stable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while (now := _state(edges)) != before and now[0]:
        before = now
        edges = stable(_small_star(stable(_large_star(edges))))
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
