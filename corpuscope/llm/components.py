"""Connected components of a link table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import materialize

#: Up to so many links (16 bytes each) are contracted as one partition, which saves the shuffles of every round.
ONE_PARTITION_LINKS = 50_000


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node of ``links(a, b)``.

    Alternating star contraction: each round hangs the larger neighbours of a
    node on its smallest neighbour (large star), then all smaller ones (small
    star).  The links become stars around the smallest nodes in logarithmically
    many rounds.  Every round is written below the shared folder, so lineage
    stays short; only two numbers (row count and a checksum) reach the driver.
    The same expressions run on one partition while the counted links are few.
    """
    state, seen = materialize(_down(links.select("a", "b")), "links"), None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
        if now[0] <= ONE_PARTITION_LINKS:
            state = state.coalesce(1)
        state = materialize(_small_star(_large_star(state)), "links")
    roots = state.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return roots.unionByName(state.select(F.col("a").alias("node"), F.col("b").alias("component")))


def _down(links: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller node."""
    return (links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` point from larger to smaller nodes."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    hung = links.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
