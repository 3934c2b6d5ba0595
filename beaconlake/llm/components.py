"""Connected components of a link table, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconlake.llm.base import materialize


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(
        F.struct(F.col("a").alias("v"), F.col("b").alias("w")),
        F.struct(F.col("b").alias("v"), F.col("a").alias("w")),
    )).alias("e")).select("e.v", "e.w")


def _large_star(links: DataFrame) -> DataFrame:
    """Joins each node's larger neighbours to the smallest node of its neighbourhood."""
    arcs = _both_ways(links)
    least = arcs.groupBy("v").agg(F.min(F.least("v", "w")).alias("m"))
    return (arcs.where("w > v").join(least, "v")
            .select(F.col("m").alias("a"), F.col("w").alias("b")).where("a < b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Joins each node and its smaller neighbours to the smallest of them. Links have a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    joined = links.join(least, "b")
    return (joined.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
            .where("a < b").distinct())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each linked node.

    ``links`` has columns a and b of one ordered type; direction, repeats, self-links and rows with
    a null end do not matter. Returns (node, component) for every node with a link to another.
    Alternates large and small stars until the links are stars: the number of rounds grows with the
    logarithm of the component size, also for chains, and minima are pre-aggregated, so a hub with
    many links does not meet in one task. Each round is written to the shared folder.
    """
    now = materialize(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(
                now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before = mark
        now = materialize(_small_star(_large_star(now)), "stars")
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
