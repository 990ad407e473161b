"""Connected components of a graph of links, by alternating large and small stars.

Each round hangs every node's larger neighbours onto its smallest one (large star), then every node and its smaller
neighbours onto the smallest of them (small star), until the links are stars around each component's smallest node.
Minima are pre-aggregated and joined back, so a node with very many links is never gathered in one task, and each round is
written to the shared folder, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import drop_scratch, saved, scratch_path

ROUNDS = 60


def _large(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    # links go from the larger node to the smaller one
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    met = links.join(low, "a")
    return met.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """links: a, b, of one type. Returns (node, root) for every node that has a link to another; root is the smallest reachable."""
    spark = links.sparkSession
    now = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = scratch_path(spark, "links")
    now = saved(now, "links", path)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    old = mark(now)
    for _ in range(ROUNDS):
        if not old[0]:
            break
        then = scratch_path(spark, "links")
        now = saved(_small(_large(now)).where(F.col("a") != F.col("b")).distinct(), "links", then)
        drop_scratch(spark, path)
        path, new = then, mark(now)
        if new == old:
            break
        old = new
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
