"""Connected components by alternating large-star and small-star steps, every step a Spark job over links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored_at


def _large_star(links: DataFrame) -> DataFrame:
    """Hands every larger neighbour of a node to the node's smallest neighbour (itself included)."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hands the smaller neighbours of a node, and the node, to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node with a link, from long columns (u, v); label is the smallest node of the component.

    A node's neighbours are never collected: each step is an aggregation and a join that run-time planning can split
    when a node is linked to a large share of all others. Steps are written to the shared folder; the step before
    is deleted. Self links and repeated links are ignored; no links give no rows."""
    spark = links.sparkSession
    u, v = F.greatest("u", "v"), F.least("u", "v")
    now, path = stored_at(links.where("u <> v").select(u.alias("u"), v.alias("v")).distinct(), "links")
    state = None
    while True:
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if found == state or not found[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        state = found
        now, after = stored_at(_small_star(_large_star(now)), "links")
        forget(spark, path)
        path = after
