"""Connected components by alternating stars: no component, and no list of links, is ever in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _star(links: DataFrame, larger: bool, total: int) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the smaller ones and itself) to the least around it."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both if larger else both.filter("b < a")
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"), F.count(F.lit(1)).alias("weight"))
    # a star's centre has as many rows as neighbours: they stay spread
    moved = C.join_to(around.filter("b > a") if larger else around, least, "a", 2 * total).select(F.col("b").alias("a"), F.col("root").alias("b"))
    if not larger:
        moved = moved.unionByName(least.select("a", F.col("root").alias("b")))
    return moved.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b): a row (node, root) for each node that has a link; root is the least node it reaches.

    Self-links are ignored; no links give no rows.  Rounds grow with the logarithm of the longest chain.
    """
    spark = links.sparkSession
    sums = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30))).alias("s")]
    path = C.shared_dir(spark, "links")
    now = C.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links", path)
    state, before = tuple(now.agg(*sums).first()), None
    while state != before and state[0]:
        # small stars last: in a fixed point every node is linked to its root and to nothing else
        for larger in (True, False):
            path, last = C.shared_dir(spark, "links"), path
            now = C.written(_star(now, larger, state[0]), "links", path)
            C.remove(spark, last)
        state, before = tuple(now.agg(*sums).first()), state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
