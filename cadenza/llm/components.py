"""Connected components of links between integer nodes, by alternating large-star and small-star steps on DataFrames.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Every step is a grouped minimum, which combines
before the shuffle, and an equi-join on the node, which adaptive execution may split; nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) with a > b; large: neighbours above a node move to its least neighbour, small: those below do."""
    sides = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if large:
        sides = sides.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = sides.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
    moved = sides.join(least, "node")
    if large:
        moved = moved.where("other > node").select(F.col("other").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.where("other <> m").select(F.col("other").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), with the least node of its component; empty for no links.

    Every round is cut from its lineage, and the rounds go on until a whole one changes nothing, which each of them brings nearer.
    """
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark, found = None, _mark(now)
    while found != mark:
        now, mark = cut(_star(_star(now, True), False)), found
        found = _mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
