"""Connected components of links by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.common import Scratch, with_small_side


def _with_least(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) with `least`, the least of a and all its neighbours b.

    The least ones are written first, so that the join of a hub's links with them is one
    that Spark deals out anew when a key is hot; small ones are broadcast.
    """
    least = scratch.store(links.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("low", "a").alias("least")), "least")
    return links.join(with_small_side(least, least.count(), 24), "a").select("a", "b", "least")


def _large_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of the node and all its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, scratch).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    starred = _with_least(links.where("a > b"), scratch)
    moved = starred.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return moved.where("a != b")


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most and no node has both smaller and larger ones."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    by_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by_node.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def connected_components(links: DataFrame, scratch: Scratch | None = None, most_rounds: int = 60) -> DataFrame:
    """node and component (least node reachable) for each node of links (columns a and b).

    Links may come in any direction and repeat; those of a node with itself and null
    ones are left out. Nodes are 64-bit integers. No links give no rows.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    links = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = scratch.store(links, "star-links")
    for _ in range(most_rounds):
        if _are_stars(links):
            break
        large = scratch.store(_large_star(links, scratch).distinct(), "large-star")
        scratch.drop("least", "star-links")
        links = scratch.store(_small_star(large, scratch).distinct(), "star-links")
        scratch.drop("least", "large-star")
    else:
        raise RuntimeError("components did not settle")
    # in a star every node hangs on its least one
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component")))).alias("s"))
    out = scratch.store(both.select("s.*").distinct(), "components")
    scratch.drop("star-links")
    return out
