"""Connected components of a link table, by stars, without collecting a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareflow.llm.store import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.select("a", "b").union(turned)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbourhood."""
    near = _both_ways(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a > b").union(least.select("a", F.col("m").alias("b")))


def _settled(links: DataFrame) -> bool:
    """Every node has one link, and none to a node that has a link itself."""
    again = links.select(F.col("a").alias("b")).distinct()
    # Distinct before the join: the centre of a large component would bring all its links to one task.
    if links.select("b").distinct().join(again, "b", "left_semi").limit(1).count():
        return False
    return not links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(a, b): each node that is not the least of its component, with that least node.

    edges: columns a and b of one ordered type, in any order, with repeats, loops allowed and
    ignored, rows with a null ignored. Nodes without a link do not appear. Each round is written
    to the shared folder; the rounds end when only stars are left.
    """
    links = edges.select("a", "b").where("a <> b")
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = scratch.keep(links, "links")
    for _ in range(rounds):
        if _settled(links):
            return links
        stars = scratch.keep(_small_star(_large_star(links).distinct()).distinct(), "stars")
        scratch.drop(links)
        links = stars
    raise RuntimeError(f"links did not settle in {rounds} rounds")
