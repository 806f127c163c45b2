"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import shuffle_if_large, store


def _least_neighbour(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour. ``n`` is the number of ``edges``."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        shuffle_if_large(both, rows=2 * n)
        .join(_least_neighbour(both), "u")
        .filter("v > u")
        .select(F.col("v").alias("u"), F.col("least").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    to_least = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return to_least.union(least.select("u", F.col("least").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """Each node of ``links`` (``u``, ``v``, of one ordered type) with its component.

    Returns ``node`` and ``component``, the least node reachable. Each round is
    two grouped minimums and two joins over links, never over pairs of a
    component; a round's links are written to the shared folder. Rounds grow as
    the logarithm of the longest chain. Links of a node to itself and repeats
    do no harm; an empty table gives an empty table.
    """
    edges = store(links.select("u", "v").filter("u <> v").distinct(), "links")
    before, n = None, edges.count()
    while True:
        edges = _small_star(_large_star(edges, n)).filter("u <> v").distinct()
        edges = store(edges, "links")
        after = edges.agg(
            F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))
        ).first()
        if after == before:
            break
        before, n = after, after[0]
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(centres)
