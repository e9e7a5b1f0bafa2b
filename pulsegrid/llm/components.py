"""Connected components of a link table, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from every id that occurs in a link.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each points every node
    at the smallest node of its neighbourhood, and the rounds grow with the logarithm of the
    longest chain. Every round is written to the shared folder. A node with many links meets them in
    an aggregate that map tasks combine first, and in a join of two plain shuffles, which adaptive
    execution splits. A round replaces the table of the round before. Only a count and a hash of the links of a round reach the driver. Self links and repeats are harmless.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    edges = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialize(edges, "cc-links")

    def lowest(e: DataFrame) -> DataFrame:
        # grouped by -u, so that the join's two sides are shuffles of their own and a hub's links can be split
        return e.groupBy((-F.col("u")).alias("minus")).agg(F.min("v").alias("low")).select((-F.col("minus")).alias("u"), "low")

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:  # larger neighbours go to the smallest of the whole neighbourhood
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            out = both.where("v > u").join(lowest(both), "u").select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        else:  # smaller neighbours, and the node, go to the smallest
            low = lowest(e)
            met = e.join(low, "u")
            out = met.where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
        return out.distinct()

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = digest(edges)
    for _ in range(max_rounds):
        last, edges = edges, materialize(star(star(edges, True), False), "cc-round")
        discard(last)
        before, seen = seen, digest(edges)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
    out._folder = edges._folder  # for discard()
    return out
