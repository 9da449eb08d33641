"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _signature(edges: DataFrame):
    """Changes whenever the set of links does."""
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every node that has a link; the root is the least node of the component.

    ``links`` has two columns of one orderable type; repeated links, links both ways and
    links to itself do no harm, null ends are no links.  Each round points every node at
    the least neighbour it knows; the number of rounds grows with the logarithm of the
    longest chain.  Each round is a table in the shared folder, so lost executors cost no
    more than a round.  Neighbourhoods are only aggregated, never gathered in one row.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns)
    edges = materialize(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        # Large star: the greater neighbours of a node, to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the lesser neighbours of a node and itself, to the least of them.
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = _signature(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components were not found within {most_rounds} rounds")
    rooted = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())
