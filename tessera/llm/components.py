"""Connected components of an edge table by alternating star contractions.

A large step links every larger neighbour of a node to the least node of its
neighbourhood, a small step does so for the smaller ones; both keep connectivity,
and a few rounds leave one star per component around its least node.  Every round
is written to the shared folder.  Minima are pre-aggregated and written before they
are joined, so the rows of a hub can be split over tasks (adaptive skew join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import Workspace, rows_of


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, work: Workspace, max_rounds: int = 60, within: int | None = None) -> DataFrame:
    """(node, component) of every node but the least of its component.

    ``edges`` has two columns of one orderable type, and at most ``within`` rows if that
    is given; loops and nulls are ignored.
    A node that is missing from the result is the least of its component.
    """
    a, b = edges.columns
    plain = edges.filter(F.col(a) != F.col(b))
    stars = work.keep(plain.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges", within)
    if not rows_of(stars):
        return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = _signature(stars)
    for _ in range(max_rounds):
        most = 2 * rows_of(stars)
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-least", most)
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = work.keep(large, "large", most)
        least2 = work.keep(large.groupBy("u").agg(F.min("v").alias("m")), "small-least", rows_of(large))
        small = large.join(least2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = work.keep(small.unionByName(least2.select("u", F.col("m").alias("v"))).distinct(), "stars", rows_of(large, least2))
        after = _signature(following)
        work.drop(stars, least, large, least2)
        stars = following
        if after == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
