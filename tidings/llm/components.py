"""Connected components of a distributed graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.session import staged


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node reachable) for every node of an edge.

    ``edges`` has the long columns a and b, in any order, repeated or not; loops are ignored. Each
    round writes its edges as a table: the lineage stays short and a lost executor costs a round at
    most. Work goes by aggregates that combine before the shuffle and joins whose one side has a
    row per node, so a node with very many edges can be split. Rounds grow with the logarithm of a
    component's diameter.
    """
    current = staged(_down(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    mark = _mark(current)
    while True:
        following = staged(_small_star(_large_star(current)))
        new_mark = _mark(following)
        if new_mark == mark:
            break
        current, mark = following, new_mark
    return current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from its greater node u to its lesser node v."""
    return (
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node goes to the least of its neighbourhood."""
    both = edges.select(
        F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
    ).select(F.col("e.u").alias("x"), F.col("e.v").alias("y"))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    moved = both.join(least, "x").filter("y > x")
    return _down(moved.select(F.col("y").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every lesser neighbour of a node, and the node, go to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    pairs = moved.select(
        F.explode(
            F.array(
                F.struct(F.col("u"), F.col("m").alias("v")),
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            )
        ).alias("e")
    )
    return _down(pairs.select("e.u", "e.v"))
