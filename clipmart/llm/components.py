"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmart.llm.common import kept


#: Edges for one task; fewer edges are read by fewer tasks.
EDGES_PER_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of *edges* (``a``, ``b``).

    Alternating star contraction: neighbours are hung on the smallest of them until nothing moves,
    which takes about log n rounds. Each round is written out; a hub with very many
    neighbours meets only aggregates that combine map-side and joins that adaptive execution splits.
    """
    both = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    stars = kept(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(stars)
    while mark[0]:
        stars = stars.coalesce(1 + mark[0] // EDGES_PER_TASK)
        stars = kept(_small_star(_large_star(stars)).distinct())
        last, mark = mark, _mark(stars)
        if mark == last:
            break
    # Every node now hangs on its component's smallest node.
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())


def _mark(stars: DataFrame) -> tuple:
    """Number and digest of the edges: equal when a round has moved nothing."""
    return tuple(stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def _large_star(stars: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node and its neighbours."""
    around = stars.union(stars.select("b", "a")).toDF("u", "v")
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return around.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(stars: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = stars.groupBy("a").agg(F.min("b").alias("m"))
    hung = stars.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b")))
