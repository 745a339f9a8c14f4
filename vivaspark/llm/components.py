"""Connected components of a distributed edge list, by alternating star steps.

Large star: every node hands its larger neighbours to the smallest node it
knows. Small star: every node hands its smaller neighbours, and itself, to the
smallest of them. Both keep connectivity; together they end in stars around
each component's smallest node after a logarithmic number of rounds. Each round
is one pre-aggregated shuffle of the edges; no node's neighbours are gathered,
and nodes with a thousandth of all edges or more are joined by broadcast. Edges
are held EDGES a partition or more: a round has a dozen shuffles, and each task of
each leaves files, so few edges in many partitions would fill disks with blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vivaspark.llm.common import cut, join_by_key

#: Edges a partition, at least, while there is more than one.
EDGES = 1 << 14


def _dealt(edges: DataFrame, n: int) -> DataFrame:
    """edges in no more partitions than n edges need."""
    return edges.coalesce(n // EDGES + 1)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return join_by_key(both.filter("b > a"), least, ["a"], "n", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_by_key(down, least, ["a"], "n", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (a, b) with b the smallest node of a's component, for every a but those smallest."""
    edges = cut(edges.select("a", "b").filter("a <> b").distinct())
    before, n = None, edges.count()
    edges = _dealt(edges, n)
    for _ in range(most_rounds):
        for star in (_large_star, _small_star):
            # Before and after the shuffle: either side has a task a partition.
            edges = cut(_dealt(_dealt(star(edges, n), n).distinct(), n))
            n = edges.count()
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
