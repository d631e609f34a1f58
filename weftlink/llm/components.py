"""Connected components by alternating star contraction.

Each round replaces the edges of a node by edges to its smallest neighbour: first those
to larger neighbours, then those to smaller ones. A logarithmic number of rounds leaves
one star per component, also for long chains. Edges live in the shared checkpoint
folder between rounds; only two sums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlink.llm.common import cut, join_hot


#: Edges to a partition between rounds; small graphs so keep few files.
EDGES = 200_000


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b) but the smallest of each component, which is the component's name.

    Nodes of very many edges are joined by a broadcast of at most ``HOT_KEYS`` rows. Raises if ``most_rounds`` are not enough.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    size = now.count()
    parts = max(1, -(-size // EDGES))
    for _ in range(most_rounds):
        now = now.coalesce(parts)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).withColumn("m", F.least("m", "u"))
        large = join_hot(both, least, "u", "k", 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts)
        least = _least(large)
        small = join_hot(large, least, "u", "k", size).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct().coalesce(parts))
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == before:
            return cut(_least(now).select(F.col("u").alias("node"), F.col("m").alias("component")).coalesce(parts))
        before, size = sums, sums[0]
    raise RuntimeError(f"components are not complete after {most_rounds} rounds")
