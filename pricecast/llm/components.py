"""Connected components of an edge table by alternating star contraction.

Each round hangs the neighbours of every vertex on their smallest one, first the larger neighbours, then the
smaller. Minima are combined on the map side, a vertex with very many edges is split by adaptive execution, and the
edge table goes to the shared folder after each round. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricecast.sources.scratch import settle


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id reachable, for each id on an edge of ``a``, ``b`` (long)."""
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # Stars are left if who has several neighbours is smaller than all of them.
        if not near.where("n > 1 AND m < u").agg(F.count("*")).first()[0]:
            roots = now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)
        least = near.select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Every edge of ``large`` points from a vertex to a smaller one.
        large = settle(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
