"""Connected components of an edge table, by alternating large and small stars.

Every round moves each neighbour of a node to the node's smallest neighbour; the number of edges never grows and
the rounds grow with the logarithm of the longest path.  Minima are pre-aggregated and no neighbourhood is collected,
so a node with very many neighbours is one row of an aggregate and a skewed join that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import remove, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of any comparable type to (node, component), component being the smallest node; nodes without an
    edge to another node do not appear.  Nulls and loops are ignored, repeated edges are allowed."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.col("a").alias("__a"), F.col("b").alias("__b"))
    now = stored(now.where("__a is not null and __b is not null and u <> v").select("u", "v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.join(least, both["u"] == least["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        moved = large.join(low, large["u"] == low["k"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        last, now = now, stored(small, "edges")
        remove(last)
