"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasmill.llm.common import stash, unstash


def _star(both: DataFrame) -> DataFrame:
    """(u, v, m) with m the least of u and its neighbours v."""
    least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("m"))
    return both.join(least, both.u == least._u).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str, b: str, label: str = "components") -> DataFrame:
    """(node, root) for every node that an edge touches and that is not itself the least of its component."""
    now = stash(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), label)
    sign = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.max("u")).first()
        if tuple(seen) == sign or seen.n == 0:
            break
        sign = tuple(seen)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        step = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        then = stash(step, label)
        unstash(now)
        now = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
