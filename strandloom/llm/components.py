"""Connected components of a link table by alternating large-star and small-star steps.

Links stay a distributed table throughout; each round is two joins on a node and is cut by a checkpoint.
A hub with very many links is an ordinary skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _rewire(links: DataFrame, larger_only: bool) -> DataFrame:
    """Every node u tells its neighbours v the smallest node that it knows of."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    if larger_only:
        least = least.withColumn("m", F.least("u", "m"))
    met = links.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
    told = met.where(F.col("v") > F.col("u")) if larger_only else met.where(F.col("v") > F.col("m"))
    out = told.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out if larger_only else out.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links(u, v) but the roots; root is the smallest node that u reaches.

    Nodes are longs. Loops and repeated links do no harm; an empty table gives none.
    """
    now = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1000000007).alias("s")
    before = now.agg(*mark).first()
    while before.n:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _rewire(both, larger_only=True).where("u <> v").distinct()
        now = cut(_rewire(large, larger_only=False).where("u <> v").distinct())
        after = now.agg(*mark).first()
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
