"""Connected components of a graph given as edges.

An edge (u, v) with u > v says that v is a parent of u.  A round makes the least
parent of each node the parent of its other parents too (which joins them), and
then points every edge to its parent's parent.  The graph is flat when no
node has two parents and no parent is a child; a round counts what is not flat as
it writes, so there is no job that only looks.

A node has few parents (one per task that found it), so they meet in a window;
a root may have any number of children, which only meet it in a join that Spark
can split.  Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common


def _round(e: DataFrame, seen: Observation) -> DataFrame:
    parents = W.partitionBy("u").orderBy("v")
    ranked = e.select("u", "v", F.first("v").over(parents).alias("least"), F.lag("v").over(parents).alias("before"))
    first, new = F.col("before").isNull(), F.col("v") != F.col("before")
    joined = ranked.where(first | new).select(
        F.when(first, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v"), (~first).alias("several"))
    above = joined.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("up"))
    return (
        joined.join(above, "v", "left")
        .observe(seen, F.count_if(F.col("several") | F.col("up").isNotNull()).alias("open"))
        .select("u", F.coalesce("up", "v").alias("v"))
    )


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, root for every node of ``edges`` (two long columns, a stored table,
    either order, repeats allowed); root is the smallest node of its component."""
    a, b = (F.col(c) for c in edges.columns)
    e = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    while True:
        seen = Observation()
        e = common.stored(_round(e, seen), label)
        if not seen.get["open"]:
            break
    flat = e.distinct()
    return flat.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
