"""Connected components of an edge table by alternating stars.

Each round hangs every node's neighbours on their smallest node, first the larger
neighbours (large star), then the smaller ones (small star).  Hubs are never
gathered: a node's minimum is a partial aggregate, and the join that spreads it
can be split by the engine where a hub is hot.  Every round is written to the
shared folder, so no lineage grows and nothing reaches the driver but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import removed, written


def _hung(pairs: DataFrame) -> DataFrame:
    """``pairs (u, v)`` with ``m``, the smallest of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("k"), F.least("u", "w").alias("m"))
    return pairs.join(least, pairs.u == least.k).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (u, v)``; root: the component's smallest node.

    Rows with a null end or two equal ends carry no link and are ignored, repeated
    edges count once, an empty table gives an empty one.
    """
    edges = written(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    digest = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hung(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _hung(large)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        removed(edges)
        edges = after
        if now == digest:
            break
        digest = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
