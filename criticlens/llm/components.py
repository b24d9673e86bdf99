"""Connected components of a link table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from criticlens.session import stage


def _roots(parent: DataFrame) -> DataFrame:
    """(node, root) from (node, root) pointers to smaller nodes, by pointer jumping."""
    while True:
        above = parent.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        jumped = stage(
            parent.join(above, F.col("root") == F.col("_node"), "left").select(
                "node", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")
            )
        )
        parent = jumped.select("node", "root")
        if not jumped.where("moved").take(1):
            return parent


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the (a, b) links; root is the smallest node of its component.

    Each round hooks every node to its smallest smaller neighbour, shortens the pointers, and replaces
    the links by those between different roots. The links at least halve in reach per round; no
    component is ever gathered, and every step is written, so a lost executor costs a re-read.
    """
    edges = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    known = None
    while edges.take(1):
        parent = _roots(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        above = parent.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        top = lambda table, c: table.join(above, F.col(c) == F.col("_node"), "left").withColumn(c, F.coalesce("_root", c)).drop("_node", "_root")
        if known is None:
            known = parent
        else:
            known = stage(top(known, "root").unionByName(parent))
        mapped = top(top(edges, "a"), "b")
        edges = stage(mapped.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    if known is None:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return known.unionByName(known.select(F.col("root").alias("node"), "root").distinct())
