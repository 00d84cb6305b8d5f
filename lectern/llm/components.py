"""Connected components by label propagation with pointer jumping, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import dropped, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and comp, the smallest node of its component, for every node with a link.

    Each round hands every node the smallest label among its neighbours and then follows labels
    once (pointer jumping), so that rounds grow with the logarithm of a component's diameter for
    the star-like graphs of near copies. Every round is written to the shared folder; only the
    number of changed labels comes to the driver.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = written(one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(edges.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("comp").alias("least"))
        lower = labels.join(near, labels.node == near.u).select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("comp"))
        target = labels.select(F.col("node").alias("to"), F.col("comp").alias("next"))
        jumped = lower.join(target, F.col("comp") == F.col("to"), "left").select("node", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp"))
        after = written(jumped, "labels")
        changed = after.where("old <> comp").limit(1).count()
        dropped(labels)
        labels = after.select("node", "comp")
        labels._lectern_path = after._lectern_path
        if not changed:
            dropped(edges)
            return labels
