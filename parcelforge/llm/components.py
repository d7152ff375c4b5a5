"""Connected components of an edge table, on the executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.common import discard, materialize


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge; root: the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label's own label (pointer jumping), so
    that even a chain ends after about log2 of its length rounds.  Labels are tables in the shared folder: no round
    depends on a lost executor, and none is held by the driver.  Every join is between two stored tables, so that
    Spark can split a hot node, and sorted at every size: labels look small by their files and grow with the graph,
    and what is broadcast is held by the driver.  An empty edge table gives an empty result.
    """
    # Both ways from one reading: links of a group may start from another member when they are made again.
    ways = F.array(F.struct(F.col(u).alias("u"), F.col(v).alias("v")), F.struct(F.col(v).alias("u"), F.col(u).alias("v")))
    both = materialize(edges.where(F.col(u) != F.col(v)).select(F.inline(ways)).distinct(), "cc-edges", True)
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")), "cc-labels", True)
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("root").alias("near")).hint("merge"), "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        hooked = materialize(labels.join(near.hint("merge"), "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old")), "cc-hooked", True)
        done = hooked.where("root <> old").isEmpty()
        discard(labels)
        if done:
            discard(both)
            return hooked.select("node", "root")
        of = hooked.select(F.col("node").alias("root"), F.col("root").alias("far"))
        labels = materialize(hooked.select("node", "root").join(of.hint("merge"), "root").select("node", F.least("root", "far").alias("root")), "cc-labels", True)
        discard(hooked)
