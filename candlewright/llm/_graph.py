"""Connected components by repeated minimum and pointer jumping, as tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component: its smallest reachable node) of the nodes that occur in edges (src, dst long).

    Each round takes the least label over neighbours (partial aggregation first, so a node with very many
    neighbours costs one row per task), lets each root adopt what its members found, and jumps pointers twice.
    Rounds grow with the logarithm of the longest chain; a round's labels are written to the shared folder.  Joins are
    sort-merge joins: labels grow with the input, and a compressed file's size would pass for small.
    """
    both = materialise(edges.where("src <> dst").selectExpr("least(src, dst) src", "greatest(src, dst) dst").distinct().selectExpr("inline(array(struct(src, dst), struct(dst as src, src as dst)))"), "edges")
    labels = materialise(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "labels")
    if labels.isEmpty():
        return labels
    while True:
        seen = both.hint("merge").join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("seen"))
        near = labels.hint("merge").join(seen, "node").select("node", "component", F.least("component", "seen").alias("seen"))
        adopted = near.groupBy(F.col("component").alias("node")).agg(F.min("seen").alias("seen"))
        low = near.selectExpr("node", "seen").unionByName(adopted).groupBy("node").agg(F.min("seen").alias("component"))
        low = materialise(low, "labels")
        up = low.selectExpr("node component", "component above")
        jumped = low.hint("merge").join(up, "component").select("node", F.col("above").alias("component"))
        again = materialise(jumped.hint("merge").join(up, "component").select("node", F.col("above").alias("component")), "labels")
        still = again.hint("merge").join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        labels = again
        if still:
            return labels
