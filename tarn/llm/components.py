"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node of each component, for every node that has an edge.

    Labels start as the node itself.  Each round takes the least label among a
    node and its neighbours and then follows that label once more, so chains
    shorten as by pointer jumping.  Minima are taken map-side first, so a node
    with very many edges costs no single task more than its share.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = cut(one.union(one.select(F.col("v"), F.col("u"))).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("l")), "v").groupBy(F.col("u").alias("node")).agg(F.min("l").alias("l"))
        low = labels.join(near, "node").select("node", F.least("label", "l").alias("low"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        new = cut(low.join(jump, "low", "left").select("node", F.coalesce("further", "low").alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
