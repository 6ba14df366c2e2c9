"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b) links to a stored (node, label): the smallest node reachable, itself included.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so the rounds grow
    with the logarithm of the longest path. Labels live in scratch tables; only a count reaches the driver. Null nodes
    are dropped; repeated links, loops and an empty table are fine. With ``most`` rounds at most, a label is some smaller
    node that can be reached, and the nodes of a component may have several.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = stored(both.union(both.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    done = 0
    while done or labels.limit(1).count():
        done += 1
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), "label")
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        jumped = stored(low.join(up, "low").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") < F.col("label")).alias("changed")), "labels")
        release(labels)
        labels = jumped
        if done == most or not labels.where("changed").limit(1).count():
            break
    release(both)
    out = labels.select("node", "label")
    out._scratch_path = labels._scratch_path
    return out
