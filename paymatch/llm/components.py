"""Connected components by label hooking and pointer jumping.

Each round takes two joins over narrow (node, label) rows read from written
tables, so a node with very many links is an ordinary skewed shuffle join.
Nothing is gathered on the driver but the count of changed labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paymatch.llm.store import drop, save


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): long node ids. Returns (node, label): the smallest node
    id that can be reached, for every node that has an edge. Null ends and
    loops are ignored; repeated edges change nothing; no edges, no rows."""
    edges = edges.where(F.col("a") != F.col("b"))
    pairs = save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = save(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                 .select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = (pairs.join(label, pairs.b == label.node)
                .groupBy(F.col("a").alias("at")).agg(F.min("label").alias("near")))
        hooked = save(label.join(near, label.node == near.at)
                      .select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "hooked")
        top = hooked.select(F.col("node").alias("up"), F.col("label").alias("top"))
        jumped = save(hooked.join(top, hooked.label == top.up, "left")
                      .select("node", "was", F.least("label", "top").alias("label")), "labels")
        changed = jumped.where("label != was").limit(1).count()
        drop(hooked)
        drop(label)
        label = jumped.select("node", "label")
        if not changed:
            drop(pairs)
            return label
