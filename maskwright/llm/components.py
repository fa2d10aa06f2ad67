"""Connected components of an edge table by repeated contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.support import materialize


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``; the label is one node of the component, the same for all its nodes.

    Each round gives every node the first of itself and its neighbours in an order, and contracts the edges to those
    labels. The first round's order is that of the ids, as stars around their least node then vanish at once; later
    orders are hashes of the id and the round, so that no numbering is bad: of a path about half of the nodes
    vanish in a round, and rounds grow with the logarithm of the number of nodes. Hubs are safe: the first neighbour is
    a partial aggregate. An edge (x, x) counts for nothing.
    """
    pending = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-edges")
    labels: DataFrame | None = None
    step = 0
    while not pending.isEmpty():
        order = (lambda c: F.col(c)) if not step else (lambda c, step=step: F.xxhash64(F.col(c), F.lit(step)))
        both = pending.unionByName(pending.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.least(F.struct(order("a").alias("o"), F.col("a").alias("n")), F.min(F.struct(order("b").alias("o"), F.col("b").alias("n"))))
        hop = materialize(both.groupBy("a").agg(first.alias("f")).select(F.col("a").alias("node"), F.col("f.n").alias("label")), f"{name}-hop{step}")
        if labels is None:
            labels = hop
        else:
            next_hop = hop.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = materialize(labels.join(next_hop, "label", "left").select("node", F.coalesce("next", "label").alias("label")), f"{name}-labels{step}")
        left = hop.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = hop.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        moved = pending.join(left, "a").join(right, "b").filter("la <> lb")
        pending = materialize(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), f"{name}-edges{step}")
        step += 1
    return pending.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels
