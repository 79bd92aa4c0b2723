"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineforge.session import materialize


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``(id, label)`` for every end of ``edges(a, b)``; the label is the smallest id reachable.

    In each round every vertex takes the smallest label among itself and its neighbours, then the
    label of its label. Edges between vertices of one label are dropped, so a star is done after two
    rounds and a path after a logarithmic number. A hub is one row per neighbour on a shuffled key that
    is combined before the shuffle. Each round is written to the shared folder, which cuts the lineage.
    No edges: no rows. Null ends are ignored. Raises if ``rounds`` don't suffice.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    labels = None
    links = materialize(edges.distinct(), "cc-edges")
    pairs = links
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # smallest neighbour of each current label (or vertex, in the first round)
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        step = low.select(F.col("a").alias("root"), F.least("a", "low").alias("to"))
        step = materialize(step, "cc-step")
        parent = step.alias("s").join(step.alias("t"), F.col("s.to") == F.col("t.root"), "left").select(
            F.col("s.root").alias("root"), F.least("s.to", F.coalesce("t.to", "s.to")).alias("to"))
        parent = materialize(parent, "cc-parent")
        if labels is None:
            labels = parent.select(F.col("root").alias("id"), F.col("to").alias("label"))
        else:
            labels = labels.join(parent, labels.label == parent.root, "left").select(
                "id", F.coalesce("to", "label").alias("label"))
        labels = materialize(labels, "cc-labels")
        # contract: edges between labels
        ends = parent.select(F.col("root"), "to")
        pairs = pairs.join(ends.select(F.col("root").alias("a"), F.col("to").alias("la")), "a").join(
            ends.select(F.col("root").alias("b"), F.col("to").alias("lb")), "b").where("la <> lb").select(
            F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        pairs = materialize(pairs, "cc-edges")
        if pairs.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
