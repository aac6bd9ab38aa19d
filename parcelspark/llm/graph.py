"""Connected components of an edge table, by rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b), comp being its component's smallest node.

    Each round points every node at its smallest neighbour, follows pointers once more, and contracts the edges to
    what they point at. Nodes left over at least halve, so rounds grow with the logarithm of the largest component.
    Self-edges and repeated edges are allowed; null ends are dropped. All steps are keyed joins and partial
    aggregates, and each round is written to the shared folder.
    """
    left = edges.where("a is not null and b is not null").select("a", "b")
    label: DataFrame | None = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")))
        via = point.select(F.col("node").alias("to"), F.col("to").alias("far"))
        point = cut(point.join(via, "to").select("node", F.col("far").alias("to")))
        if label is None:
            label = point.select("node", F.col("to").alias("comp"))
        else:
            step = point.select(F.col("node").alias("comp"), F.col("to").alias("next"))
            label = label.join(step, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))
        label = cut(label)
        ends = left.where("a <> b").join(point.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(point.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        left = cut(ends.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        if left.isEmpty():
            return label
