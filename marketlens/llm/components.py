"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialise


def _roots(edges: DataFrame) -> DataFrame:
    """(node, root): every node follows the least neighbours, its own first, to the end.

    Following least neighbours can only ring between two nodes that name each other; the smaller of
    them is a root. So every tree has two nodes or more. Every step doubles the way gone.
    """
    least = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), "component-least")
    back = least.select(F.col("node").alias("up"), F.col("up").alias("again"))
    root_here = (F.col("again") == F.col("node")) & (F.col("node") < F.col("up"))
    ups = materialise(least.join(back, "up").select("node", F.when(root_here, F.col("node")).otherwise(F.col("up")).alias("root")), "component-roots")
    discard(least)
    while True:
        further = ups.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = materialise(ups.join(further, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "component-roots")
        discard(ups)
        ups = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return ups


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``; label is one node of its component, the same for all.

    Each round joins every node to its root and keeps the links between roots. A root stands for two
    nodes or more, so the nodes at least halve and rounds are at most the logarithm of their number,
    whatever the shape. Minima and repeated links are combined before the exchange. A node linked to
    itself only is not listed; no links give no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(both.where("a <> b").distinct(), "component-edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        roots = _roots(edges)
        rounds.append(roots)
        one, two = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
        renamed = edges.join(one, "a").where("root_a <> b").join(two, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        left = materialise(renamed.where("a <> b").distinct(), "component-edges")
        discard(edges)
        edges = left
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds[-1].withColumnRenamed("root", "label")
    for roots in reversed(rounds[:-1]):
        labels = roots.join(labels.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("label", "root").alias("label"))
    return materialise(labels, "component-labels")
