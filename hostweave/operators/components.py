"""Connected components by contraction: the edge table shrinks every round."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostweave.session import cut


def component_labels(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v); the label is one node of its component.

    Each round points every node at the neighbour that comes first in an order drawn by a hash (or at itself), and on to where that one
    points, rewrites the edges to those and drops loops and repeats. In a drawn order a share of the nodes goes every round, chains in the order of
    their names included, so the number of rounds grows with the logarithm of a component's size; stars take two.
    """
    by = list(by)
    live = edges.select(*by, "u", "v")
    steps = []
    while True:
        sym = live.union(live.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        near = sym.groupBy(*by, "u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("near"))
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v"))
        step = near.select(*by, F.col("u").alias("node"), F.least("near", own)["v"].alias("over"))
        # two hops at a time: every node pointed at points on
        onward = step.select(*by, F.col("node").alias("over"), F.col("over").alias("to"))
        steps.append(cut(step.join(onward, [*by, "over"]).select(*by, "node", "to")))
        left = steps[-1].select(*by, F.col("node").alias("u"), F.col("to").alias("nu"))
        right = steps[-1].select(*by, F.col("node").alias("v"), F.col("to").alias("nv"))
        live = cut(
            live.join(left, [*by, "u"])
            .join(right, [*by, "v"])
            .filter("nu != nv")
            .select(*by, F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"))
            .distinct()
        )
        if live.isEmpty():
            break
    mapping = steps[0].withColumnRenamed("to", "label")
    for step in steps[1:]:
        hop = step.select(*by, F.col("node").alias("label"), "to")
        mapping = mapping.join(hop, [*by, "label"], "left").select(*by, "node", F.coalesce("to", "label").alias("label"))
    return cut(mapping)
