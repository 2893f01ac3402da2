"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of edges (a, b: long); a staged table.

    Each round every node hooks onto its smallest neighbour (or itself), pointers double until all point to the root of
    their tree, and edges are contracted to edges between roots. Edges that lie inside a tree are gone after the round, so
    the first round reads them all and the next ones few; rounds grow with the logarithm of the largest component. All
    tables lie in the shared folder; only whether pointers moved, and edges are left, comes to the driver.
    """
    left = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    labels = None
    while labels is None or not left.isEmpty():
        hooks = _roots(left)
        if labels is None:
            new = hooks
        else:
            new = staged(labels.join(hooks.withColumnsRenamed({"node": "label", "root": "next"}), "label", "left").select("node", F.coalesce("next", "label").alias("label")).withColumnRenamed("label", "root"), "labels")
            discard(labels)
        at_a, at_b = (hooks.withColumnsRenamed({"node": x, "root": f"root_{x}"}) for x in "ab")
        moved = left.join(at_a, "a").join(at_b, "b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
        rest = staged(moved.filter("a < b").distinct(), "edges")
        discard(left)
        if new is not hooks:
            discard(hooks)
        left, labels = rest, new.withColumnRenamed("root", "label")
        labels._staged_at = new._staged_at
    discard(left)
    out = labels.withColumnRenamed("label", "component")
    out._staged_at = labels._staged_at
    return out


def _roots(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges: the end of the path of smallest neighbours; a staged table."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), "hooks")
    while True:
        above = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = staged(hooks.join(above, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "hooks")
        discard(hooks)
        still = new.filter("moved").isEmpty()
        hooks = new.drop("moved")
        hooks._staged_at = new._staged_at
        if still:
            return hooks
