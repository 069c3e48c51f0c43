"""Connected components of a graph too large for one machine, by joins and groupings alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, written


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, label): for every node of ``edges`` (a, b: of one orderable type) the smallest node it can reach.

    Each round gives a node the least label among its own and its neighbours', then what the node of its label
    has. That node takes the least label that any node of its label sees, so that whole trees of labels meet at once and
    a chain takes rounds in the logarithm of its length, whatever the order of its nodes. Rounds end when no label
    changes; if ``rounds`` do not suffice, an error is raised. They are written to the shared folder, which cuts
    lineage; what a round has replaced is removed.

    Groupings pre-aggregate. The joins, by a node that may be a hub of very many edges and by a label that may be that
    of a giant component, deal each such key over all tasks (``spread_join``).
    """
    both = written(
        edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(),
        "edges",
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        seen = spread_join(both, labels.select(F.col("node").alias("b"), "label"), "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        near = written(labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label")), "near")
        hook = near.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("hook"))
        jump = near.join(hook, "node", "left").select(F.col("node").alias("old"), F.least("label", "hook").alias("far"))
        new = spread_join(near, jump, "old", "node").select("node", "old", F.least("label", "far").alias("label"))
        new = written(new, "labels")
        ended = new.where("label <> old").isEmpty()
        discard(labels, near)
        labels = new
        if ended:
            discard(both)
            return labels.select("node", "label")
        labels = labels.select("node", "label")
    raise RuntimeError(f"labels still change after {rounds} rounds")
