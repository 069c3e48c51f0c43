"""Gradient-boosted trees as column expressions.

Trees are fitted by ``pyspark.ml`` on a bounded, labelled DataFrame and become nested CASE expressions, so that
scoring is an ordinary projection, also inside a higher-order function over an array of candidates.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A leaf is its value; a node has a feature's number, a threshold, and what holds up to it and beyond.
Tree = float | tuple[int, float, "Tree", "Tree"]


def fit_trees(rows: DataFrame, names: list[str], label: str = "label", rounds: int = 20, depth: int = 3, seed: int = 7) -> list[tuple[float, Tree]]:
    """Weighted trees that part label 1 from 0. ``rows`` is written once to the shared folder and read from there.

    Without rows of both labels there is nothing to learn: one leaf of 0 comes back, a probability of one half.
    """
    table = written(rows.select(*[F.col(n).cast("double") for n in names], F.col(label).cast("double").alias("label")).coalesce(4), "trees")
    if table.select("label").distinct().count() < 2:
        return [(1.0, 0.0)]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(table).select("features", "label")
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=64, minInstancesPerNode=5).fit(data)
    return [(w, parse(t.toDebugString)) for w, t in zip(model.treeWeights, model.trees, strict=True)]


def parse(text: str) -> Tree:
    """A tree from its printed form: If, what follows, Else, what follows, or Predict."""
    lines = iter(re.findall(r"If \(feature (\d+) <= ([^)]+)\)|Else \(|Predict: (\S+)", text))

    def node() -> Tree:
        feature, threshold, value = next(lines)
        if value:
            return float(value)
        low = node()
        next(lines)  # Else
        return int(feature), float(threshold), low, node()

    return node()


def probability(trees: list[tuple[float, Tree]], features: list[Column]) -> Column:
    """The probability of label 1."""

    def value(tree: Tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        feature, threshold, low, high = tree
        return F.when(features[feature] <= threshold, value(low)).otherwise(value(high))

    margin = sum((value(tree) * weight for weight, tree in trees), F.lit(0.0))
    return 1 / (1 + F.exp(-2 * margin))
