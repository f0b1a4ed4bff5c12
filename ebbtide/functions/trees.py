"""Exact additive contributions of boosted trees (path-dependent tree Shapley values), for Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.session import shared_folder


def tree_nodes(model: GBTClassificationModel, spark) -> DataFrame:
    """The nodes of a fitted ensemble as rows: tree, node, value (times the tree's weight), cover, left, right, feature, threshold.

    They are read from the model as it stores itself in the shared folder; cover is the weight of the training rows that
    reached a node.
    """
    path = shared_folder(spark, "trees")
    model.write().save(path)
    weights = F.lit([float(w) for w in model.treeWeights])
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), (n["prediction"] * F.element_at(weights, F.col("treeID") + 1)).alias("value"), n["impurityStats"][0].alias("cover"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"), F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
        n["split"]["numCategories"].alias("categories"),
    )


@dataclass(frozen=True)
class Leaf:
    """A leaf: its value, the features on its path, the share of cover that follows the path for each, and the splits to pass."""

    value: float
    features: tuple[int, ...]
    shares: np.ndarray
    splits: tuple[tuple[tuple[int, bool], ...], ...]  # per feature: (split, taken to the left)


@dataclass(frozen=True)
class Ensemble:
    """Splits of all trees as arrays, and the leaves; a few thousand numbers whatever the data."""

    feature: np.ndarray
    threshold: np.ndarray
    leaves: tuple[Leaf, ...]

    @property
    def base(self) -> float:
        """The value expected without any feature: leaves by the share of cover that reaches them."""
        return math.fsum(leaf.value * float(np.prod(leaf.shares)) for leaf in self.leaves)

    def _passed(self, x: np.ndarray) -> np.ndarray:
        # a missing value fails the comparison and goes to the right, as in scoring
        return x[:, self.feature] <= self.threshold if len(self.feature) else np.zeros((len(x), 0), bool)

    def values(self, x: np.ndarray) -> np.ndarray:
        """The value of every row, by its leaves."""
        went, out = self._passed(x), np.zeros(len(x))
        for leaf in self.leaves:
            inside = np.ones(len(x), bool)
            for steps in leaf.splits:
                for k, left in steps:
                    inside &= went[:, k] == left
            out += leaf.value * inside
        return out

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Rows x features: what each feature adds to :attr:`base`; the sum is :meth:`values` less the base."""
        went, out = self._passed(x), np.zeros(x.shape)
        for leaf in self.leaves:
            m = len(leaf.features)
            code = np.zeros(len(x), np.int64)
            for i, steps in enumerate(leaf.splits):
                inside = np.ones(len(x), bool)
                for k, left in steps:
                    inside &= went[:, k] == left
                code |= inside.astype(np.int64) << i
            met, place = np.unique(code, return_inverse=True)  # a row matters only by which features follow the path
            gains = _gains(leaf, (met[:, None] >> np.arange(m)) & 1)
            out[:, list(leaf.features)] += gains[place]
        return out


def _gains(leaf: Leaf, follows: np.ndarray) -> np.ndarray:
    """Shapley values of the features of a leaf for patterns of features that follow its path.

    With the set S of known features a leaf counts with the product of ``follows`` inside S and of ``shares`` outside. The sum over
    all S of one size is a coefficient of the product of (share + follows * t) over the other features.
    """
    m = len(leaf.features)
    out = np.zeros(follows.shape)
    weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
    for i in range(m):
        sizes = np.zeros((len(follows), m))
        sizes[:, 0] = 1.0
        for j in range(m):
            if j != i:
                sizes[:, 1:] = sizes[:, 1:] * leaf.shares[j] + sizes[:, :-1] * follows[:, [j]]
                sizes[:, 0] *= leaf.shares[j]
        out[:, i] = leaf.value * (follows[:, i] - leaf.shares[i]) * (sizes @ weight)
    return out


def ensemble(nodes: DataFrame) -> Ensemble:
    """Collect the nodes of a model (some thousand rows, set by the number and depth of its trees) and list its leaves."""
    rows = {(r["tree"], r["node"]): r for r in nodes.collect()}
    if any(r["categories"] >= 0 for r in rows.values()):
        raise ValueError("contributions are defined for splits at thresholds only")
    splits = sorted(k for k, r in rows.items() if r["left"] >= 0)
    number = {k: i for i, k in enumerate(splits)}
    leaves = []
    stack = [(k, ()) for k in rows if k[1] == 0]
    while stack:
        at, path = stack.pop()
        r = rows[at]
        if r["left"] < 0:
            by_feature: dict[int, list] = {}
            for split, left, share in path:
                by_feature.setdefault(rows[splits[split]]["feature"], []).append((split, left, share))
            shares = np.array([math.prod(s for _, _, s in steps) for steps in by_feature.values()])
            leaves.append(Leaf(r["value"], tuple(by_feature), shares, tuple(tuple((k, left) for k, left, _ in steps) for steps in by_feature.values())))
            continue
        for child, left in ((r["left"], True), (r["right"], False)):
            share = rows[at[0], child]["cover"] / r["cover"] if r["cover"] else 0.5
            stack.append(((at[0], child), (*path, (number[at], left, share))))
    return Ensemble(np.array([rows[k]["feature"] for k in splits], np.int64), np.array([rows[k]["threshold"] for k in splits]), tuple(leaves))
