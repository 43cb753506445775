"""Decision trees as arrays: one format for trees grown here and by Spark, vectorised
scoring, and exact Shapley values (I1) by recursion over the paths.

A row goes left where its value is at most the threshold, so NaN goes right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Tree:
    """Node 0 is the root; ``feature`` is -1 at leaves; ``value`` holds one number per output."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return at
            go = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf_of(x)]

    def paths(self) -> Iterator[tuple[int, list[tuple[int, float, bool, float]]]]:
        """(leaf, conditions) with a condition (feature, threshold, goes left, share of the parent's cover)."""
        stack: list[tuple[int, list]] = [(0, [])]
        while stack:
            node, path = stack.pop()
            if self.feature[node] < 0:
                yield node, path
                continue
            for child, goes_left in ((self.left[node], True), (self.right[node], False)):
                share = self.cover[child] / self.cover[node] if self.cover[node] > 0 else 0.5
                stack.append((int(child), [*path, (int(self.feature[node]), float(self.threshold[node]), goes_left, float(share))]))


def spark_tree(model, output) -> Tree:
    """A fitted Spark tree; ``output(node)`` gives the list of its values. Splits on categories are not taken."""
    rows: list[list] = []

    def add(node) -> int:
        i = len(rows)
        rows.append([-1, 0.0, 0, 0, output(node), float(node.impurityStats().count())])
        if node.subtreeDepth() > 0:
            split = node.split()
            if not split.getClass().getSimpleName().startswith("Continuous"):
                raise ValueError("tree Shapley values need continuous splits: one-hot categories first")
            rows[i][0], rows[i][1] = split.featureIndex(), float(split.threshold())
            rows[i][2] = add(node.leftChild())
            rows[i][3] = add(node.rightChild())
        return i

    add(model._call_java("rootNode"))
    f, t, l, r, v, c = zip(*rows, strict=True)
    return Tree(np.array(f), np.array(t), np.array(l), np.array(r), np.array(v, float), np.array(c, float))


def ensemble_of(model) -> tuple[list[Tree], list[float], np.ndarray]:
    """(trees, weights, base) with outputs base + sum of weight x tree value.

    Forests and single trees give class probabilities; boosted ones the margin (per class, if several)."""
    if hasattr(model, "tree_arrays"):
        return model.tree_arrays()
    name = type(model).__name__

    def shares(node):
        stats = node.impurityStats().stats()
        total = sum(stats) or 1.0
        return [s / total for s in stats]

    if name == "DecisionTreeClassificationModel":
        return [spark_tree(model, shares)], [1.0], np.zeros(model.numClasses)
    if name == "RandomForestClassificationModel":
        trees = [spark_tree(t, shares) for t in model.trees]
        return trees, [1.0 / len(trees)] * len(trees), np.zeros(model.numClasses)
    if name in ("GBTClassificationModel", "GBTRegressionModel"):
        trees = [spark_tree(t, lambda n: [n.prediction()]) for t in model.trees]
        return trees, list(model.treeWeights), np.zeros(1)
    if name == "DecisionTreeRegressionModel":
        return [spark_tree(model, lambda n: [n.prediction()])], [1.0], np.zeros(1)
    if name == "RandomForestRegressionModel":
        trees = [spark_tree(t, lambda n: [n.prediction()]) for t in model.trees]
        return trees, [1.0 / len(trees)] * len(trees), np.zeros(1)
    raise TypeError(f"{name} holds no trees")


def expected(tree: Tree) -> np.ndarray:
    """Mean output under the covers: the value of no feature known."""
    out = np.zeros(tree.value.shape[1])
    for leaf, path in tree.paths():
        out += tree.value[leaf] * np.prod([c[3] for c in path])
    return out


def _leaf_shares(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Shapley value of each of d path features in the game that a leaf is: rows x d.

    ``one[:, i]``: the row meets the conditions of feature i (0 or 1); ``zero[i]``: share of the cover that
    passes them without knowing the feature. The polynomial of all others, prod (zero_j + one_j t), is
    extended one feature at a time, and its coefficient s is weighted by s! (d - 1 - s)! / d!."""
    n, d = one.shape
    weight = np.ones(d)
    for s in range(1, d):
        weight[s] = weight[s - 1] * s / (d - s)
    weight /= d
    out = np.empty((n, d))
    # prefix and suffix products, so that every feature is left out once
    before = [np.ones((n, 1))]
    for j in range(d - 1):
        before.append(_times(before[-1], zero[j], one[:, j]))
    after = np.ones((n, 1))
    for i in range(d - 1, -1, -1):
        others = _product(before[i], after)
        out[:, i] = (one[:, i] - zero[i]) * (others @ weight)
        after = _times(after, zero[i], one[:, i])
    return out


def _times(poly: np.ndarray, zero: float, one: np.ndarray) -> np.ndarray:
    out = np.zeros((len(poly), poly.shape[1] + 1))
    out[:, :-1] = poly * zero
    out[:, 1:] += poly * one[:, None]
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), a.shape[1] + b.shape[1] - 1))
    for k in range(b.shape[1]):
        out[:, k:k + a.shape[1]] += a * b[:, k:k + 1]
    return out


def tree_shapley(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Exact Shapley values of the rows of x: rows x features x outputs. They sum to the tree's output less ``expected``."""
    out = np.zeros((len(x), x.shape[1], tree.value.shape[1]))
    for leaf, path in tree.paths():
        features = sorted({c[0] for c in path})
        if not features:
            continue
        one, zero = np.ones((len(x), len(features))), np.ones(len(features))
        for f, threshold, goes_left, share in path:
            i = features.index(f)
            one[:, i] *= (x[:, f] <= threshold) == goes_left
            zero[i] *= share
        own = _leaf_shares(one, zero)
        for i, f in enumerate(features):
            out[:, f, :] += own[:, i:i + 1] * tree.value[leaf]
    return out


def shapley_table(model, df: DataFrame, features: list[str], key: str, features_col: str = "features") -> DataFrame:
    """I1 for tree models: key, output, feature, shap, base and prediction (base + the row's shap values).

    ``output`` numbers the model's outputs (classes of a forest, margins of a boosted model). Each row is
    worked on by itself in Arrow batches, so nothing is shuffled; trees travel with the task."""
    trees, weights, base = ensemble_of(model)
    base = base + sum((w * expected(t) for t, w in zip(trees, weights, strict=True)), np.zeros(len(base)))
    kind = dict(df.dtypes)[key]

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                x = np.array(part.column(1).to_pylist(), float).reshape(part.num_rows, -1)
                shap = sum((w * tree_shapley(t, x) for t, w in zip(trees, weights, strict=True)), np.zeros((len(x), x.shape[1], len(base))))
                n, p, k = shap.shape
                row = np.repeat(np.arange(n), p * k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(k), n * p)), pa.array(features, pa.string()).take(pa.array(np.tile(np.repeat(np.arange(p), k), n))),
                     pa.array(shap.ravel()), pa.array(np.tile(base, n * p)), pa.array((base + shap.sum(axis=1))[row, np.tile(np.arange(k), n * p)])],
                    names=[key, "output", "feature", "shap", "base", "prediction"])

    rows = df.select(F.col(key), vector_to_array(F.col(features_col)).alias("x"))
    return rows.mapInArrow(explain, f"`{key}` {kind}, output long, feature string, shap double, base double, prediction double")
