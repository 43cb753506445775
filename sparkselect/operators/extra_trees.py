"""extremely randomised trees (Geurts et al. 2006), all trees grown level by level in the same passes.

A level takes two aggregations over the rows: the range of every feature in every open node, from which
each node draws its candidate features and one uniform cut for each, and the class weights to the left of
these cuts. Draws are hashes of (seed, tree, node, feature), so a fit repeats and SQL can follow it.
The driver holds node statistics only; trees are grown in groups that bound them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkselect.operators.boosting import _matrix
from sparkselect.operators.estimators import CustomEstimator, CustomModel, label_classes, with_scores
from sparkselect.operators.persist import CompositePersistence
from sparkselect.operators.trees import Tree
from sparkselect.session import stored_split

#: (node, feature) pairs of a level that the driver holds at most, about.
LEVEL_ROWS = 2_000_000
#: Cells (row x feature) up to which the rows are one partition.
PARTITION_CELLS = 300_000


def draw(seed: int, tree: int, node: int, feature: int) -> tuple[float, str]:
    """Uniform place of the cut in [0, 1), and the sort key by which a node picks its candidate features."""
    digest = hashlib.md5(f"{seed}:{tree}:{node}:{feature}".encode()).hexdigest()
    return int(digest[:8], 16) / 2.0 ** 32, digest[8:16]


class _Tree:
    """A growing tree; ``heap`` numbers the children of i 2i + 1 and 2i + 2."""

    def __init__(self, totals: np.ndarray):
        self.feature, self.threshold, self.left, self.right, self.gain = [-1], [0.0], [0], [0], [0.0]
        self.totals, self.heap, self.depth = [totals], [0], [0]

    def split(self, node: int, feature: int, threshold: float, gain: float, left: np.ndarray) -> None:
        self.feature[node], self.threshold[node], self.gain[node] = feature, threshold, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for side, totals in ((1, left), (2, self.totals[node] - left)):
            for column, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.gain, 0.0), (self.totals, totals),
                              (self.heap, 2 * self.heap[node] + side), (self.depth, self.depth[node] + 1)):
                column.append(v)

    def router(self) -> Tree:
        k = len(self.feature)
        return Tree(np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.right), np.zeros((k, 1)), np.zeros(k))


def _gini(w: np.ndarray) -> np.ndarray:
    """Weight times Gini impurity over the last axis."""
    n = w.sum(axis=-1)
    return n - (w ** 2).sum(axis=-1) / np.where(n > 0, n, 1)


def _ranges(rows: DataFrame, p: int, routes: dict[int, Tree], nodes: dict[int, list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """(tree, node) -> least and largest value of each feature (p x 2)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = {t: np.full((len(n), p), np.inf) for t, n in nodes.items()}
        high = {t: np.full((len(n), p), -np.inf) for t, n in nodes.items()}
        for batch in batches:
            x = _matrix(batch.column("x"), p)
            for t, own in nodes.items():
                slot = np.full(len(routes[t].feature), -1)
                slot[own] = np.arange(len(own))
                at = slot[routes[t].leaf_of(x)]
                order = np.argsort(at.astype(np.int16) if len(own) < 2 ** 15 else at, kind="stable")  # short numbers are sorted by digits
                start = np.flatnonzero(np.append(True, np.diff(at[order]) != 0)) if len(order) else order
                where = at[order[start]]
                here = where >= 0
                if here.any():
                    small, large = (f.reduceat(x[order], start, axis=0)[here] for f in (np.fmin, np.fmax))
                    low[t][where[here]] = np.fmin(low[t][where[here]], small)
                    high[t][where[here]] = np.fmax(high[t][where[here]], large)
        for t, own in nodes.items():
            n, f = np.divmod(np.arange(len(own) * p), p)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t), pa.int32()), pa.array(np.array(own)[n], pa.int32()), pa.array(f, pa.int32()), pa.array(low[t].ravel()), pa.array(high[t].ravel())],
                                             names=["t", "node", "f", "low", "high"])

    got = rows.mapInArrow(count, "t int, node int, f int, low double, high double").groupBy("t", "node", "f").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    out = {(t, n): np.zeros((p, 2)) for t, own in nodes.items() for n in own}
    for t, n, f, a, b in zip(*(got.column(c).to_pylist() for c in ("t", "node", "f", "low", "high")), strict=True):
        out[t, n][f] = a, b
    return out


def _left_weights(rows: DataFrame, p: int, k: int, routes: dict[int, Tree], cuts: dict[int, dict[int, list[tuple[int, float]]]]) -> dict[tuple[int, int, int], np.ndarray]:
    """(tree, node, feature) -> class weights of the node's rows with a value at or below the cut."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, limit, slot, total = {}, {}, {}, {}
        for t, own in cuts.items():  # a node's i-th candidate in column i; a missing one holds no value
            shape = len(own), max(len(c) for c in own.values())
            feature[t], limit[t], slot[t] = np.zeros(shape, np.int64), np.full(shape, np.nan), np.full(len(routes[t].feature), -1)
            slot[t][list(own)] = np.arange(len(own))
            total[t] = np.zeros((shape[1], shape[0] * k))
            for j, c in enumerate(own.values()):
                feature[t][j, :len(c)], limit[t][j, :len(c)] = zip(*c, strict=True)
        for batch in batches:
            x, y, w = _matrix(batch.column("x"), p), batch.column("y").to_numpy(), batch.column("w").to_numpy()
            for t in cuts:
                at = slot[t][routes[t].leaf_of(x)]
                mine = np.flatnonzero(at >= 0)
                at = at[mine]
                for i in range(len(total[t])):
                    below = x[mine, feature[t][at, i]] <= limit[t][at, i]
                    left = mine[below]
                    total[t][i] += np.bincount(at[below] * k + y[left], w[left], total[t].shape[1])
        rows_ = [(t, n, f, cls, total[t][i, j * k + cls]) for t, own in cuts.items() for j, (n, c) in enumerate(own.items()) for i, (f, _) in enumerate(c)
                 for cls in np.flatnonzero(total[t][i, j * k:(j + 1) * k])]
        t, n, f, c, w = zip(*rows_, strict=True) if rows_ else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(n, pa.int32()), pa.array(f, pa.int32()), pa.array(c, pa.int32()), pa.array(w, pa.float64())], names=["t", "node", "f", "c", "w"])

    got = rows.mapInArrow(count, "t int, node int, f int, c int, w double").groupBy("t", "node", "f", "c").agg(F.sum("w").alias("w")).toArrow()
    out = {(t, n, f): np.zeros(k) for t, own in cuts.items() for n, c in own.items() for f, _ in c}
    for t, n, f, c, w in zip(*(got.column(x).to_pylist() for x in ("t", "node", "f", "c", "w")), strict=True):
        out[t, n, f][c] = w
    return out


class ExtraTreesClassifier(CustomEstimator):
    """every tree sees all rows; each node draws ``numCandidates`` features that vary in it (0: the square root
    of all) and one uniform cut between their least and largest value there, and takes the cut with the largest
    Gini decrease (ties: the first feature)."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth", TypeConverters.toInt)
    numCandidates = Param(Params._dummy(), "numCandidates", "candidate features of a node", TypeConverters.toInt)
    minRows = Param(Params._dummy(), "minRows", "least weight of a node that is split", TypeConverters.toFloat)

    def __init__(self, numTrees=100, maxDepth=10, numCandidates=0, minRows=2.0, **kw):
        super().__init__(**kw)
        self._setDefault(numTrees=100, maxDepth=10, numCandidates=0, minRows=2.0)
        self._set(numTrees=numTrees, maxDepth=maxDepth, numCandidates=numCandidates, minRows=minRows)

    def _fit(self, df):
        classes = label_classes(df, self.getLabelCol())
        number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(self.getLabelCol()).cast("double")) - 1
        data = df.where(F.col(self.getLabelCol()).isNotNull()).select(vector_to_array(F.col(self.getFeaturesCol()), "float64").alias("x"), number.cast("int").alias("y"), self._weight().cast("double").alias("w"))
        kept = stored_split(data.where("w > 0"), "extra-trees")
        totals = kept.frame.groupBy("y").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p")).collect()
        if not totals:
            raise ValueError("no rows to fit")
        k, p = len(classes), totals[0]["p"]
        whole = np.zeros(k)
        for r in totals:
            whole[r["y"]] = r["w"]
        rows = kept.frame.coalesce(1) if sum(r["n"] for r in totals) * p <= PARTITION_CELLS else kept.frame
        group = max(1, LEVEL_ROWS // (p * min(2 ** self.getOrDefault(self.maxDepth), int(whole.sum()) + 1)))
        trees: list[_Tree] = []
        for first in range(0, self.getOrDefault(self.numTrees), group):
            trees += self._grow(rows, range(first, min(first + group, self.getOrDefault(self.numTrees))), p, whole)
        kept.drop()
        m = self._copy_io(ExtraTreesModel())
        table = [[i, t.feature[n], t.threshold[n], t.left[n], t.right[n], t.totals[n].sum(), t.gain[n], *(t.totals[n] / max(t.totals[n].sum(), 1e-300))] for i, t in enumerate(trees) for n in range(len(t.feature))]
        m.set_fitted(classes, np.array(table))
        m.width = p
        return m

    def _grow(self, rows: DataFrame, numbers: range, p: int, whole: np.ndarray) -> list[_Tree]:
        trees = {t: _Tree(whole.copy()) for t in numbers}
        some, seed, deepest, least = self.getOrDefault(self.numCandidates) or max(1, int(p ** 0.5)), self.getSeed(), self.getOrDefault(self.maxDepth), self.getOrDefault(self.minRows)
        level = {t: [0] for t in numbers}
        while True:
            open_ = {t: [n for n in nodes if trees[t].depth[n] < deepest and trees[t].totals[n].sum() >= least and (trees[t].totals[n] > 0).sum() > 1] for t, nodes in level.items()}
            open_ = {t: nodes for t, nodes in open_.items() if nodes}
            if not open_:
                return list(trees.values())
            routes = {t: trees[t].router() for t in open_}
            span = _ranges(rows, p, routes, open_)
            cuts: dict = {}
            for t, nodes in open_.items():
                for n in nodes:
                    low, high = span[t, n][:, 0], span[t, n][:, 1]
                    drawn = sorted((draw(seed, t, trees[t].heap[n], f)[::-1] + (f,) for f in np.flatnonzero(low < high).tolist()))[:some]
                    if drawn:
                        cuts.setdefault(t, {})[n] = sorted((f, float(low[f] + u * (high[f] - low[f]))) for _, u, f in drawn)
            if not cuts:
                return list(trees.values())
            left = _left_weights(rows, p, len(whole), routes, cuts)
            level = {}
            for t, own in cuts.items():
                for n, candidates in own.items():
                    total = trees[t].totals[n]
                    best = None
                    for f, cut in candidates:
                        l = left[t, n, f]
                        gain = round(float(_gini(total) - _gini(l) - _gini(total - l)), 9)
                        if 0 < l.sum() < total.sum() and (best is None or gain > best[0]):
                            best = (gain, f, cut, l)
                    if best is not None:
                        trees[t].split(n, best[1], best[2], best[0], best[3])
                        level.setdefault(t, []).extend((trees[t].left[n], trees[t].right[n]))


class ExtraTreesModel(CompositePersistence, CustomModel):
    """Fitted nodes: tree, feature, threshold, left, right, weight, gain, and the share of each class."""

    width: int = 0
    _sub_values = ("width",)

    def tree_arrays(self):
        nodes = self.fitted()
        start = np.flatnonzero(np.append(True, np.diff(nodes[:, 0]) != 0))
        trees = [Tree(o[:, 1].astype(np.int64), o[:, 2], o[:, 3].astype(np.int64), o[:, 4].astype(np.int64), o[:, 7:], o[:, 5]) for o in np.split(nodes, start[1:])]
        return trees, [1.0 / len(trees)] * len(trees), np.zeros(nodes.shape[1] - 7)

    @property
    def featureImportances(self) -> DenseVector:
        nodes = self.fitted()
        inner = nodes[:, 1] >= 0
        gain = np.bincount(nodes[inner, 1].astype(int), nodes[inner, 6], self.width)
        return DenseVector(gain / gain.sum() if gain.sum() > 0 else gain)

    def _transform(self, df):
        trees, weights, _ = self.tree_arrays()
        k = len(self.getOrDefault(self.classes))

        @F.pandas_udf("array<double>")
        def shares(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            rows = np.stack(x.to_numpy()).astype(float)
            return pd.Series(list(sum(t.predict(rows) for t in trees) / len(trees)))

        cur = df.withColumn("__share", shares(self._features()))
        probs = [F.col("__share")[i] for i in range(k)]
        return with_scores(cur, self, probs, prob_cols=probs).drop("__share")
