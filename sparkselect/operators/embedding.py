"""I13 beyond linear components: landmark embedding with out-of-sample placement.

Classical scaling of a bounded set of landmarks fixes the space; every row is then placed from
its distances to the landmarks alone (de Silva & Tenenbaum 2004), one matrix product an Arrow
batch, with no shuffle. Distances are straight, or lengths of shortest paths over the landmarks'
neighbour graph, which unrolls curved data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which the landmarks are chosen, by the hash of their key.
SAMPLE_ROWS = 8192


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0.0))


def spread(points: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` of the distinct points, each the farthest from those before it."""
    points = np.unique(points, axis=0)
    chosen = [int(np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1)))] if len(points) else []
    far = np.full(len(points), np.inf)
    while chosen and len(chosen) < count:
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        at = int(np.argmax(far))
        if far[at] <= 0:
            break
        chosen.append(at)
    return points[chosen]


def path_lengths(d: np.ndarray, neighbors: int) -> np.ndarray:
    """Shortest paths over each point's nearest ``neighbors``; the least spanning tree keeps the graph whole."""
    m = len(d)
    g = np.full((m, m), np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :neighbors + 1]
    rows = np.repeat(np.arange(m), near.shape[1])
    g[rows, near.ravel()] = d[rows, near.ravel()]
    best, parent, todo = d[0].copy(), np.zeros(m, int), np.arange(m) > 0
    while todo.any():
        at = int(np.argmin(np.where(todo, best, np.inf)))
        todo[at] = False
        g[at, parent[at]] = d[at, parent[at]]
        nearer = todo & (d[at] < best)
        best[nearer], parent[nearer] = d[at][nearer], at
    g = np.minimum(g, g.T)
    np.fill_diagonal(g, 0.0)
    for k in range(m):
        g = np.minimum(g, g[:, k:k + 1] + g[k:k + 1])
    return g


class LandmarkSpace:
    """Landmarks (standardised), the lengths between them and the map from a row's squared lengths to k coordinates."""

    def __init__(self, points: np.ndarray, k: int, neighbors: int | None):
        self.points, self.k, self.neighbors = points, k, neighbors
        self.lengths = distances(points, points)
        np.fill_diagonal(self.lengths, 0.0)
        if neighbors is not None:
            self.lengths = path_lengths(self.lengths, neighbors)
        sq = self.lengths ** 2
        self.center = sq.mean(axis=0) if len(points) else np.zeros(0)
        b = -0.5 * (sq - self.center - self.center[:, None] + (sq.mean() if len(points) else 0.0))
        values, vectors = np.linalg.eigh(b) if len(points) else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(values)[::-1]
        self.values = values[order]
        top = min(k, int((self.values > 1e-10 * max(self.values.max(initial=0.0), 1e-300)).sum()))
        v = vectors[:, order[:top]]
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(top)] < 0, -1.0, 1.0) if top else v
        self.map = np.zeros((len(points), k))
        self.map[:, :top] = v / np.sqrt(self.values[:top])

    def lengths_from(self, z: np.ndarray) -> np.ndarray:
        d = distances(z, self.points)
        if self.neighbors is None or not len(self.points):
            return d
        near = np.argsort(d, axis=1, kind="stable")[:, :max(1, min(self.neighbors, len(self.points)))]
        out = np.full(d.shape, np.inf)
        for j in range(near.shape[1]):
            out = np.minimum(out, np.take_along_axis(d, near[:, j:j + 1], 1) + self.lengths[near[:, j]])
        return out

    def place(self, z: np.ndarray) -> np.ndarray:
        return -0.5 * (self.lengths_from(z) ** 2 - self.center) @ self.map


def landmark_embedding(df: DataFrame, features: Sequence[str], label: str, key: str, k: int = 2, landmarks: int = 256,
                       neighbors: int | None = None, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, DataFrame, LandmarkSpace]:
    """(rows, shares, space): (key, e1..ek, class) of every row, and each dimension's share of the
    positive eigenvalues. Features are standardised over all rows (a constant one becomes 0).

    At most ``landmarks`` distinct points are chosen, each farthest from those before, from a bounded
    sample of ``sample_rows`` rows; all rows are placed. ``neighbors`` None keeps straight distances: with
    k at least the rank of the landmarks they are kept exactly. Otherwise lengths are shortest paths over that many
    neighbours. Dimensions beyond the rank are 0, as are all of a table of equal rows. A null or NaN in
    ``features`` raises: impute first. An empty table gives no rows."""
    cols = [F.col(f"`{c}`").cast("double") for c in features]
    bad = F.max(F.greatest(*[(c.isNull() | F.isnan(c)).cast("int") for c in cols], F.lit(0)))
    r = df.agg(bad.alias("bad"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
               *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    if r["bad"]:
        raise ValueError("null or NaN in the features: impute first")
    mean = np.array([r[f"m{i}"] or 0.0 for i in range(len(cols))])
    sd = np.array([r[f"s{i}"] or 0.0 for i in range(len(cols))])
    scale = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1.0), 0.0)
    picked = df.select(F.xxhash64(F.col(f"`{key}`"), F.lit(123)).alias("h"), F.array(*cols).alias("x")) \
        .orderBy("h", "x").limit(sample_rows).collect()
    sample = (np.array([p["x"] for p in picked], float).reshape(len(picked), len(cols)) - mean) * scale
    space = LandmarkSpace(spread(sample, landmarks), k, neighbors)

    @F.pandas_udf("array<double>")
    def place(x: pd.DataFrame) -> pd.Series:
        z = (x.to_numpy(float) - mean) * scale
        return pd.Series(list(space.place(z)), index=x.index)

    at = df.select(F.col(f"`{key}`"), F.col(f"`{label}`").alias("class"), place(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)])).alias("__e"))
    rows = at.select(F.col(f"`{key}`"), *[F.col("__e")[i].alias(f"e{i + 1}") for i in range(k)], "class")
    positive = space.values[space.values > 0].sum()
    shares = [(i + 1, float(space.values[i] / positive) if i < len(space.values) and space.values[i] > 0 else 0.0) for i in range(k)]
    return rows, df.sparkSession.createDataFrame(shares, "component bigint, share double"), space
