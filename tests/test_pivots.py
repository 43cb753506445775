"""k nearest neighbours by pivot partitions: the rows of brute force, few of its pairs."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sparkselect.operators import pivots
from sparkselect.operators.neighbors import knn_candidates


def _table(spark, X, key):
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, f"{key} long, a array<double>").select(key, array_to_vector("a").alias("x"))


def _brute(Q, B, k, exclude_self=False):
    out = []
    for i, x in enumerate(Q):
        d = ((B - x) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(B)), d)) if not (exclude_self and i == j)][:k]
        out += [(i, int(j), r + 1, float(d[j])) for r, j in enumerate(order)]
    return out


def _clusters(seed, n, dim, far=20.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(scale=far, size=(25, dim))
    return np.round(centers[rng.integers(0, 25, n)] + rng.normal(size=(n, dim)), 2)


CASES = {
    "clusters": (_clusters(1, 3000, 3), _clusters(1, 400, 3)),
    "no structure": (np.random.default_rng(2).normal(size=(1500, 12)), np.random.default_rng(3).normal(size=(150, 12))),
    "ties on a grid": (np.indices((40, 40)).reshape(2, -1).T.astype(float), np.indices((13, 13)).reshape(2, -1).T + 0.5),
    "a third are one point": (np.vstack([np.zeros((700, 2)), _clusters(4, 1400, 2)]), np.vstack([np.zeros((40, 2)), _clusters(4, 100, 2)])),
    "far from the origin": (1e7 + _clusters(5, 1200, 2), 1e7 + _clusters(5, 120, 2)),
    "fewer rows than k": (_clusters(6, 4, 2), _clusters(6, 9, 2)),
}


@pytest.mark.parametrize("case", CASES)
def test_same_rows_as_brute_force(spark, case):
    B, Q = CASES[case]
    got = knn_candidates(_table(spark, Q, "q"), _table(spark, B, "b"), 6, "q", "b", "x", "x", block_rows=2 if len(B) < 10 else 160)
    assert sorted((r["q"], r["b"], r["nb_rank"], r["dist2"]) for r in got.collect()) == sorted(_brute(Q, B, 6))


def test_self_is_left_out(spark):
    B = _clusters(7, 900, 2)
    t = _table(spark, B, "b")
    got = knn_candidates(t, t, 3, "b", "b", "x", "x", exclude_self=True, block_rows=100)
    assert sorted((r["qkey"], r["b"], r["nb_rank"], r["dist2"]) for r in got.collect()) == sorted(_brute(B, B, 3, True))


def test_few_pairs_are_formed(spark):
    B, Q = _clusters(8, 4000, 3), _clusters(8, 500, 3)
    b, q = _table(spark, B, "bk"), _table(spark, Q, "qk")
    arrays = [t.select(t.columns[0], vector_to_array("x").alias("x")) for t in (q, b)]
    qs, bs, pairs = pivots.pivot_blocks(*arrays, nearest=5, block_rows=400, rows=len(B))
    assert pairs <= 0.15 * len(B) * len(Q)
    met = qs.groupBy("qb", "bb").agg(F.count("*").alias("n")).join(bs.groupBy("qb", "bb").agg(F.count("*").alias("m")), ["qb", "bb"])
    assert met.agg(F.sum(F.col("n") * F.col("m"))).first()[0] == pairs and met.agg(F.max("m")).first()[0] <= 400


@pytest.mark.parametrize("block_rows", [100, 10_000])
def test_vectors_that_are_not_finite_take_no_part(spark, block_rows):
    B = _clusters(9, 600, 2)
    B[5], B[6] = [np.nan, 1.0], [np.inf, 0.0]
    Q = np.vstack([_clusters(9, 30, 2), [[np.nan, 0.0]]])
    got = knn_candidates(_table(spark, Q, "q"), _table(spark, B, "b"), 4, "q", "b", "x", "x", block_rows=block_rows)
    finite = np.delete(np.arange(600), [5, 6])
    want = [(i, int(finite[j]), r, d) for i, j, r, d in _brute(Q[:30], B[finite], 4)]
    assert sorted((r["q"], r["b"], r["nb_rank"], r["dist2"]) for r in got.collect()) == sorted(want)


def test_empty_sides(spark):
    B = _clusters(10, 50, 2)
    none = _table(spark, B, "b").limit(0)
    assert knn_candidates(_table(spark, B, "q"), none, 3, "q", "b", "x", "x").count() == 0
    assert knn_candidates(none, _table(spark, B, "q"), 3, "b", "q", "x", "x", block_rows=20).count() == 0
