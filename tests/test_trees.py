"""Boosting, extra trees and Shapley values of trees against plain implementations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sparkselect.operators import boosting, extra_trees
from sparkselect.operators.models import make_estimator
from sparkselect.operators.trees import Tree, ensemble_of, expected, shapley_table, tree_shapley


def frame(spark, n=600, k=2, seed=5, p=4):
    rnd = np.random.default_rng(seed)
    x = np.round(rnd.normal(size=(n, p)), 1)
    score = x[:, 0] + (x[:, 1] > 0.3) * 1.5 + x[:, 0] * x[:, 2]
    y = np.digitize(score, np.quantile(score, np.arange(1, k) / k))
    w = rnd.integers(1, 3, n)
    return spark.createDataFrame([(i, Vectors.dense(r.tolist()), float(c), float(v)) for i, (r, c, v) in enumerate(zip(x, y, w))], ["id", "features", "label", "w"]), x, y, w


def grow_leafwise(x, y, rounds, leaves, least, step):
    """Best-first boosting of one class, every cut, plain loops."""
    p = y.mean()
    score = np.full(len(y), math.log(p / (1 - p)))
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)

        def best(rows):
            top = (1e-9, None)
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    go = x[rows, f] <= cut
                    if min(go.sum(), (~go).sum()) >= least:
                        a, b = rows[go], rows[~go]
                        gain = round(g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[rows].sum() ** 2 / h[rows].sum(), 9)
                        if gain > top[0]:
                            top = (gain, (a, b))
            return top
        front = [(np.arange(len(y)), best(np.arange(len(y))))]
        while len(front) < leaves and any(b[1] for _, b in front):
            i = max((i for i in range(len(front)) if front[i][1][1]), key=lambda i: front[i][1][0])
            _, (_, (a, b)) = front.pop(i)
            front += [(a, best(a)), (b, best(b))]
        for rows, _ in front:
            score[rows] += step * g[rows].sum() / h[rows].sum()
    return 1 / (1 + np.exp(-score))


@pytest.mark.parametrize(("parts", "rounds"), [(1, 11), (3, 2)])
def test_leafwise_boosting_equals_plain_loops(spark, parts, rounds, monkeypatch):
    df, x, y, _ = frame(spark)
    if parts > 1:
        monkeypatch.setattr(boosting, "PARTITION_CELLS", 0)
        df = df.repartition(parts, "id")
    model = boosting.LeafBoostingClassifier(maxIter=rounds, numLeaves=5, minRows=10.0, otherRate=0.0).fit(df)
    got = np.array([r.probability[1] for r in model.transform(df).orderBy("id").collect()])
    assert np.allclose(got, grow_leafwise(x, y, rounds, 5, 10, 0.1), atol=1e-7)
    nodes = model.fitted()
    assert all((nodes[nodes[:, 0] == t, 2] < 0).sum() <= 5 for t in range(rounds))
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9


def test_gradient_sampling_keeps_quality_and_repeats(spark):
    df, _, y, _ = frame(spark, n=3000)
    fit = lambda rate: boosting.LeafBoostingClassifier(maxIter=8, numLeaves=5, stepSize=0.4, otherRate=rate).fit(df)
    one, again, whole = fit(0.1), fit(0.1), fit(0.0)
    assert np.array_equal(one.fitted(), again.fitted()) and not np.array_equal(one.fitted(), whole.fitted())
    right = [m.transform(df).where("prediction = label").count() / len(y) for m in (one, whole)]
    assert right[0] > 0.9 and abs(right[0] - right[1]) < 0.06
    sampled = one.fitted()
    roots = sampled[np.append(True, np.diff(sampled[:, 0]) != 0), 7]
    assert (roots[:3] == len(y)).all() and (abs(roots[3:] - len(y)) < 0.15 * len(y)).all()


def test_softmax_boosting(spark, tmp_path):
    df, x, y, w = frame(spark, k=3)
    model = make_estimator("gbc", n_classes=3, maxIter=6, stepSize=0.5, weight="w").fit(df)
    out = model.transform(df)
    assert out.where("prediction = label").count() > 0.88 * len(y)
    assert max(abs(sum(r.probability) - 1) for r in out.select("probability").take(50)) < 1e-9
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = boosting.BoostedTreesModel.load(str(tmp_path / "m"))
    assert loaded.transform(df).select("prediction").collect() == out.select("prediction").collect()
    # weights count like repeated rows
    twice = df.withColumn("one", F.lit(1.0)).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    a = make_estimator("gbc", n_classes=3, maxIter=1, weight="w").fit(df).fitted()
    b = make_estimator("gbc", n_classes=3, maxIter=1).fit(twice).fitted()
    assert np.allclose(a, b, atol=1e-6)


def test_boosting_edges(spark):
    same = spark.range(60).withColumn("label", (F.col("id") % 2).cast("double"))
    flat = VectorAssembler(inputCols=["c", "n"], outputCol="features", handleInvalid="keep").transform(same.withColumn("c", F.lit(1.0)).withColumn("n", F.lit(float("nan"))))
    m = boosting.LeafBoostingClassifier(maxIter=3).fit(flat)
    assert {round(r.probability[1], 6) for r in m.transform(flat).collect()} == {0.5}
    with pytest.raises(ValueError):
        boosting.LeafBoostingClassifier().fit(flat.where("id < 0"))


def test_extra_trees_follow_their_draws(spark, monkeypatch):
    df, x, y, _ = frame(spark, k=3)
    est = lambda: extra_trees.ExtraTreesClassifier(numTrees=4, maxDepth=4, numCandidates=2, seed=9)
    model = est().fit(df)
    monkeypatch.setattr(extra_trees, "LEVEL_ROWS", 100)
    monkeypatch.setattr(extra_trees, "PARTITION_CELLS", 0)
    assert np.allclose(est().fit(df.repartition(3)).fitted(), model.fitted())
    gini = lambda rows: len(rows) - sum(np.bincount(y[rows], minlength=3) ** 2) / len(rows)
    trees, _, _ = model.tree_arrays()

    def check(t, tree, node, heap, rows, depth):
        assert tree.cover[node] == len(rows)
        assert np.allclose(tree.value[node], np.bincount(y[rows], minlength=3) / len(rows))
        if tree.feature[node] < 0:
            return
        vary = [f for f in range(x.shape[1]) if x[rows, f].min() < x[rows, f].max()]
        some = sorted((extra_trees.draw(9, t, heap, f)[1], f) for f in vary)[:2]
        best = max((round(gini(rows) - gini(rows[go]) - gini(rows[~go]), 9), -f, cut) for _, f in some
                   for cut in [x[rows, f].min() + extra_trees.draw(9, t, heap, f)[0] * (x[rows, f].max() - x[rows, f].min())] for go in [x[rows, f] <= cut] if 0 < go.sum() < len(rows))
        assert (tree.feature[node], round(tree.threshold[node], 9)) == (-best[1], round(best[2], 9)) and depth < 4
        go = x[rows, tree.feature[node]] <= tree.threshold[node]
        check(t, tree, tree.left[node], 2 * heap + 1, rows[go], depth + 1)
        check(t, tree, tree.right[node], 2 * heap + 2, rows[~go], depth + 1)

    for t, tree in enumerate(trees):
        check(t, tree, 0, 0, np.arange(len(y)), 0)
    assert make_estimator("et", numTrees=10, maxDepth=6).fit(df).transform(df).where("prediction = label").count() > 0.7 * len(y)


def plain_shapley(tree: Tree, row: np.ndarray) -> np.ndarray:
    """Over all coalitions; an unknown feature sends a node's cover both ways."""
    p = len(row)

    def value(known, node=0):
        if tree.feature[node] < 0:
            return tree.value[node]
        l, r = tree.left[node], tree.right[node]
        if tree.feature[node] in known:
            return value(known, l if row[tree.feature[node]] <= tree.threshold[node] else r)
        return (tree.cover[l] * value(known, l) + tree.cover[r] * value(known, r)) / tree.cover[node]

    out = np.zeros((p, tree.value.shape[1]))
    for f in range(p):
        others = [g for g in range(p) if g != f]
        for size in range(p):
            weight = math.factorial(size) * math.factorial(p - size - 1) / math.factorial(p)
            for s in itertools.combinations(others, size):
                out[f] += weight * (value({*s, f}) - value(set(s)))
    return out


def test_shapley_values_equal_enumeration(spark):
    df, x, _, _ = frame(spark, n=300, p=5)
    model = make_estimator("rf", numTrees=3, maxDepth=6).fit(df)
    trees, weights, base = ensemble_of(model)
    rows = x[:12]
    for tree in trees:
        got = tree_shapley(tree, rows)
        assert np.allclose(got, np.array([plain_shapley(tree, r) for r in rows]), atol=1e-9)
        assert np.allclose(expected(tree) + got.sum(axis=1), tree.predict(rows), atol=1e-9)


@pytest.mark.parametrize("code", ["dt", "rf", "gbc", "lightgbm", "et"])
def test_shapley_tables_add_up_to_the_model(spark, code):
    df, x, _, _ = frame(spark, n=200)
    small = {"maxIter": 2} if code in ("gbc", "lightgbm") else {"maxDepth": 4} if code == "dt" else {"numTrees": 3, "maxDepth": 4}
    model = make_estimator(code, **small).fit(df)
    names = [f"x{i}" for i in range(4)]
    table = shapley_table(model, df, names, "id")
    sums = table.groupBy("id", "output").agg((F.sum("shap") + F.first("base")).alias("f"), F.first("prediction").alias("prediction"), F.count(F.lit(1)).alias("n")).toPandas()
    assert (sums.n == 4).all() and np.allclose(sums.f, sums.prediction)
    scored = model.transform(df).toPandas().set_index("id")
    one = sums[sums.output == sums.output.max()].set_index("id").prediction
    want = scored.probability.map(lambda v: v[1])
    shown = one if code in ("dt", "rf", "et") else 1 / (1 + np.exp(-one * (2 if code == "gbc" else 1)))
    assert np.allclose(shown.sort_index(), want.sort_index(), atol=1e-6)
    assert shapley_table(model, df.where("id < 0"), names, "id").collect() == []


@pytest.mark.parametrize(("kind", "k"), [(boosting.SoftmaxBoostingClassifier, 3), (boosting.LeafBoostingClassifier, 2)])
def test_splits_of_many_bins_are_found_where_the_sums_are(spark, monkeypatch, kind, k):
    """same trees whether the driver holds the histograms or gets the best splits alone."""
    df, *_ = frame(spark, k=k)
    fit = lambda: kind(maxIter=2, minRows=5.0, maxDepth=3, otherRate=0.0 if k == 2 else None).fit(df).fitted()
    dense = fit()
    monkeypatch.setattr(boosting, "DENSE_BINS", 0)
    monkeypatch.setattr(boosting, "WIDE_ROWS", 100)
    monkeypatch.setattr(boosting._Rows, "histograms", None)
    assert np.allclose(dense, fit(), atol=1e-9)


def test_boosting_rows_are_dealt_and_scores_written_every_round(spark, monkeypatch):
    """large row tables have several partitions, no round follows more trees than the last round's."""
    df, *_ = frame(spark, n=1000)
    fit = lambda: boosting.LeafBoostingClassifier(maxIter=4, numLeaves=5, stepSize=0.5, otherRate=0.1).fit(df).fitted()
    one, seen = fit(), []
    counted = boosting._Rows._counted
    monkeypatch.setattr(boosting._Rows, "_counted", lambda rows: (seen.append((len(rows.recent), rows.table.one)), counted(rows))[1])
    monkeypatch.setattr(boosting, "PART_ROWS", 100)
    assert np.allclose(one, fit(), atol=1e-9)
    assert seen and all(s == (0, False) for s in seen)


def test_leaves_at_the_deepest_level_are_not_counted(spark, monkeypatch):
    """a tree of depth 2 takes two passes over the rows."""
    df, *_ = frame(spark, k=3)
    passes, count = [], boosting._Rows.histograms
    monkeypatch.setattr(boosting._Rows, "histograms", lambda rows, *a: (passes.append(1), count(rows, *a))[1])
    boosting.SoftmaxBoostingClassifier(maxIter=2, maxDepth=2).fit(df)
    assert len(passes) == 4


@pytest.mark.parametrize(("kind", "k"), [(boosting.SoftmaxBoostingClassifier, 3), (boosting.LeafBoostingClassifier, 2)])
@pytest.mark.parametrize("parts", [1, 3])
def test_every_value_is_a_cut_point_beyond_the_bins(spark, monkeypatch, kind, k, parts):
    """F8: with more values than bins the trees are those of a bin for every value, whatever the coarse bins are."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(900, 3))
    x[:, 2] = np.round(x[:, 2])
    y = np.digitize(x[:, 0] + 0.5 * x[:, 1] + rnd.normal(size=900), [0.0] if k == 2 else [-0.5, 0.5])
    x[::17, 1] = np.nan
    df = spark.createDataFrame([(i, Vectors.dense(r.tolist()), float(c), float(1 + i % 2)) for i, (r, c) in enumerate(zip(x, y))], ["id", "features", "label", "w"])
    fit = lambda **kw: kind(maxIter=2, minRows=5.0, maxDepth=3, otherRate=0.0 if k == 2 else None, weightCol="w", **kw).fit(df).fitted()
    dense = fit(maxBins=1000)
    monkeypatch.setattr(boosting, "COARSE_BINS", 12)
    monkeypatch.setattr(boosting, "GROUP_BINS", 2)
    if parts > 1:
        monkeypatch.setattr(boosting, "PART_ROWS", 300)
        monkeypatch.setattr(boosting, "BLOCK_ROWS", 70)
        monkeypatch.setattr(boosting, "WIDE_ROWS", 100)
        monkeypatch.setattr(boosting, "DRIVER_CELLS", 0)
    got = fit(maxBins=12, everyCut=True)
    assert got.shape == dense.shape and (got[:, 2] >= 0).sum() > 6 and np.allclose(got, dense, atol=1e-9)


def test_boosting_rows_lie_in_records_of_many_rows(spark, monkeypatch):
    """a pass reads a few records without copies, not a record a row."""
    df, *_ = frame(spark, n=1000)
    seen, counted = [], boosting._Rows._counted
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 400)
    monkeypatch.setattr(boosting._Rows, "_counted", lambda rows: (seen.append((rows.table.frame.count(), rows.sampled and rows.sampled.frame.count())), counted(rows))[1])
    boosting.LeafBoostingClassifier(maxIter=3, numLeaves=3, stepSize=0.5, otherRate=0.1).fit(df)
    assert {s[0] for s in seen} == {3} and {s[1] for s in seen} == {None, 3}
