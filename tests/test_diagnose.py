"""Curves and tables against direct NumPy computations on a small scored fixture."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkselect.operators import diagnose as D


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 400)
    s = np.round(np.clip(0.3 * y + rng.normal(0.35, 0.2, 400), 0, 1), 2)  # ties on purpose
    rows = [(int(i), int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "id long, y int, score double"), y, s


def test_auc_equals_pair_count(scored):
    df, y, s = scored
    pos, neg = s[y == 1], s[y == 0]
    pairs = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    got = D.auc_score(df, "y", "score").first()["auc"]
    assert got == pytest.approx(pairs / (len(pos) * len(neg)), abs=1e-12)


def test_roc_points(scored):
    df, y, s = scored
    roc = {r["threshold"]: (r["fpr"], r["tpr"]) for r in D.roc_table(df, "y", "score").collect()}
    for t in [0.2, 0.5, 0.7]:
        if t in roc:
            assert roc[t][1] == pytest.approx(((s >= t) & (y == 1)).sum() / (y == 1).sum())
            assert roc[t][0] == pytest.approx(((s >= t) & (y == 0)).sum() / (y == 0).sum())


def test_threshold_table(scored):
    df, y, s = scored
    t = {round(r["threshold"], 2): r for r in D.threshold_table(df, "y", "score").collect()}
    for th in [0.0, 0.35, 0.5, 1.0]:
        pred = s >= th
        tp = (pred & (y == 1)).sum()
        assert t[th]["queue_rate"] == pytest.approx(pred.mean())
        assert t[th]["recall"] == pytest.approx(tp / (y == 1).sum())


def test_deciles_sizes(scored):
    df, y, s = scored
    lt = D.lift_table(df, "y", "score", "id").orderBy("decile").collect()
    assert [r["rows"] for r in lt] == [40] * 10
    assert sum(r["positives"] for r in lt) == int(y.sum())


def test_ks_max(scored):
    df, y, s = scored
    ks = D.ks_table(df, "y", "score").agg(F.max("ks")).first()[0]
    best = max(((s >= t) & (y == 1)).sum() / (y == 1).sum() - ((s >= t) & (y == 0)).sum() / (y == 0).sum()
               for t in np.unique(s))
    assert ks == pytest.approx(best)


def test_best_split_matches_scan(spark):
    rows = [(float(x), int(x > 3)) for x in [1, 2, 3, 4, 5, 6, 2, 5]]
    df = spark.createDataFrame(rows, "x double, y int")
    r = D.best_split_table(df, ["x"], "y").first()
    assert r["threshold"] == 3.0 and r["left_rows"] == 4


def _passes(spark, run):
    """How often Spark read the counted rows while ``run(df)`` ran."""
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    rows = [(i, float(i % 2), float(i % 7), float(i % 11), i // 50) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, label double, a double, b double, fold long").mapInPandas(count, "id long, label double, a double, b double, fold long")
    run(df)
    return seen.value / len(rows)


def test_folds_read_their_rows_once(spark):
    from pyspark.ml.feature import VectorAssembler

    from sparkselect.operators.ensembles import StackingClassifier
    from sparkselect.operators.models import make_estimator
    x = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    assert _passes(spark, lambda df: StackingClassifier(bases=[make_estimator("lda")], foldCol="fold").fit(x.transform(df))) == 1
    table = []
    assert _passes(spark, lambda df: table.extend(D.learning_table(make_estimator("lda"), x.transform(df), "id", steps=[0.5, 1.0]).collect())) == 1
    assert [r["share"] for r in table] == [0.5, 1.0] and table[1]["train_rows"] == 50


def test_preparation_reads_its_rows_once(spark):
    from sparkselect.operators.roles import Roles
    from sparkselect.plans.auto import AutoConfig, AutoPrep
    cfg = AutoConfig(roles=Roles(target="y", numeric=["a", "b"], high_cardinality=["fold"]), flags={"imputation": "simple"})
    models = []
    # one more pass numbers the labels
    assert _passes(spark, lambda df: models.append(AutoPrep(cfg).fit(df.withColumnRenamed("label", "y")))) <= 2
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 1), (0.0, 1.0, 2.0, 99)], "y double, a double, b double, fold long")
    # the counts stay with the model after the rows that they were taken from are gone
    assert sorted(r["fold__count"] for r in models[0].transform(df).select("fold__count").collect()) == [0, 50]


def test_shapley_hashes_each_draw_once(spark):
    from pyspark.ml.feature import VectorAssembler

    from sparkselect.operators.models import make_estimator
    df = spark.createDataFrame([(i, float(i % 2), float(i % 7), float(i % 11), float(i % 5)) for i in range(60)], "id long, label double, a double, b double, c double")
    model = make_estimator("nb").fit(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df))
    plan = D.interpret_shapley(model, df, ["a", "b", "c"], "id")._jdf.queryExecution().optimizedPlan().toString()
    # the features' ranks, the background row (also filtered on) and its choice; not each of them in every comparison
    assert plan.count("md5(") <= 6
