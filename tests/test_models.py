import tempfile

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from sparkselect.functions.metrics import classification_metrics
from sparkselect.operators import ensembles as EN
from sparkselect.operators import split as S
from sparkselect.operators.models import make_estimator


@pytest.fixture(scope="module")
def tt(t1):
    return S.holdout(t1, "event_id")


def _acc(model, df):
    return classification_metrics(model.transform(df), "label", "prediction").first()["accuracy"]


@pytest.mark.parametrize("code", ["lda", "qda", "ridge", "nb", "lr", "dt", "knn"])
def test_beats_dummy(tt, code):
    tr, te = tt
    dummy = _acc(make_estimator("dummy").fit(tr), te)
    assert _acc(make_estimator(code).fit(tr), te) > dummy + 0.1


def test_weight_two_equals_duplicate(spark, tt):
    tr, te = tt
    dup = tr.unionByName(tr.where(F.col("event_id") % 5 == 0))
    w = tr.withColumn("w", F.when(F.col("event_id") % 5 == 0, 2.0).otherwise(1.0))
    for code in ("lda", "qda", "ridge"):
        a = make_estimator(code).fit(dup).transform(te).select("event_id", "rawPrediction").orderBy("event_id").collect()
        b = make_estimator(code, weight="w").fit(w).transform(te).select("event_id", "rawPrediction").orderBy("event_id").collect()
        for x, y in zip(a, b):
            assert x[1].toArray() == pytest.approx(y[1].toArray(), rel=1e-6, abs=1e-6)


def test_save_load_same_predictions(spark, tt):
    tr, te = tt
    d = tempfile.mkdtemp(prefix="sparkselect-test-", dir="/tmp")
    for name, est in {"lda": make_estimator("lda"), "ada": make_estimator("ada", numRounds=3),
                      "bag": EN.BaggingClassifier(base=make_estimator("dt"), n=2, keyCol="event_id")}.items():
        pm = Pipeline(stages=[est]).fit(tr)
        pm.write().overwrite().save(f"{d}/{name}")
        back = PipelineModel.load(f"{d}/{name}")
        a = pm.transform(te).select("event_id", "prediction").orderBy("event_id").collect()
        b = back.transform(te).select("event_id", "prediction").orderBy("event_id").collect()
        assert a == b


def test_scoring_order_independent(tt):
    tr, te = tt
    m = make_estimator("qda").fit(tr)
    a = sorted(m.transform(te).select("event_id", "prediction").collect())
    b = sorted(m.transform(te.repartition(5).orderBy(F.rand(1))).select("event_id", "prediction").collect())
    assert a == b


def test_knn_matches_bruteforce(spark):
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(3)
    base = [(i, rng.normal(size=4).tolist(), float(i % 3)) for i in range(300)]
    qs = [(1000 + i, rng.normal(size=4).tolist()) for i in range(40)]
    b = spark.createDataFrame(base, "id long, x array<double>, label double").withColumn("features", array_to_vector("x"))
    q = spark.createDataFrame(qs, "id long, x array<double>").withColumn("features", array_to_vector("x"))
    est = make_estimator("knn", k=5)
    est._set(baseKeyCol="id")
    got = {r["id"]: r["prediction"] for r in est.fit(b).transform(q).collect()}
    X = np.array([r[1] for r in base])
    y = np.array([r[2] for r in base])
    for qid, qx in qs:
        d = ((X - np.array(qx)) ** 2).sum(axis=1)
        nn = np.lexsort((np.arange(len(X)), d))[:5]
        counts = np.bincount(y[nn].astype(int), minlength=3)
        assert got[qid] == float(np.argmax(counts))


def test_folds_are_numbered_once_for_curves_and_settings(spark, monkeypatch):
    """I8 computes every source row once, the values of I10 share folds, the settings of ridge a fold's sums."""
    from pyspark.ml.feature import VectorAssembler

    from sparkselect.operators import diagnose as D
    from sparkselect.operators import estimators, select as G
    from sparkselect.operators.models import make_estimator
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    raw = spark.createDataFrame([(i, float(i % 7), float(i % 5), float((i * i) % 3 > 0), i % 3) for i in range(90)], "id long, a double, b double, label double, fold long")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(raw.mapInPandas(count, raw.schema))
    dt = make_estimator("dt", maxDepth=2)
    assert D.rfe_table(dt, df, ["a", "b"]).count() == 2 and seen.value == 90
    made, frames = [], G.fold_frames
    monkeypatch.setattr(G, "fold_frames", lambda *a, **kw: (made.append(1), frames(*a, **kw))[1])
    assert D.validation_table(dt, "maxDepth", [1, 2], df).count() == 2 and len(made) == 1
    done, fold_sums = [], estimators.Summarizer.sum
    monkeypatch.setattr(estimators.Summarizer, "sum", staticmethod(lambda *a: (done.append(1), fold_sums(*a))[1]))
    _, table, _ = G.tune(make_estimator("ridge"), "ridge", df, "F1")
    assert table.count() == 6 and len(done) == 2 * 3
