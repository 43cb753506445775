"""Edge cases of SURVEY 5.3 and property checks against plain NumPy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkselect.functions.metrics import classification_metrics
from sparkselect.functions.ranking import running_totals
from sparkselect.operators import split as S
from sparkselect.operators.models import make_estimator
from sparkselect.operators.profile import profile_numeric, profile_overview
from sparkselect.plans.common import assemble


def test_one_class_only(spark):
    df = assemble(spark.createDataFrame([(float(i), 1.0) for i in range(20)], "x double, label double"), ["x"])
    m = make_estimator("dummy").fit(df)
    r = classification_metrics(m.transform(df), "label", "prediction").first()
    assert r["accuracy"] == 1.0 and r["auc"] is None


def test_small_class_folds(spark):
    rows = [(i, 1 if i < 4 else 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, y int")
    f = S.stratified_folds(df, "y", "id", 10)
    per = {r["fold"]: r["c"] for r in f.where("y = 1").groupBy("fold").agg(F.count("*").alias("c")).collect()}
    assert sum(per.values()) == 4 and max(per.values()) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, y double")
    assert profile_overview(df).first()["rows"] == 0
    assert classification_metrics(df, "x", "y").count() == 0
    assert profile_numeric(df, ["x"]).first()["count"] == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=60))
def test_accuracy_kappa_vs_numpy(spark, pairs):
    df = spark.createDataFrame(pairs, "y int, p int")
    r = classification_metrics(df, "y", "p").first()
    y, p = np.array(pairs).T
    assert r["accuracy"] == pytest.approx((y == p).mean())
    labels = sorted(set(y) | set(p))
    po = (y == p).mean()
    pe = sum((y == c).mean() * (p == c).mean() for c in labels)
    if pe != 1:
        assert r["kappa"] == pytest.approx((po - pe) / (1 - pe))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=200), st.integers(1, 6))
def test_running_totals_vs_cumsum(spark, xs, slices):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, x long")
    got = [r["s"] for r in running_totals(df, ["id"], {"s": "x"}, slices=slices).orderBy("id").collect()]
    assert got == list(np.cumsum(xs))


def test_approx_profiles_close(spark):
    from sparkselect.operators.profile import profile_distinct, profile_quantiles
    from sparkselect.sources.io import table
    li = table(spark, "/root/testdata/sf0.001", "lineitem")
    ex = {r["column"]: r for r in profile_quantiles(li, ["l_quantity"]).collect()}
    ap = {r["column"]: r for r in profile_quantiles(li, ["l_quantity"], approx=True).collect()}
    assert abs(ex["l_quantity"]["p50"] - ap["l_quantity"]["p50"]) <= 1.0
    d = profile_distinct(li, ["l_quantity"], approx=True).first()
    assert abs(d["distinct"] - 50) <= 3


def test_empty_table_profiles(spark):
    from sparkselect.operators.profile import profile_missing, profile_quantiles
    df = spark.createDataFrame([], "x double, y double")
    per, pairs = profile_missing(df, ["x", "y"])
    assert per.count() == 2 and pairs.count() == 0
    assert profile_quantiles(df, ["x"]).count() == 0
