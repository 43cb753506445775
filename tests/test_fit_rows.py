"""Iterative fits compute their rows once and let all cores read them."""
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sparkselect import session
from sparkselect.operators import extra_trees
from sparkselect.operators import prep as P
from sparkselect.operators.ensembles import AdaBoostClassifier, BaggingClassifier
from sparkselect.operators.models import make_estimator
from sparkselect.plans import catalog_models, catalog_prep
from sparkselect.plans.common import assemble

N = 400


def _events(spark, n=N):
    i = F.col("id")
    return spark.range(0, n, 1, 1).select(i.alias("event_id"), (i * 7 % 101).cast("double").alias("value"), (i * 13 % 97).cast("double").alias("k"), (i % 24).alias("h"),
                                          ((i * 7 % 101 + i * 13 % 97 + i % 24) > 100).cast("int").alias("y"))


@pytest.fixture
def counted(spark):
    """The events, and how many of their values were computed."""
    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v

    df = _events(spark)
    return df.withColumn("value", F.udf(seen, DoubleType()).asNondeterministic()("value")), read


def _xy(df):
    return assemble(df, ["value", "k", "h"]).withColumn("label", F.col("y").cast("double"))


def test_big_tables_are_dealt_and_small_ones_stay(spark, monkeypatch):
    df = _events(spark)
    small = session.stored_split(df, "t").frame
    assert small.rdd.getNumPartitions() == 1 and small.collect() == df.collect()
    monkeypatch.setattr(session, "FILE_ROWS", 50)
    wide = session.stored_split(df, "t").frame
    assert wide.rdd.getNumPartitions() > 1
    assert sorted(wide.collect()) == sorted(df.collect())


@pytest.mark.parametrize("fit", [
    lambda df: BaggingClassifier(base=make_estimator("dt", maxDepth=2), n=4, keyCol="event_id").fit(_xy(df)),
    lambda df: AdaBoostClassifier(numRounds=4).fit(_xy(df)),
    lambda df: P.ClusterFeature(["value", "k"], maxIter=3, ks=(2, 3)).fit(df),
], ids=["bagging", "ada", "clusters"])
def test_fits_read_the_source_once(counted, fit):
    df, read = counted
    fit(df)
    assert read.value <= 2 * N


def test_feature_scores_read_the_source_twice(counted):
    df, read = counted
    scores = P.feature_scores(df.withColumn("label", F.col("y").cast("double")), ["value", "k", "h"], "label").collect()
    assert len(scores) == 3 and read.value <= 3 * N


def test_menu_and_importance_read_the_source_once_to_fit(spark, counted, monkeypatch):
    df, read = counted
    monkeypatch.setattr(catalog_models, "t1_events", lambda *_: df)
    assert catalog_models._menu_query("rf", numTrees=3, maxDepth=3)(spark, "").count() > 0
    assert read.value <= 3 * N
    before = read.value
    monkeypatch.setattr(catalog_models, "make_estimator", lambda code: make_estimator(code, numTrees=3, maxDepth=3))
    assert catalog_models.i11_feature_importance(spark, "").count() == 3
    assert read.value - before <= 2 * N


def test_regressor_menu_reads_the_source_once_a_part(spark, counted, monkeypatch):
    df, read = counted
    lines = df.select(F.col("event_id").alias("l_orderkey"), F.col("k").alias("l_quantity"), (F.col("h") / 100).alias("l_discount"), F.lit(0.1).alias("l_tax"), F.col("value").alias("l_extendedprice"))
    monkeypatch.setattr(catalog_prep, "table", lambda *_: lines)
    whole = catalog_prep.make_regressor
    monkeypatch.setattr(catalog_prep, "make_regressor", lambda code, **io: whole(code, numTrees=3, maxIter=3, **io))
    assert catalog_prep.k1_regressor_menu(spark, "").count() == 3
    assert read.value <= 2 * N


def test_bagging_weights_of_a_member_are_those_of_its_hash(spark):
    from sparkselect.operators.ensembles import poisson_weight
    df = _xy(_events(spark))
    model = BaggingClassifier(base=make_estimator("dt", maxDepth=4), n=2, keyCol="event_id", seed=5).fit(df)
    for b, member in enumerate(model.members):
        boot = df.withColumn("__c", F.explode(F.expr("sequence(1, 100)"))).where(F.col("__c") <= poisson_weight("event_id", 5000 + b)).drop("__c")
        assert make_estimator("dt", maxDepth=4).fit(boot).toDebugString.split("\n", 1)[1] == member.toDebugString.split("\n", 1)[1]


def test_extra_trees_of_many_rows_are_grown_by_several_tasks(spark, monkeypatch):
    n, parts = 120_000, []
    monkeypatch.setattr(session, "FILE_ROWS", 30_000)
    grow = extra_trees.ExtraTreesClassifier._grow
    monkeypatch.setattr(extra_trees.ExtraTreesClassifier, "_grow", lambda self, rows, *more: parts.append(rows.rdd.getNumPartitions()) or grow(self, rows, *more))
    model = extra_trees.ExtraTreesClassifier(numTrees=2, maxDepth=2).fit(_xy(_events(spark, n)))
    assert parts[0] > 1 and np.isclose(model.fitted()[0, 5], n)
