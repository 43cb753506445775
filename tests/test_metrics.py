"""H1-H9 against the golden confusion counts of the shipped prediction file."""

import math

import pytest
from pyspark.sql import functions as F

from sparkselect.functions.metrics import classification_metrics, metric_table

# Confusion counts of Outcome x Predictions in the shipped file, and the
GOLDEN = {"tn": 457, "fp": 43, "fn": 47, "tp": 221}
EXPECTED = {"accuracy": 0.882813, "auc": 0.869313, "recall": 0.824627, "precision": 0.837121,
            "f1": 0.830827, "kappa": 0.741193, "mcc": 0.741242}


def _golden(spark):
    rows = ([(0, 0)] * GOLDEN["tn"] + [(0, 1)] * GOLDEN["fp"] + [(1, 0)] * GOLDEN["fn"] + [(1, 1)] * GOLDEN["tp"])
    return spark.createDataFrame(rows, "Outcome int, Predictions int")


def test_golden_metrics(spark):
    r = classification_metrics(_golden(spark), "Outcome", "Predictions").first()
    assert r["n"] == 768
    for k, v in EXPECTED.items():
        assert r[k] == pytest.approx(v, abs=1e-6), k


def test_metric_table_one_pass_equals_single(spark):
    df = _golden(spark).withColumn("flip", 1 - F.col("Predictions"))
    t = {r["model"]: r for r in metric_table(df, "Outcome", {"a": "Predictions", "b": "flip"}).collect()}
    assert t["a"]["accuracy"] == pytest.approx(EXPECTED["accuracy"], abs=1e-6)
    assert t["b"]["accuracy"] == pytest.approx(1 - EXPECTED["accuracy"], abs=1e-6)


def test_multiclass_nulls_binary_metrics(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (2, 1)], "y int, p int")
    r = classification_metrics(df, "y", "p").first()
    assert r["accuracy"] == pytest.approx(0.75)
    assert r["recall"] is None and r["auc"] is None and r["f1"] is None
    assert r["mcc"] is not None and r["kappa"] is not None


def test_single_class_truth(spark):
    df = spark.createDataFrame([(1, 1), (1, 0)], "y int, p int")
    r = classification_metrics(df, "y", "p").first()
    assert r["auc"] is None
    assert r["recall"] == pytest.approx(0.5)


def test_mcc_matches_formula(spark):
    g = GOLDEN
    num = g["tp"] * g["tn"] - g["fp"] * g["fn"]
    den = math.sqrt((g["tp"] + g["fp"]) * (g["tp"] + g["fn"]) * (g["tn"] + g["fp"]) * (g["tn"] + g["fn"]))
    r = classification_metrics(_golden(spark), "Outcome", "Predictions").first()
    assert r["mcc"] == pytest.approx(num / den, abs=1e-12)
