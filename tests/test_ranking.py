"""Sliced exact ranks, running totals and quantiles against single-machine answers."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkselect.functions.ranking import (average_ranks, exact_quantiles, row_number_exact, running_totals,
                                           top_k_per_group, value_counts_long)


def _skewed(spark, n=3000):
    # one group holds a third of the rows
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 7).alias("g"),
                                 (F.hash("id") % 1000).alias("v"))


def test_row_number_matches_window(spark):
    df = _skewed(spark)
    got = row_number_exact(df, [F.col("v"), F.col("id")], ["g"], slices=8)
    ref = df.withColumn("ref", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    j = got.join(ref, ["id"]).where(F.col("rn") != F.col("ref")).count()
    assert j == 0 and got.count() == df.count()


def test_row_number_repartition_invariant(spark):
    df = _skewed(spark)
    a = {r["id"]: r["rn"] for r in row_number_exact(df, [F.col("v"), F.col("id")], slices=5).collect()}
    b = {r["id"]: r["rn"] for r in row_number_exact(df.repartition(13), [F.col("v"), F.col("id")], slices=11).collect()}
    assert a == b


def test_running_totals_exclusive(spark):
    df = spark.range(100).select("id", (F.col("id") % 5).alias("x"))
    out = running_totals(df, ["id"], {"s": "x"}, inclusive=False, slices=4).orderBy("id").collect()
    xs = [r["x"] for r in out]
    assert [r["s"] for r in out] == list(np.concatenate([[0], np.cumsum(xs)[:-1]]))


@pytest.mark.parametrize("method", ["cont", "disc"])
def test_exact_quantiles(spark, method):
    vals = np.random.default_rng(1).normal(size=2001).round(2)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = {r["prob"]: r["value"] for r in exact_quantiles(df, ["x"], [0.05, 0.5, 0.95], method).collect()}
    srt = np.sort(vals)
    for p, v in got.items():
        if method == "cont":
            assert v == pytest.approx(np.quantile(vals, p), abs=1e-9)
        else:
            assert v == srt[max(int(np.ceil(len(vals) * p)) - 1, 0)]


def test_average_ranks_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "x double")
    r = {row["value"]: row["avg_rank"] for row in average_ranks(value_counts_long(df, ["x"])).collect()}
    assert r == {1.0: 1.0, 2.0: 2.5, 3.0: 4.0}


def test_top_k_per_group_salted(spark):
    df = _skewed(spark)
    got = top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 3).select("g", "id", "rank")
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc(), "id"))) \
        .where("rank <= 3").select("g", "id", "rank")
    assert sorted(got.collect()) == sorted(ref.collect())
