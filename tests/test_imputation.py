import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sparkselect.functions import patterns
from sparkselect.functions.patterns import pattern_moments
from sparkselect.operators import chained
from sparkselect.operators import prep as P

COLS = ["a", "b", "c", "d"]


def _rows(n=600, seed=7, share=0.2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) + [1000.0, -5.0, 0.0, 3.0]
    gone = rng.random((n, 4)) < share
    gone[:, 3] = False
    return np.where(gone, np.nan, x)


def _frame(spark, x, parts=5):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in COLS)).repartition(parts, "id")


def _row_loop(x, rounds):
    """Chained equations over the rows themselves."""
    gone = np.isnan(x)
    out = np.where(gone, np.nanmean(x, axis=0), x)
    order = sorted([c for c in range(x.shape[1]) if gone[:, c].any()], key=lambda c: (gone[:, c].sum(), c))
    for _ in range(rounds):
        for c in order:
            rest = np.delete(out, c, axis=1)
            design = np.hstack((np.ones((len(x), 1)), rest))
            w = np.linalg.lstsq(design[~gone[:, c]], x[~gone[:, c], c], rcond=None)[0]
            out[gone[:, c], c] = design[gone[:, c]] @ w
    return out


def _filled(df, **kw):
    out = P.IterativeImputer(COLS, **kw).fit(df).transform(df).orderBy("id").collect()
    return np.array([[r[c] for c in COLS] for r in out])


def test_sweeps_equal_the_loop_over_rows(spark):
    x = _rows()
    assert np.allclose(_filled(_frame(spark, x), rounds=4), _row_loop(x, 4), rtol=1e-8, atol=1e-8)


def test_batches_equal_expressions(spark, monkeypatch):
    x = _rows(200)
    df = _frame(spark, x).withColumn("g", F.when(F.col("id") % 6 != 0, F.when(F.col("d") > 3, "hi").otherwise("lo")))
    model = P.IterativeImputer(COLS, rounds=3, categoricalCols=["g"]).fit(df)
    plain = model.transform(df).orderBy("id").collect()
    monkeypatch.setattr(P, "MAX_STEP_EXPRESSIONS", 2)
    batched = model.transform(df).orderBy("id").select(plain[0].__fields__).collect()
    assert [r["g"] for r in plain] == [r["g"] for r in batched]
    assert np.allclose([[r[c] for c in COLS] for r in plain], [[r[c] for c in COLS] for r in batched], rtol=1e-10)


def test_too_many_patterns_read_the_rows(spark, monkeypatch):
    x = _rows(300)
    df = _frame(spark, x)
    assert pattern_moments(df, COLS, 3 * 25) is None
    monkeypatch.setattr(P, "pattern_moments", lambda df, cols: None)
    assert np.allclose(_filled(df, rounds=2), _row_loop(x, 2), rtol=1e-6, atol=1e-6)


def test_one_pass_over_the_table(spark):
    """Whatever the rounds, a row is read once, beside the head that gives the shift."""
    read = spark.sparkContext.accumulator(0)

    def seen(v):
        read.add(1)
        return v

    n = 2000
    x = _rows(n)
    df = _frame(spark, x, 8).cache()
    df.count()
    counted = df.withColumn("a", F.udf(seen, DoubleType()).asNondeterministic()("a"))
    P.IterativeImputer(COLS, rounds=25).fit(counted)
    head = max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    assert n <= read.value <= n + head


def test_moments_are_sums_over_the_rows(spark, monkeypatch):
    monkeypatch.setattr(patterns, "_CHUNK", 64)
    x = _rows(500)
    missing, moments, shift = pattern_moments(_frame(spark, x), COLS)
    assert len({m.tobytes() for m in missing}) == len(missing) == 8
    for gone, m in zip(missing, moments):
        here = x[(np.isnan(x) == gone).all(axis=1)]
        z = np.hstack((np.ones((len(here), 1)), np.where(gone, 0.0, here - shift)))
        assert np.allclose(m, z.T @ z)


def test_collinear_constant_and_empty_columns(spark):
    x = _rows(300)
    x[:, 1] = np.where(np.isnan(x[:, 1]), np.nan, 4.0)
    x[:, 2] = np.nan
    x[:, 3] = np.where(np.isnan(x[:, 0]), 7.0, x[:, 0] * 2 + 1)
    out = _filled(_frame(spark, x), rounds=2)
    assert np.allclose(out[:, 1], 4.0) and (out[:, 2] == 0).all()
    assert np.allclose(out[np.isnan(x[:, 0]), 0], 3.0)


def test_nan_is_missing_and_an_empty_table_fits(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i if i % 3 else float("nan")) for i in range(30)], "x double, z double")
    out = P.IterativeImputer(["x", "z"], rounds=2).fit(df).transform(df).collect()
    assert all(abs(r["z"] - 2 * r["x"]) < 1e-9 for r in out)
    none = df.limit(0).withColumn("g", F.lit("a"))
    model = P.IterativeImputer(["x", "z"], categoricalCols=["g"]).fit(none)
    got = model.transform(spark.createDataFrame([(None, 1.0, None)], "x double, z double, g string")).first()
    assert (got["x"], got["z"], got["g"]) == (0.0, 1.0, "missing")


def test_infinite_values_raise(spark):
    df = spark.createDataFrame([(1.0, float("inf")), (2.0, 3.0)], "x double, z double")
    with pytest.raises(ValueError, match="infinite"):
        P.IterativeImputer(["x", "z"]).fit(df)


def test_a_map_holds_the_whole_chain():
    steps = [(0, [1], np.array([2.0]), 1.0), (1, [0], np.array([0.5]), 0.0), (0, [1], np.array([4.0]), -1.0)]
    t = chained.pattern_map(np.array([True, True]), np.array([3.0, 5.0]), steps)
    # 5 -> a = 11, b = 5.5, a = 21
    assert t[:, 0].tolist() == [21.0, 5.5] and not t[:, 1:].any()
