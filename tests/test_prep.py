import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparkselect.operators import prep as P
from sparkselect.operators import roles as B


def test_fit_on_train_ignores_test_rows(spark):
    df = spark.range(200).select("id", (F.col("id") * 1.5).alias("x"))
    tr = df.where("id < 100")
    a = P.RobustScaler(["x"], ["xs"]).fit(tr).transform(df.where("id >= 100"))
    b = P.RobustScaler(["x"], ["xs"]).fit(tr).transform(df.where("id >= 150"))
    ja = {r["id"]: r["xs"] for r in a.collect()}
    assert all(ja[r["id"]] == r["xs"] for r in b.collect())


def test_zero_iqr_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0,)] * 10, "x double")
    out = P.RobustScaler(["x"], ["xs"]).fit(df).transform(df)
    assert {r["xs"] for r in out.collect()} == {0.0}


def test_unseen_level_all_zero(spark):
    tr = spark.createDataFrame([("a",), ("b",)], "c string")
    te = spark.createDataFrame([("z",)], "c string")
    m = Pipeline(stages=B.one_hot(["c"])).fit(tr)
    v = m.transform(te).select(vector_to_array("c__ohe").alias("v")).first()["v"]
    assert sum(v) == 0


def test_rare_levels_and_unseen(spark):
    tr = spark.createDataFrame([("a",)] * 9 + [("b",)], "c string")
    m = P.RareLevelCombiner(["c"], threshold=0.2).fit(tr)
    out = {r["c"] for r in m.transform(spark.createDataFrame([("a",), ("b",), ("new",)], "c string")).collect()}
    assert out == {"a", P.RARE}


def test_constant_and_all_null(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "k double, n double")
    assert P.low_variance_columns(df, ["k"]) == ["k"]
    out = P.SimpleImputer(["n"], strategy="mean").fit(df).transform(df)
    assert out.where("n is null").count() == 2


def test_yeo_johnson_lambda_on_grid(spark):
    df = spark.range(500).select((F.exp(F.col("id") / 100.0)).alias("x"))
    m = P.YeoJohnson(["x"]).fit(df)
    lam = m.lambdas()["x"]
    assert -2.1 <= lam <= 2.1 and abs(round(lam * 100) - lam * 100) < 1e-6


def test_generated_feature_count(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0)], "a double, b double, c double")
    g = P.FeatureGenerator(["a", "b", "c"])
    assert len(g.generated()) == 3 + 6 + 3
    assert g.transform(df).first()["a_div_c"] == 0.0


def test_iterative_imputer_categorical_and_persist(spark, tmp_path_factory):
    from pyspark.ml import Pipeline, PipelineModel
    rows = []
    for i in range(400):
        x = float(i % 40)
        c = "hi" if x >= 20 else "lo"
        rows.append((i, x, x * 2 + 1 if i % 9 else None, None if i % 7 == 0 else c))
    df = spark.createDataFrame(rows, "id long, x double, z double, c string")
    pm = Pipeline(stages=[P.IterativeImputer(["x", "z"], rounds=2, categoricalCols=["c"])]).fit(df)
    out = pm.transform(df)
    assert out.where("c is null or z is null").count() == 0
    wrong = out.where("(x >= 20 and c <> 'hi') or (x < 20 and c <> 'lo')").count()
    assert wrong == 0
    path = str(tmp_path_factory.mktemp("ii"))
    pm.write().overwrite().save(path)
    back = PipelineModel.load(path).transform(df)
    assert sorted(back.select("id", "c", "z").collect()) == sorted(out.select("id", "c", "z").collect())
