import tempfile

from pyspark.sql import functions as F

from sparkselect.operators.models import make_estimator
from sparkselect.operators.profile import profile
from sparkselect.operators.roles import Roles
from sparkselect.sources import io
from tests.conftest import SF


def test_csv_round_trip(spark):
    d = tempfile.mkdtemp(prefix="sparkselect-io-", dir="/tmp")
    o = io.table(spark, SF, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    io.write_table(o, f"{d}/orders_csv")
    back = io.read_table(spark, f"{d}/orders_csv", fmt="csv")
    assert sorted(back.collect()) == sorted(o.collect())
    val = io.read_validation(spark, f"{d}/orders_csv", o, fmt="csv")
    assert val.schema == o.schema


def test_profile_tables_written(spark):
    d = tempfile.mkdtemp(prefix="sparkselect-prof-", dir="/tmp")
    p = profile(io.table(spark, SF, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand"), key="p_partkey")
    paths = io.write_profile(p, d)
    assert len(paths) == len(p) and spark.read.parquet(paths[0]).count() >= 1


def test_publish_versions(spark, t1):
    from pyspark.ml import Pipeline
    d = tempfile.mkdtemp(prefix="sparkselect-pub-", dir="/tmp")
    m = Pipeline(stages=[make_estimator("nb")]).fit(t1)
    io.publish_model(spark, m, d, "nb", "accuracy", 0.8)
    io.publish_model(spark, m, d, "nb", "accuracy", 0.81)
    man = spark.read.parquet(f"{d}/_manifest").orderBy("version").collect()
    assert [r["version"] for r in man] == [1, 2]
    scored = io.load_and_score(man[-1]["path"], t1)
    assert scored.count() == t1.count()


def test_auto_run_small(spark):
    from sparkselect.plans.auto import AutoConfig, run
    from sparkselect.plans.tasks import t1_events
    df = t1_events(spark, SF).withColumn("y", F.col("y").cast("string"))
    cfg = AutoConfig(roles=Roles(target="y", numeric=["value", "k", "h"], categorical=["event_type"]),
                     models=["nb", "dummy", "lda"], folds=3, n_select=2, tune_iter=1, ensemble_n=2,
                     sensitive=["event_type"],
                     flags={"imputation": "simple", "normalize": True, "transformation": False,
                            "combine_rare_levels": True, "rare_level_threshold": 0.1})
    d = tempfile.mkdtemp(prefix="sparkselect-auto-", dir="/tmp")
    out = run(df, df.drop("y"), cfg, key="event_id", save_path=f"{d}/model")
    assert out["selected"] in {"Best", "Blend", "Stack", "Bagged", "Boost"}
    assert out["metric_table"].count() == 5
    assert out["validation_scored"].count() == df.count()
    assert out["fairness"].count() == 5
    assert out["notes"]["session_best"] and {"threshold", "dimension", "dimension_variance"} <= set(out)
    scored = io.load_and_score(out["saved"], df.drop("y"))
    assert scored.count() == df.count() and "prediction_label" in scored.columns
