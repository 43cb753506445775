"""No cap or switch drops data; folds don't leak; readers match columns by name."""

import itertools

import numpy as np
import pytest
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from sparkselect.functions.pairs import pair_correlations
from sparkselect.functions.ranking import row_number_exact
from sparkselect.operators import diagnose as D
from sparkselect.operators import prep as P
from sparkselect.operators import select as G
from sparkselect.operators.models import make_estimator
from sparkselect.operators.neighbors import apply_smote, knn_candidates, smote
from sparkselect.operators.profile import kendall_tau_b, profile, profile_extremes, profile_numeric
from sparkselect.operators.roles import Roles
from sparkselect.operators.split import stratified_folds
from sparkselect.plans.auto import AutoConfig, AutoPrep, training_rows
from sparkselect.sources.io import read_validation, write_table


def test_knn_keeps_all_ties(spark):
    va = VectorAssembler(inputCols=["a"], outputCol="x")
    base = va.transform(spark.range(400).select((F.col("id") * 7919 % 400).alias("k"), F.lit(1.0).alias("a")))
    query = va.transform(spark.createDataFrame([(0, 0.0)], "q int, a double"))
    got = knn_candidates(query, base, 5, "q", "k", "x", "x").orderBy("nb_rank").collect()
    assert [r["k"] for r in got] == [0, 1, 2, 3, 4]


def test_smote_raises_every_smaller_class(spark):
    rows = [(i, float(i % 7), float(i % 5), "abc"[0 if i < 60 else 1 if i < 70 else 2]) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, x double, y double, label string")
    out = apply_smote(df, "label", "k", ["x", "y"])
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {"a": 60, "b": 60, "c": 60}
    assert smote(df.where("label = 'a'"), "label", "k", ["x", "y"]).count() == 0


def test_generated_features_are_all_there():
    cols = [f"c{i}" for i in range(30)]
    assert len(P.FeatureGenerator(cols).generated()) == 30 * 29 // 2 + 30 * 29 + 30


def test_kendall_of_many_levels(spark):
    rnd = np.random.default_rng(1)
    a = rnd.permutation(300)
    b = (a // 3 + rnd.integers(0, 40, 300)) % 97
    up = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") * F.col("id")).alias("b"))
    assert kendall_tau_b(up, "a", "b").first()["tau_b"] == pytest.approx(1.0)
    c = d = 0
    ties = sum(1 for x, y in itertools.combinations(b, 2) if x == y)
    for i, j in itertools.combinations(range(300), 2):
        s = np.sign(a[i] - a[j]) * np.sign(int(b[i]) - int(b[j]))
        c, d = c + (s > 0), d + (s < 0)
    n0 = 300 * 299 / 2
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)] + [(None, 3), (4, None)], "a long, b long")
    assert kendall_tau_b(df, "a", "b").first()["tau_b"] == pytest.approx((c - d) / np.sqrt(n0 * (n0 - ties)))


def test_big_integers_stay_apart(spark):
    df = spark.range(10).select((F.col("id") + 2 ** 53).alias("v"))
    assert profile_numeric(df, with_mad=False).first()["distinct"] == 10
    low = profile_extremes(df, n=4).where("side = 'min'").orderBy("rank").collect()
    assert [int(r["value"]) + r["rest"] for r in low] == [2 ** 53 + i for i in range(4)]


def test_nulls_raise_instead_of_vanishing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (3.0, 5.0), (2.0, 2.5)], "a double, b double")
    with pytest.raises(Exception):  # noqa: B017
        P.remove_outliers(df, ["a", "b"]).count()


def test_importances_carry_slot_names(spark):
    df = spark.createDataFrame([(float(i % 2), "uv"[i % 2], float(i * 7 % 5)) for i in range(80)], "label double, g string, n1 double")
    prep = Pipeline(stages=[StringIndexer(inputCol="g", outputCol="gi"), OneHotEncoder(inputCol="gi", outputCol="go"),
                            VectorAssembler(inputCols=["n1", "go"], outputCol="features")]).fit(df).transform(df)
    names = D.vector_names(prep)
    table = D.feature_importance(make_estimator("dt").fit(prep), names).collect()
    assert len(table) == len(names) == 2 and table[0]["feature"] == "go_u" and table[0]["importance"] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="one name per slot"):
        D.feature_importance(make_estimator("dt").fit(prep), ["n1"])


def test_leaderboard_of_three_classes(spark):
    rows = [(i, float(i % 3), float(i % 3 + (i % 5) / 10), float(i % 7)) for i in range(120)]
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(spark.createDataFrame(rows, "k long, label double, x double, y double"))
    top, board, notes = G.compare_models({c: make_estimator(c) for c in ("lda", "dummy")}, stratified_folds(df, "label", "k", 4), "Accuracy", 1)
    assert top == ["lda"] and not notes and board.count() == 2


def test_session_best_breaks_ties_by_name(spark):
    board = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None)], "model string, accuracy double")
    assert tuple(G.best_of_session(board, "Accuracy").first()) == ("a", 0.5)


def test_one_failing_setting_does_not_end_tuning(spark):
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame([(i, float(i % 2), float(i % 2 + i % 3)) for i in range(60)], "k long, label double, x double"))
    old = G.GRIDS["ridge"]
    G.GRIDS["ridge"] = {"alpha": [1.0, -1e308, 0.1]}
    try:
        _, table, _ = G.tune(make_estimator("ridge"), "ridge", stratified_folds(df, "label", "k", 3), "Accuracy")
    finally:
        G.GRIDS["ridge"] = old
    assert table.count() == 4


def test_validation_csv_by_column_name(spark, tmp_path):
    train = spark.createDataFrame([(1, 2.5, "x", 0)], "a int, b double, c string, y int")
    write_table(spark.createDataFrame([("z", 10.5, 1)], "c string, b double, a int"), str(tmp_path / "v"))
    got = read_validation(spark, str(tmp_path / "v"), train, fmt="csv")
    assert got.columns == ["a", "b", "c"] and tuple(got.first()) == (1, 10.5, "z")


def test_imputer_with_a_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (None, None, None), (3.0, None, "a")], "x double, z double, g string")
    out = P.IterativeImputer(["x", "z"], rounds=2, categoricalCols=["g"]).fit(df).transform(df).collect()
    assert all(r["x"] is not None and r["z"] == 0.0 and r["g"] == "a" for r in out)


def test_pair_correlations(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(200, 6))
    x[:, 3] = 5.0
    x[:, 4] = 2 * x[:, 0] + 1e6
    rows = [[None if rnd.random() < 0.1 else float(v) for v in r] for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(6)))
    r = pair_correlations(df, df.columns)
    for i, j in itertools.combinations(range(6), 2):
        both = [(a[i], a[j]) for a in rows if a[i] is not None and a[j] is not None]
        if 3 in (i, j):
            assert np.isnan(r[i, j])
        else:
            assert r[i, j] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-9)


def test_profile_has_every_section(spark):
    df = spark.range(30).select("id", (F.col("id") % 5).alias("v"), F.concat(F.lit("t "), F.col("id") % 3).alias("t"),
                                F.concat(F.lit("u"), F.col("id") % 2).alias("u"), F.expr("date_add(date'2024-01-01', cast(id as int))").alias("d"))
    out = profile(df, "id", interactions=[("id", "v")])
    assert {"missing_pairs", "duplicates", "kendall", "text", "datetime_d", "datetime_months_d", "interactions_id_v", "sample", "cramers_v"} <= set(out)


def test_numbers_of_tied_rows_are_stable(spark):
    df = spark.range(200).select((F.col("id") % 4).alias("g"), F.col("id"))
    a = {r["id"]: r["rn"] for r in row_number_exact(df, ["g"]).collect()}
    b = {r["id"]: r["rn"] for r in row_number_exact(df.repartition(7), ["g"], slices=5).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 201))


def test_held_rows_do_not_touch_the_fold_fits(spark):
    rows = [(i, float(i % 9), float(i * 13 % 17), "pqr"[i % 3], "no" if i % 5 else "yes") for i in range(150)]
    df = spark.createDataFrame(rows, "k long, a double, b double, g string, y string")
    cfg = AutoConfig(roles=Roles(target="y", numeric=["a", "b"], categorical=["g"]), folds=3)
    cfg.flags.update(create_clusters=False, feature_selection=False, feature_ratio=False, polynomial_features=False, feature_interaction=False)
    lab = StringIndexer(inputCol="y", outputCol="label", stringOrderType="alphabetAsc").fit(df).transform(df)
    folded = stratified_folds(lab, "label", "k", 3)

    def first(frame):
        frames = G.fold_frames(frame, "fold", prep=AutoPrep(cfg), cache=False, train_rows=lambda p, r: training_rows(r, cfg, p.numeric_out, "k"))
        f, train, held = frames[0]
        return f, sorted(map(str, train.select("k", "features", "label").collect())), {r["k"] for r in held.collect()}

    f, train, held = first(folded)
    assert held == {r["k"] for r in folded.where(F.col("fold") == f).collect()}, "held rows are the fold's own, none synthetic"
    moved = folded.withColumn("a", F.when(F.col("fold") == f, F.col("a") * 1000).otherwise(F.col("a")))
    assert first(moved)[1] == train


def test_kendall_in_slices_and_stripes(spark, monkeypatch):
    from sparkselect.operators import profile as operators
    rnd = np.random.default_rng(5)
    rows = [(int(x) if x < 9 else None, int(y), float(z)) for x, y, z in zip(rnd.integers(0, 10, 200), rnd.integers(0, 200, 200), rnd.normal(size=200))]
    rows += rows[:30] + [(3, 1, 0.5)] * 40
    df = spark.createDataFrame(rows, "a int, b int, c double")
    want = {}
    for i, j in itertools.combinations(range(3), 2):
        own = [(r[i], r[j]) for r in rows if r[i] is not None]
        signs = [(np.sign(p[0] - q[0]), np.sign(p[1] - q[1])) for p, q in itertools.combinations(own, 2)]
        x, y = np.array(signs).T
        want["abc"[i], "abc"[j]] = (x * y).sum() / np.sqrt((x != 0).sum() * (y != 0).sum())
    for cells in (7, 60, 100_000):
        monkeypatch.setattr(operators, "KENDALL_CELLS", cells)
        got = {(r["column_a"], r["column_b"]): r["tau_b"] for r in operators.profile_kendall(df, ["a", "b", "c"]).collect()}
        assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_failures_are_told_from_results(spark, monkeypatch):
    """a failing setting carries its error, and nothing is returned if the original itself fails."""
    from sparkselect.operators import models
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame([(i, float(i % 2), float(i % 2 + i % 3)) for i in range(60)], "k long, label double, x double"))
    folded = stratified_folds(df, "label", "k", 3)
    fit = models.RidgeClassifier._fit

    def failing(self, rows):
        if self.getOrDefault(self.alpha) == 10.0:
            raise ValueError("no such strength")
        return fit(self, rows)

    monkeypatch.setattr(models.RidgeClassifier, "_fit", failing)
    _, table, note = G.tune(make_estimator("ridge"), "ridge", folded, "Accuracy")
    errors = {r["setting"]: r["error"] for r in table.collect()}
    assert len(errors) == 6 and [s for s, e in errors.items() if e] == ["{'alpha': 10.0}"] and "no such strength" in errors["{'alpha': 10.0}"] and "10.0" in note
    with pytest.raises(ValueError, match="no such strength"):
        G.tune(make_estimator("ridge", alpha=10.0), "ridge", folded, "Accuracy")


def test_the_whole_menu_is_compared_and_failures_are_listed(spark, monkeypatch):
    """every model of the menu is a row of the leaderboard, also one that fails."""
    from sparkselect.operators import models
    from sparkselect.plans import catalog_models
    asked, compare = [], G.compare_models

    def few(cands, *a, **kw):
        asked.extend(cands)
        return compare({c: cands[c] for c in ("nb", "dummy", "lda")}, *a, **kw)

    monkeypatch.setattr(G, "compare_models", few)
    monkeypatch.setattr(models.LDAClassifier, "_fit", lambda *_: 1 / 0)
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), i % 24, int(i % 7 > 2)) for i in range(300)], "event_id long, value double, k double, h int, y int")
    monkeypatch.setattr(catalog_models, "t1_events", lambda *_: df)
    rows = {r["model"]: r for r in catalog_models.g2_g3_compare_models(spark, "").collect()}
    assert sorted(asked) == sorted(models.CODES) and set(rows) == {"nb", "dummy", "lda"}
    assert rows["lda"]["accuracy"] is None and "ZeroDivisionError" in rows["lda"]["error"] and rows["nb"]["error"] is None
