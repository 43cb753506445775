"""Registered queries: one per operator, each with its DuckDB twin when exact.

Every query reads the driver tables (or data Spark derives from them) in
full, so its work grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkselect.functions.metrics import classification_metrics, metric_table
from sparkselect.operators import split as S
from sparkselect.operators.models import make_estimator
from sparkselect.operators.select import select_best
from sparkselect.plans import oracle_sql as O
from sparkselect.plans.common import assemble, finish, p1
from sparkselect.plans.tasks import t1_events
from sparkselect.sources.io import table

from sparkselect.plans.registry import ORACLE, QUERIES, query  # noqa: F401


M = O.METRIC_COLS
SPLIT = f"""tr AS (SELECT * FROM t1 WHERE {O.is_train('event_id')}),
te AS (SELECT * FROM t1 WHERE NOT {O.is_train('event_id')})"""


def _t1_split(spark, sf, cols):
    df = t1_events(spark, sf)
    tr, te = S.holdout(df, "event_id")
    tr = assemble(tr, cols).withColumn("label", F.col("y").cast("double"))
    return tr, assemble(te, cols)


def _fit_predict(spark, sf, code, cols, **params):
    tr, te = _t1_split(spark, sf, cols)
    model = make_estimator(code, **params).fit(tr)
    return model.transform(te)


# ------------------------------------------------------------------ C: splits
@query("c1_sample_fraction", f"""
SELECT event_id, round(value, 6) AS value FROM events WHERE {O.is_train('event_id')}""")
def c1_sample_fraction(spark, sf):
    ev = table(spark, sf, "events")
    return finish(S.sample_fraction(ev, "event_id", 0.8).select("event_id", "value"))


@query("c1_sample_exact", f"""
SELECT event_id FROM (
  SELECT event_id, row_number() OVER (ORDER BY md5(concat('786:', CAST(event_id AS VARCHAR))), event_id) AS rn,
         count(*) OVER () AS n
  FROM events) WHERE rn <= floor(0.8 * n + 0.5)""")
def c1_sample_exact(spark, sf):
    ev = table(spark, sf, "events").select("event_id")
    return finish(S.sample_exact(ev, "event_id", 0.8))


@query("c2_holdout", f"""
SELECT event_id, CASE WHEN {O.is_train('event_id')} THEN 'train' ELSE 'test' END AS split FROM events""")
def c2_holdout(spark, sf):
    ev = table(spark, sf, "events").select("event_id")
    return finish(S.holdout_column(ev, "event_id"))


@query("c2_complement", f"""
SELECT o_orderkey FROM orders
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE {O.is_train('o_orderkey')})""")
def c2_complement(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    train = S.sample_fraction(o, "o_orderkey", 0.8)
    return finish(S.complement(o, train, "o_orderkey"))


@query("c3_tail_split", """
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM (
  SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn,
         count(*) OVER () AS n FROM orders)
WHERE rn > floor(0.8 * n + 0.5)""")
def c3_tail_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    _, tail = S.tail_split(o, ["o_orderdate", "o_orderkey"], 0.8)
    return finish(tail.select("o_orderkey", "o_totalprice"))


@query("c4_stratified_folds", f"""
WITH {O.T1}
SELECT event_id, CAST(y AS BIGINT) AS y,
       CAST((row_number() OVER (PARTITION BY y ORDER BY md5(concat('123:', CAST(event_id AS VARCHAR))), event_id) - 1) % 10 AS BIGINT) AS fold
FROM t1""")
def c4_stratified_folds(spark, sf):
    df = t1_events(spark, sf).select("event_id", "y")
    return finish(S.stratified_folds(df, "y", "event_id", 10))


# ------------------------------------------------------------------ H / J4: metrics
RULES = {
    "rule80": "value + k > 80", "rule90": "value + k > 90", "rule100": "value + k > 100",
    "value50": "value > 50", "k50": "k > 50",
}


def _rules(df):
    return df.select("event_id", "y", *[F.expr(f"CASE WHEN {r} THEN 1 ELSE 0 END").alias(m) for m, r in RULES.items()])


_RULES_SQL = ", ".join(f"CASE WHEN {r} THEN 1 ELSE 0 END AS {m}" for m, r in RULES.items())
_LONG_SQL = " UNION ALL ".join(f"SELECT '{m}' AS model, y, {m} AS yhat FROM rl" for m in RULES)


@query("j4_evaluate_predictions", f"""
WITH {O.T1}, src AS (SELECT 'all' AS model, y, CASE WHEN value + k > 90 THEN 1 ELSE 0 END AS yhat FROM t1),
{O.metrics_from('src')}
SELECT n, {O.rounded(M)} FROM met""")
def j4_evaluate_predictions(spark, sf):
    df = t1_events(spark, sf).withColumn("yhat", F.expr("CASE WHEN value + k > 90 THEN 1 ELSE 0 END"))
    return finish(classification_metrics(df, "y", "yhat"))


@query("h8_metric_table", f"""
WITH {O.T1}, rl AS (SELECT y, {_RULES_SQL} FROM t1), src AS ({_LONG_SQL}),
{O.metrics_from('src')}
SELECT model, n, {O.rounded(M)} FROM met""")
def h8_metric_table(spark, sf):
    df = _rules(t1_events(spark, sf))
    return finish(metric_table(df, "y", {m: m for m in RULES}))


@query("h9_multiclass_metrics", f"""
WITH src AS (SELECT 'all' AS model, label AS y, CAST(vec_id % 10 AS INTEGER) AS yhat FROM embeddings),
{O.metrics_from('src')}
SELECT n, {O.rounded(M)} FROM met""")
def h9_multiclass_metrics(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("y"), (F.col("vec_id") % 10).alias("yhat"))
    return finish(classification_metrics(e, "y", "yhat"))


@query("g13_select_best", f"""
WITH {O.T1}, rl AS (SELECT y, {_RULES_SQL} FROM t1), src AS ({_LONG_SQL}),
{O.metrics_from('src')},
ranked AS (SELECT model, f1, row_number() OVER (ORDER BY f1 DESC NULLS LAST,
             CASE model {' '.join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(RULES))} END) AS r FROM met)
SELECT model, round(f1, 6) AS f1 FROM ranked WHERE r = 1""")
def g13_select_best(spark, sf):
    df = _rules(t1_events(spark, sf))
    table_ = metric_table(df, "y", {m: m for m in RULES})
    return finish(select_best(table_, "F1", order=list(RULES)).select("model", "f1"))


# ------------------------------------------------------------------ F: closed-form models on T1
NB_SQL = f"""
WITH {O.T1}, {SPLIT},
cls AS (SELECT y, count(*) AS n, avg(value) AS mv, var_pop(value) AS vv, avg(k) AS mk, var_pop(k) AS vk,
               avg(h) AS mh, var_pop(h) AS vh FROM tr GROUP BY y),
g AS (SELECT count(*) AS nt, 1e-9 * greatest(var_pop(value), var_pop(k), var_pop(h)) AS e FROM tr),
ll AS (SELECT te.event_id, cls.y,
              ln(cls.n / g.nt)
              - 0.5 * ln(2 * pi() * (vv + e)) - (te.value - mv) ^ 2 / (2 * (vv + e))
              - 0.5 * ln(2 * pi() * (vk + e)) - (te.k - mk) ^ 2 / (2 * (vk + e))
              - 0.5 * ln(2 * pi() * (vh + e)) - (te.h - mh) ^ 2 / (2 * (vh + e)) AS s
       FROM te, cls, g),
nb AS (SELECT event_id, y AS prediction,
              row_number() OVER (PARTITION BY event_id ORDER BY s DESC, y) AS r FROM ll)"""


@query("f3_naive_bayes", NB_SQL + """
SELECT event_id, CAST(prediction AS BIGINT) AS prediction FROM nb WHERE r = 1""")
def f3_naive_bayes(spark, sf):
    out = _fit_predict(spark, sf, "nb", ["value", "k", "h"])
    return finish(out.select("event_id", F.col("prediction").cast("bigint")))


DUMMY_SQL = f"""
WITH {O.T1}, {SPLIT},
pri AS (SELECT y, count(*) / sum(count(*)) OVER () AS pr FROM tr GROUP BY y),
top AS (SELECT y FROM pri ORDER BY pr DESC, y LIMIT 1)"""


@query("f12_dummy", DUMMY_SQL + """
SELECT te.event_id, CAST(top.y AS BIGINT) AS prediction, round((SELECT pr FROM pri WHERE y = 1), 6) AS p1
FROM te, top""")
def f12_dummy(spark, sf):
    out = _fit_predict(spark, sf, "dummy", ["value", "k"])
    return finish(out.select("event_id", F.col("prediction").cast("bigint"), p1().alias("p1")))


LDA_SQL = f"""
WITH {O.T1}, {SPLIT},
cls AS (SELECT y, count(*) AS n, avg(value) AS m1, avg(k) AS m2 FROM tr GROUP BY y),
tot AS (SELECT count(*) AS nt FROM tr),
sc AS (SELECT sum((value - m1) * (value - m1)) AS s11, sum((value - m1) * (k - m2)) AS s12,
              sum((k - m2) * (k - m2)) AS s22 FROM tr JOIN cls USING (y)),
cv AS (SELECT s11 / (nt - 2) AS c11, s12 / (nt - 2) AS c12, s22 / (nt - 2) AS c22 FROM sc, tot),
iv AS (SELECT c22 / (c11 * c22 - c12 * c12) AS i11, -c12 / (c11 * c22 - c12 * c12) AS i12,
              c11 / (c11 * c22 - c12 * c12) AS i22 FROM cv),
co AS (SELECT y, i11 * m1 + i12 * m2 AS a1, i12 * m1 + i22 * m2 AS a2, m1, m2, n FROM cls, iv),
cf AS (SELECT y, a1, a2, -0.5 * (a1 * m1 + a2 * m2) + ln(n / nt) AS b FROM co, tot),
sc2 AS (SELECT te.event_id, cf.y, te.value * a1 + te.k * a2 + b AS s FROM te, cf),
lda AS (SELECT event_id, y AS prediction, row_number() OVER (PARTITION BY event_id ORDER BY s DESC, y) AS r FROM sc2)"""


@query("f2_lda", LDA_SQL + """
SELECT event_id, CAST(prediction AS BIGINT) AS prediction FROM lda WHERE r = 1""")
def f2_lda(spark, sf):
    out = _fit_predict(spark, sf, "lda", ["value", "k"])
    return finish(out.select("event_id", F.col("prediction").cast("bigint")))


QDA_SQL = f"""
WITH {O.T1}, {SPLIT},
tot AS (SELECT count(*) AS nt FROM tr),
cls AS (SELECT y, count(*) AS n, avg(value) AS m1, avg(k) AS m2, var_samp(value) AS c11,
               covar_samp(value, k) AS c12, var_samp(k) AS c22 FROM tr GROUP BY y),
cf AS (SELECT y, m1, m2, c22 / (c11 * c22 - c12 * c12) AS i11, -c12 / (c11 * c22 - c12 * c12) AS i12,
              c11 / (c11 * c22 - c12 * c12) AS i22,
              -0.5 * ln(c11 * c22 - c12 * c12) + ln(n / nt) AS b FROM cls, tot),
sc2 AS (SELECT te.event_id, cf.y,
               b - 0.5 * ((te.value - m1) * (te.value - m1) * i11 + 2 * (te.value - m1) * (te.k - m2) * i12
                          + (te.k - m2) * (te.k - m2) * i22) AS s FROM te, cf),
qda AS (SELECT event_id, y AS prediction, row_number() OVER (PARTITION BY event_id ORDER BY s DESC, y) AS r FROM sc2)"""


@query("f5_qda", QDA_SQL + """
SELECT event_id, CAST(prediction AS BIGINT) AS prediction FROM qda WHERE r = 1""")
def f5_qda(spark, sf):
    out = _fit_predict(spark, sf, "qda", ["value", "k"])
    return finish(out.select("event_id", F.col("prediction").cast("bigint")))


RIDGE_SQL = f"""
WITH {O.T1}, {SPLIT},
mu AS (SELECT avg(value) AS m1, avg(k) AS m2, avg(2.0 * y - 1) AS mt FROM tr),
ss AS (SELECT sum((value - m1) * (value - m1)) AS s11, sum((value - m1) * (k - m2)) AS s12,
              sum((k - m2) * (k - m2)) AS s22, sum((value - m1) * (2.0 * y - 1 - mt)) AS s1t,
              sum((k - m2) * (2.0 * y - 1 - mt)) AS s2t FROM tr, mu),
be AS (SELECT ((s22 + 1) * s1t - s12 * s2t) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS b1,
              ((s11 + 1) * s2t - s12 * s1t) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS b2 FROM ss),
ridge AS (SELECT te.event_id, CASE WHEN te.value * b1 + te.k * b2 + (mt - b1 * m1 - b2 * m2) > 0 THEN 1 ELSE 0 END AS prediction
          FROM te, be, mu)"""


@query("f14_ridge", RIDGE_SQL + """
SELECT event_id, CAST(prediction AS BIGINT) AS prediction FROM ridge""")
def f14_ridge(spark, sf):
    out = _fit_predict(spark, sf, "ridge", ["value", "k"])
    return finish(out.select("event_id", F.col("prediction").cast("bigint")))


# ------------------------------------------------------------------ flagship
FLAG_MODELS = {"nb": (["value", "k", "h"], NB_SQL + " SELECT event_id, prediction FROM nb WHERE r = 1"),
               "lda": (["value", "k"], LDA_SQL + " SELECT event_id, prediction FROM lda WHERE r = 1"),
               "qda": (["value", "k"], QDA_SQL + " SELECT event_id, prediction FROM qda WHERE r = 1"),
               "ridge": (["value", "k"], RIDGE_SQL + " SELECT event_id, prediction FROM ridge"),
               "dummy": (["value", "k"], DUMMY_SQL + " SELECT te.event_id, top.y AS prediction FROM te, top")}
_FLAG_UNION = " UNION ALL ".join(f"SELECT '{m}' AS model, event_id, prediction FROM ({sql}) AS p_{m}"
                                 for m, (_, sql) in FLAG_MODELS.items())


@query("t1_model_selection", f"""
WITH {O.T1}, preds AS ({_FLAG_UNION}),
src AS (SELECT p.model, t1.y, p.prediction AS yhat FROM preds p JOIN t1 USING (event_id)),
{O.metrics_from('src')},
ranked AS (SELECT *, row_number() OVER (ORDER BY accuracy DESC NULLS LAST,
             CASE model {' '.join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(FLAG_MODELS))} END) AS r FROM met)
SELECT model, n, {O.rounded(M)}, CAST(CASE WHEN r = 1 THEN 1 ELSE 0 END AS BIGINT) AS selected FROM ranked""")
def t1_model_selection(spark, sf):
    """Flagship: hash split of T1, five closed-form models fitted
    on train, test rows scored, one-pass metric table, winner by accuracy."""
    from sparkselect.operators.estimators import shared_moments
    df = t1_events(spark, sf)
    tr, te = S.holdout(df, "event_id")
    tr = tr.withColumn("label", F.col("y").cast("double"))
    scored = te.select("event_id", "value", "k", "h", "y")
    with shared_moments():  # LDA, QDA and ridge share one pass of class moments
        for code, (cols, _) in FLAG_MODELS.items():
            model = make_estimator(code).fit(assemble(tr, cols))
            scored = model.transform(assemble(scored, cols)) \
                .withColumn(f"p_{code}", F.col("prediction")).drop("prediction", "probability", "rawPrediction", "features")
    table_ = metric_table(scored, "y", {m: f"p_{m}" for m in FLAG_MODELS})
    ranked = select_best_flag(table_, "Accuracy", list(FLAG_MODELS))
    return finish(ranked)


def select_best_flag(table_, metric, order):
    from sparkselect.operators.select import rank_models
    r = rank_models(table_, metric, order)
    return r.withColumn("selected", (F.col("rank") == 1).cast("bigint")).drop("rank")
