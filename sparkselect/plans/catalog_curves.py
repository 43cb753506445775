"""Registered diagnostics and fairness queries.

The score is a fixed function of T1 columns, floor(value + k) / 600, so the
curves are exact in both engines and have many tied scores.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkselect.operators import diagnose as D
from sparkselect.operators.fairness import fairness, fairness_gap, score_validation
from sparkselect.operators.models import make_estimator
from sparkselect.operators import split as S
from sparkselect.plans import oracle_sql as O
from sparkselect.plans.catalog import NB_SQL, SPLIT
from sparkselect.plans.common import assemble, finish
from sparkselect.plans.registry import query
from sparkselect.plans.tasks import t1_events
from sparkselect.streaming.score import run_to_table, running_metrics, score_stream, table_stream

M = O.METRIC_COLS
SCORED = f"""{O.T1}, s AS (SELECT event_id, event_type, y, floor(value + k) / 600.0 AS score,
   CASE WHEN floor(value + k) / 600.0 >= 0.15 THEN 1 ELSE 0 END AS yhat FROM t1)"""
CUM = """sc AS (SELECT score, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM s GROUP BY score),
c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sc)"""


def scored_t1(spark, sf):
    t = t1_events(spark, sf)
    sc = F.floor(F.col("value") + F.col("k")) / F.lit(600.0)
    return t.select("event_id", "event_type", "y", sc.alias("score"),
                    F.when(sc >= 0.15, 1).otherwise(0).alias("yhat"))


@query("i2_roc", f"""WITH {SCORED}, {CUM}
SELECT round(score, 6) AS threshold, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr FROM c""")
def i2_roc(spark, sf):
    return finish(D.roc_table(scored_t1(spark, sf), "y", "score"))


@query("h2b_auc_score", f"""WITH {SCORED},
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
SELECT round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0)
             / (sum(y) * sum(1 - y)), 6) AS auc FROM r""")
def h2b_auc_score(spark, sf):
    return finish(D.auc_score(scored_t1(spark, sf), "y", "score"))


@query("h2b_auc_by_type", f"""WITH {SCORED},
r AS (SELECT event_type, y, rank() OVER (PARTITION BY event_type ORDER BY score)
             + (count(*) OVER (PARTITION BY event_type, score) - 1) / 2.0 AS rk FROM s)
SELECT event_type, round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0)
             / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY event_type""")
def h2b_auc_by_type(spark, sf):
    return finish(D.auc_score(scored_t1(spark, sf), "y", "score", by=["event_type"]))


@query("i3_confusion_matrix", f"""WITH {SCORED},
l AS (SELECT DISTINCT CAST(y AS DOUBLE) AS v FROM s UNION SELECT DISTINCT CAST(yhat AS DOUBLE) FROM s),
cc AS (SELECT CAST(y AS DOUBLE) AS a, CAST(yhat AS DOUBLE) AS p, count(*) AS cnt FROM s GROUP BY ALL)
SELECT a1.v AS actual, a2.v AS predicted, CAST(coalesce(cc.cnt, 0) AS BIGINT) AS count,
       round(coalesce(cc.cnt, 0) / (SELECT count(*) FROM s), 6) AS share
FROM l a1 CROSS JOIN l a2 LEFT JOIN cc ON cc.a = a1.v AND cc.p = a2.v""")
def i3_confusion_matrix(spark, sf):
    return finish(D.confusion_table(scored_t1(spark, sf), "y", "yhat"))


@query("i4_threshold", f"""WITH {SCORED},
g AS (SELECT i, CAST(sum(CASE WHEN score >= CAST(i AS DOUBLE) / 100 THEN y ELSE 0 END) AS DOUBLE) AS tp,
             CAST(sum(CASE WHEN score >= CAST(i AS DOUBLE) / 100 THEN 1 ELSE 0 END) AS DOUBLE) AS pp
      FROM range(0, 101) t(i), s GROUP BY i),
tot AS (SELECT CAST(sum(y) AS DOUBLE) AS P, CAST(count(*) AS DOUBLE) AS n FROM s)
SELECT round(CAST(i AS DOUBLE) / 100, 6) AS threshold,
       round(CASE WHEN pp > 0 THEN tp / pp ELSE 0 END, 6) AS precision,
       round(CASE WHEN P > 0 THEN tp / P ELSE 0 END, 6) AS recall,
       round(CASE WHEN pp + P > 0 THEN 2 * tp / (pp + P) ELSE 0 END, 6) AS f1,
       round(pp / n, 6) AS queue_rate FROM g, tot""")
def i4_threshold(spark, sf):
    return finish(D.threshold_table(scored_t1(spark, sf), "y", "score", steps=100))


@query("i5_precision_recall", f"""WITH {SCORED}, {CUM},
ap AS (SELECT sum(pos / P * tp / (tp + fp)) AS average_precision FROM c)
SELECT round(score, 6) AS threshold, round(tp / P, 6) AS recall, round(tp / (tp + fp), 6) AS precision,
       round(average_precision, 6) AS average_precision FROM c, ap""")
def i5_precision_recall(spark, sf):
    return finish(D.pr_table(scored_t1(spark, sf), "y", "score"))


@query("i6_error", f"""WITH {SCORED}
SELECT CAST(yhat AS DOUBLE) AS predicted, CAST(y AS DOUBLE) AS actual, CAST(count(*) AS BIGINT) AS count
FROM s GROUP BY ALL""")
def i6_error(spark, sf):
    return finish(D.error_table(scored_t1(spark, sf), "y", "yhat"))


@query("i7_class_report", """
WITH cc AS (SELECT CAST(label AS DOUBLE) AS a, CAST(vec_id % 10 AS DOUBLE) AS p, count(*) AS cnt FROM embeddings GROUP BY ALL),
act AS (SELECT a AS cls, sum(cnt) AS support, sum(CASE WHEN a = p THEN cnt ELSE 0 END) AS tp FROM cc GROUP BY a),
pre AS (SELECT p AS cls, sum(cnt) AS pp FROM cc GROUP BY p),
r AS (SELECT cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(pp, 0) AS pp
      FROM act FULL JOIN pre USING (cls))
SELECT cls AS class, round(CASE WHEN pp > 0 THEN tp / pp ELSE 0 END, 6) AS precision,
       round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall,
       round(CASE WHEN pp + support > 0 THEN 2 * tp / (pp + support) ELSE 0 END, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM r""")
def i7_class_report(spark, sf):
    from sparkselect.sources.io import table
    e = table(spark, sf, "embeddings").select(F.col("label").alias("y"), (F.col("vec_id") % 10).alias("yhat"))
    return finish(D.class_report(e, "y", "yhat"))


@query("i12_calibration", f"""WITH {SCORED}
SELECT CAST(least(greatest(floor(score * 10), 0), 9) AS BIGINT) AS bin, round(avg(score), 6) AS mean_score,
       round(avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END), 6) AS observed_rate, CAST(count(*) AS BIGINT) AS count
FROM s GROUP BY 1""")
def i12_calibration(spark, sf):
    return finish(D.calibration_table(scored_t1(spark, sf), "y", "score", bins=10))


@query("i12_brier", f"""WITH {SCORED}
SELECT round(avg((score - y) * (score - y)), 6) AS brier FROM s""")
def i12_brier(spark, sf):
    return finish(D.brier_score(scored_t1(spark, sf), "y", "score"))


LIFT = f"""{SCORED},
d AS (SELECT y, ntile(10) OVER (ORDER BY score DESC, event_id) AS decile FROM s),
per AS (SELECT decile, count(*) AS rows, sum(y) AS positives FROM d GROUP BY decile),
lt AS (SELECT decile, rows, positives, positives / rows AS rate,
              (positives / rows) / (SELECT avg(y) FROM s) AS lift FROM per)"""


@query("i15_lift", f"""WITH {LIFT}
SELECT CAST(decile AS BIGINT) AS decile, CAST(rows AS BIGINT) AS rows, CAST(positives AS BIGINT) AS positives,
       round(rate, 6) AS rate, round(lift, 6) AS lift FROM lt""")
def i15_lift(spark, sf):
    return finish(D.lift_table(scored_t1(spark, sf), "y", "score", "event_id", 10))


@query("i16_gain", f"""WITH {LIFT}
SELECT CAST(decile AS BIGINT) AS decile, round(sum(rows) OVER (ORDER BY decile) / sum(rows) OVER (), 6) AS share_rows,
       round(sum(positives) OVER (ORDER BY decile) / sum(positives) OVER (), 6) AS share_positives FROM lt""")
def i16_gain(spark, sf):
    return finish(D.gain_table(scored_t1(spark, sf), "y", "score", "event_id", 10))


@query("i17_ks", f"""WITH {SCORED}, {CUM},
g AS (SELECT score, tp / P AS cum_pos, fp / N AS cum_neg, tp / P - fp / N AS gap FROM c)
SELECT round(score, 6) AS threshold, round(cum_pos, 6) AS cum_pos, round(cum_neg, 6) AS cum_neg, round(gap, 6) AS gap,
       round(max(gap) OVER (), 6) AS ks, CAST(CASE WHEN gap = max(gap) OVER () THEN 1 ELSE 0 END AS BIGINT) AS is_max
FROM g""")
def i17_ks(spark, sf):
    return finish(D.ks_table(scored_t1(spark, sf), "y", "score"))


FAIR = f"""{SCORED},
src AS (SELECT 'event_type' || '|' || event_type AS grp, y, yhat FROM s),
{O.metrics_from('src', by='grp')},
sel AS (SELECT 'event_type' || '|' || event_type AS grp, avg(CASE WHEN yhat = 1 THEN 1.0 ELSE 0.0 END) AS selection_rate
        FROM s GROUP BY 1),
fair AS (SELECT split_part(grp, '|', 1) AS "column", split_part(grp, '|', 2) AS level, n AS rows, selection_rate, {', '.join(M)}
         FROM met JOIN sel USING (grp))"""


@query("j1_fairness", f"""WITH {FAIR}
SELECT "column", level, rows, round(selection_rate, 6) AS selection_rate, {O.rounded(M)} FROM fair""")
def j1_fairness(spark, sf):
    return finish(fairness(scored_t1(spark, sf), "y", "yhat", ["event_type"]))


_GAP_LONG = " UNION ALL ".join(f"SELECT \"column\", '{m}' AS metric, {m} AS value FROM fair"
                               for m in ["selection_rate", *M])


@query("j2_fairness_gap", f"""WITH {FAIR},
long AS ({_GAP_LONG})
SELECT "column", metric, round(max(value) - min(value), 6) AS gap,
       round(CASE WHEN max(value) <> 0 THEN min(value) / max(value) END, 6) AS ratio FROM long GROUP BY ALL""")
def j2_fairness_gap(spark, sf):
    return finish(fairness_gap(fairness(scored_t1(spark, sf), "y", "yhat", ["event_type"])))


@query("j3_score_validation", NB_SQL.replace(
    f"te AS (SELECT * FROM t1 WHERE NOT {O.is_train('event_id')})", "te AS (SELECT * FROM t1)") + """
SELECT event_id, CAST(prediction AS BIGINT) AS "Predictions" FROM nb WHERE r = 1""")
def j3_score_validation(spark, sf):
    df = t1_events(spark, sf)
    tr, _ = S.holdout(df, "event_id")
    model = make_estimator("nb").fit(assemble(tr, ["value", "k", "h"]).withColumn("label", F.col("y").cast("double")))
    val = assemble(df, ["value", "k", "h"])
    out = score_validation(model, val, keep=["event_id"])
    return finish(out.withColumn("Predictions", F.col("Predictions").cast("bigint")))


# ------------------------------------------------------------------ streaming twins of J3 and H1-H7


def _stream_t1(spark, sf):
    from sparkselect.sources.io import table
    schema = table(spark, sf, "events").schema
    ev = table_stream(spark, sf, "events", schema)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    flip = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 2), 16, 10).cast("bigint")
    t = ev.select("event_id", "value", k.alias("k"), F.hour("ts").alias("h"), flip.alias("__flip"))
    t = t.withColumn("y", F.when((F.col("value") + F.col("k") > 90) != (F.col("__flip") < 20), 1).otherwise(0))
    return assemble(t.drop("__flip"), ["value", "k", "h"])


def _nb_model(spark, sf):
    tr, _ = S.holdout(t1_events(spark, sf), "event_id")
    return make_estimator("nb").fit(assemble(tr, ["value", "k", "h"]).withColumn("label", F.col("y").cast("double")))


@query("st_stream_scoring", NB_SQL.replace(
    f"te AS (SELECT * FROM t1 WHERE NOT {O.is_train('event_id')})", "te AS (SELECT * FROM t1)") + """
SELECT event_id, CAST(prediction AS BIGINT) AS "Predictions" FROM nb WHERE r = 1""")
def st_stream_scoring(spark, sf):
    scored = score_stream(_nb_model(spark, sf), _stream_t1(spark, sf), ["event_id"])
    return finish(run_to_table(scored).withColumn("Predictions", F.col("Predictions").cast("bigint")))


@query("st_stream_running_metrics", NB_SQL.replace(
    f"te AS (SELECT * FROM t1 WHERE NOT {O.is_train('event_id')})", "te AS (SELECT * FROM t1)") + f""",
src AS (SELECT 'all' AS model, t1.y, nb.prediction AS yhat FROM nb JOIN t1 USING (event_id) WHERE r = 1),
{O.metrics_from('src')}
SELECT n, {O.rounded(M)} FROM met""")
def st_stream_running_metrics(spark, sf):
    scored = _nb_model(spark, sf).transform(_stream_t1(spark, sf))
    return finish(running_metrics(scored, "y", "prediction"))
