"""Registered queries of as-of, interval and range joins, and of the fairness cube, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkselect.operators.fairness import fairness_cube
from sparkselect.operators.temporal import as_of_join, interval_join, range_join
from sparkselect.plans.catalog_curves import NB_SQL, SCORED, _nb_model, scored_t1
from sparkselect.plans import oracle_sql as O
from sparkselect.plans.common import assemble, finish
from sparkselect.plans.registry import query
from sparkselect.plans.tasks import t1_events
from sparkselect.sources.io import table
from sparkselect.streaming.windows import WindowedMetrics, window_counts


# ------------------------------------------------------------------ point-in-time features
@query("as_of_order", """
WITH o AS (SELECT o_custkey, o_orderdate, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2),
e AS (SELECT event_id, user_id, ts - INTERVAL 9500 DAY AS t FROM events)
SELECT event_id, CAST(o_orderdate AS VARCHAR) AS o_orderdate, round(o_totalprice, 6) AS o_totalprice
FROM e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.t >= o.o_orderdate""")
def as_of_order(spark, sf):
    """The last order of the event's user before the (shifted) event."""
    e = table(spark, sf, "events").select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 9500 DAY")).alias("t"))
    out = as_of_join(e, table(spark, sf, "orders"), [("user_id", "o_custkey")], ("t", "o_orderdate"), ["o_totalprice"], tie="o_orderkey")
    return finish(out.select("event_id", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_totalprice"))


@query("as_of_click", """
WITH r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click'),
j AS (SELECT l.event_id, l.ts, r.ts AS c_ts, r.value AS c_value FROM events l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts)
SELECT event_id, CASE WHEN ts - c_ts <= INTERVAL 12 HOUR THEN round(c_value, 6) END AS c_value FROM j""")
def as_of_click(spark, sf):
    """The user's last click at most twelve hours before every event; busy users are cut into slices."""
    e = table(spark, sf, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", "value")
    out = as_of_join(e.select("event_id", "user_id", "ts"), clicks, [("user_id", "user_id")], ("ts", "ts"), ["value"], within=12 * 3600, prefix="c_", slice_rows=50)
    return finish(out.select("event_id", "c_value"))


# ------------------------------------------------------------------ overlaps
_SPANS = "o_orderkey, o_custkey, o_orderdate AS s, o_orderdate + INTERVAL (CASE WHEN o_orderkey % 50 = 0 THEN 700 ELSE o_orderkey % 40 END) DAY AS e"


def _spans(spark, sf):
    days = F.when(F.col("o_orderkey") % 50 == 0, 700).otherwise(F.col("o_orderkey") % 40)
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.make_dt_interval(days.cast("int"))).alias("e"))


@query("interval_overlaps", f"""
WITH o AS (SELECT {_SPANS} FROM orders)
SELECT a.o_orderkey AS o_orderkey_l, b.o_orderkey AS o_orderkey_r
FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e WHERE a.o_orderkey < b.o_orderkey""")
def interval_overlaps(spark, sf):
    """Pairs of a customer's orders whose delivery times (0 to 39, or 700 days) overlap."""
    o = _spans(spark, sf)
    return finish(interval_join(o, o, ("s", "e"), ("s", "e"), [("o_custkey", "o_custkey")]).where("o_orderkey_l < o_orderkey_r").select("o_orderkey_l", "o_orderkey_r"))


@query("range_open_orders", f"""
WITH o AS (SELECT {_SPANS} FROM orders), e AS (SELECT event_id, ts - INTERVAL 9500 DAY AS t FROM events)
SELECT event_id AS event_id_l, count(*) AS open_orders, CAST(sum(o_orderkey % 1000) AS BIGINT) AS keys FROM e JOIN o ON s <= t AND t < e GROUP BY event_id""")
def range_open_orders(spark, sf):
    """How many orders are open at each event, over all customers."""
    e = table(spark, sf, "events").select("event_id", (F.col("ts") - F.expr("INTERVAL 9500 DAY")).alias("t"))
    hits = range_join(e, _spans(spark, sf), "t", ("s", "e"), totals={"open_orders": F.lit(1), "keys": F.col("o_orderkey") % 1000})
    return finish(hits.groupBy("event_id_l").agg(F.sum("open_orders").alias("open_orders"), F.sum("keys").alias("keys")))


# ------------------------------------------------------------------ fairness over all combinations
@query("j1_fairness_cube", f"""
WITH {SCORED},
c AS (SELECT s.y, s.yhat, s.event_type, CASE WHEN hour(e.ts) < 12 THEN 'am' ELSE 'pm' END AS half, CAST(e.user_id % 7 AS VARCHAR) AS part FROM s JOIN events e USING (event_id)),
g AS (SELECT concat_ws(',', CASE WHEN grouping(event_type) = 0 THEN 'event_type' END, CASE WHEN grouping(half) = 0 THEN 'half' END, CASE WHEN grouping(part) = 0 THEN 'part' END) AS "columns",
             event_type, half, part, count(*) AS n, avg(CASE WHEN yhat = 1 THEN 1.0 ELSE 0 END) AS selection_rate, avg(CASE WHEN y = yhat THEN 1.0 ELSE 0 END) AS accuracy,
             avg(CASE WHEN y = 1 THEN CASE WHEN yhat = 1 THEN 1.0 ELSE 0 END END) AS tpr, avg(CASE WHEN y <> 1 THEN CASE WHEN yhat = 1 THEN 1.0 ELSE 0 END END) AS fpr
      FROM c GROUP BY CUBE (event_type, half, part))
SELECT "columns", event_type, half, part, n, round(selection_rate, 6) AS selection_rate, round(accuracy, 6) AS accuracy, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr,
       round(selection_rate - (SELECT selection_rate FROM g WHERE "columns" = ''), 6) AS gap FROM g WHERE n >= 30""")
def j1_fairness_cube(spark, sf):
    """Every combination of event type, half of the day and user part with at least 30 rows."""
    e = table(spark, sf, "events").select("event_id", F.when(F.hour("ts") < 12, "am").otherwise("pm").alias("half"), (F.col("user_id") % 7).cast("string").alias("part"))
    return finish(fairness_cube(scored_t1(spark, sf).join(e, "event_id"), "y", "yhat", ["event_type", "half", "part"], 30))


# ------------------------------------------------------------------ event-time windows of a stream
#: Seconds of a window, and of the watermark behind the latest event.
_WIDTH, _DELAY = 12 * 3600, 6 * 3600
_RATES = ("accuracy", "auc", "recall", "precision", "f1", "kappa", "mcc")


@query("st_windowed_metrics", NB_SQL.replace(
    f"te AS (SELECT * FROM t1 WHERE NOT {O.is_train('event_id')})", "te AS (SELECT * FROM t1)") + f""",
tm AS (SELECT event_id, event_type, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS lo, max(epoch_us(ts)) OVER () AS hi FROM events),
ev AS (SELECT event_id, event_type, us // 1000 AS ms, us // 1000 // {_WIDTH * 1000} * {_WIDTH * 1000} AS window_start,
  least(3, 4 * (us - lo) // (hi - lo + 1) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS batch FROM tm),
b AS (SELECT batch, max(ms) AS latest FROM ev GROUP BY 1),
wm AS (SELECT i AS batch, (SELECT max(latest) FROM b WHERE b.batch < i) - {_DELAY * 1000} AS mark FROM range(0, 5) t(i)),
seen AS (SELECT ev.event_type, ev.window_start, t1.y, nb.prediction AS yhat, coalesce(window_start + {_WIDTH * 1000} <= mark, FALSE) AS late
  FROM ev JOIN wm USING (batch) JOIN nb USING (event_id) JOIN t1 USING (event_id) WHERE nb.r = 1),
src AS (SELECT event_type || '|' || window_start AS grp, y, yhat FROM seen, wm
  WHERE NOT late AND wm.batch = 4 AND window_start + {_WIDTH * 1000} <= mark),
{O.metrics_from('src', by='grp')}
SELECT 'window' AS kind, split_part(grp, '|', 1) AS grp, split_part(grp, '|', 2) AS window_start, n, {O.rounded(list(_RATES))} FROM met
UNION ALL SELECT 'late', event_type, NULL, count(*), {", ".join(["NULL"] * len(_RATES))} FROM seen WHERE late GROUP BY event_type""")
def st_windowed_metrics(spark, sf):
    """Metrics of every closed twelve-hour window of the scored events, and late rows by group. The events
    come in four drains of one query, by quarter of their time; every tenth is a quarter behind."""
    e = table(spark, sf, "events")
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    lo, hi = e.agg(F.min(us), F.max(us)).first()
    quarter = F.least(F.lit(3), F.floor(4 * (us - F.lit(lo or 0)) / F.lit((hi or 0) - (lo or 0) + 1)).cast("int") + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    t = t1_events(spark, sf).drop("event_type").join(e.select("event_id", "ts", "event_type", quarter.alias("batch")), "event_id")
    model = _nb_model(spark, sf)
    run = WindowedMetrics(spark)
    schema = t.drop("batch").schema
    for i in range(4):
        t.where(F.col("batch") == i).drop("batch").write.mode("append").parquet(f"{run.path}/in")
        scored = model.transform(assemble(spark.readStream.schema(schema).parquet(f"{run.path}/in"), ["value", "k", "h"]))
        run.drain(window_counts(scored, "ts", "event_type", "y", "prediction", _WIDTH, _DELAY, pieces=2))
    late = run.late().select(F.lit("late").alias("kind"), "grp", F.lit(None).cast("string").alias("window_start"),
                             F.col("late_rows").alias("n"), *[F.lit(None).cast("double").alias(m) for m in _RATES])
    return finish(run.metrics().select(F.lit("window").alias("kind"), "grp", F.col("window_start").cast("string").alias("window_start"), "n", *_RATES).unionByName(late))
