"""Registered role, source and preparation queries."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparkselect.operators import prep as E
from sparkselect.operators import roles as B
from sparkselect.operators import split as S
from sparkselect.plans import oracle_sql as O
from sparkselect.plans.common import finish
from sparkselect.plans.registry import query
from sparkselect.plans.tasks import orders_with_nulls, t1_events
from sparkselect.sources.io import null_if, table
from sparkselect.functions.metrics import regression_metrics
from sparkselect.operators.regression import make_regressor
from sparkselect.plans.common import assemble
from sparkselect.sources.io import preview, read_table, read_validation
from sparkselect.plans.catalog import FLAG_MODELS
from sparkselect.session import stored_split

T1N = f"""{O.T1}, t1n AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, k, h, y FROM t1)"""


def t1_nulls(spark, sf):
    t = t1_events(spark, sf)
    return t.select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"),
                    "k", "h", "y")


# ------------------------------------------------------------------ A10 / B
@query("a10_null_if", """
SELECT p_partkey, CAST(CASE WHEN p_size IN (1, 2) THEN NULL ELSE p_size END AS BIGINT) AS p_size FROM part""")
def a10_null_if(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    return finish(null_if(p, {"p_size": [1, 2]}))


@query("b2_infer_roles", """
WITH d AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS d1, count(DISTINCT o_custkey) AS d2,
                  count(DISTINCT o_orderstatus) AS d3, count(DISTINCT o_totalprice) AS d4,
                  count(DISTINCT o_orderdate) AS d5, count(DISTINCT o_orderpriority) AS d6,
                  count(DISTINCT 'x') AS d7 FROM (SELECT *, 'x' AS const_col FROM orders))
SELECT * FROM (
  SELECT 'o_orderkey' AS "column", 'bigint' AS dtype,
         CASE WHEN d1 <= 1 THEN 'constant' WHEN d1 = n THEN 'key' ELSE 'numeric' END AS role, d1 AS distinct FROM d
  UNION ALL SELECT 'o_custkey', 'bigint', CASE WHEN d2 <= 1 THEN 'constant' WHEN d2 = n THEN 'key' ELSE 'numeric' END, d2 FROM d
  UNION ALL SELECT 'o_orderstatus', 'string', 'target', d3 FROM d
  UNION ALL SELECT 'o_totalprice', 'double', CASE WHEN d4 <= 1 THEN 'constant' ELSE 'numeric' END, d4 FROM d
  UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', CASE WHEN d5 <= 1 THEN 'constant' ELSE 'datetime' END, d5 FROM d
  UNION ALL SELECT 'o_orderpriority', 'string', CASE WHEN d6 <= 1 THEN 'constant' WHEN d6 = n THEN 'key' ELSE 'categorical' END, d6 FROM d
  UNION ALL SELECT 'const_col', 'string', CASE WHEN d7 <= 1 THEN 'constant' ELSE 'categorical' END, d7 FROM d)""")
def b2_infer_roles(spark, sf):
    o = table(spark, sf, "orders").withColumn("const_col", F.lit("x"))
    return finish(B.infer_roles(o, "o_orderstatus"))


@query("b3_b5_prepare", f"""WITH {O.ORDERS_NULLS}
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice,
       o_orderpriority FROM onl WHERE o_orderpriority IS NOT NULL""")
def b3_b5_prepare(spark, sf):
    o = orders_with_nulls(spark, sf)
    o = B.drop_null_target(o, "o_orderpriority")
    o = B.drop_excluded(o, ["o_orderdate"])
    o = B.cast_categorical(o, ["o_custkey"])
    return finish(B.cast_numeric(o, ["o_totalprice"]))


@query("b6_encode_target", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS label,
       o_orderstatus AS decoded FROM orders""")
def b6_encode_target(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    idx = B.encode_target("o_orderstatus").fit(o)
    enc = idx.transform(o)
    dec = B.decode_target(idx, input_col="label", output="decoded").transform(enc)
    return finish(dec.select("o_orderkey", "label", "decoded"))


@query("b7_one_hot", f"""WITH {O.ORDERS_NULLS},
lv AS (SELECT o_orderpriority AS v, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS idx
       FROM (SELECT DISTINCT o_orderpriority FROM onl WHERE {O.is_train('o_orderkey')} AND o_orderpriority IS NOT NULL)),
nl AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM lv)
SELECT o_orderkey, coalesce(lv.idx, nl.n) AS idx, CAST(CASE WHEN lv.idx IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS hot,
       CAST(nl.n AS BIGINT) AS width
FROM onl LEFT JOIN lv ON onl.o_orderpriority = lv.v, nl""")
def b7_one_hot(spark, sf):
    o = orders_with_nulls(spark, sf).select("o_orderkey", "o_orderpriority")
    train, _ = S.holdout(o, "o_orderkey")
    model = Pipeline(stages=B.one_hot(["o_orderpriority"])).fit(train)
    out = model.transform(o)
    arr = vector_to_array("o_orderpriority__ohe")
    return finish(out.select("o_orderkey", F.col("o_orderpriority__idx").alias("idx"),
                             F.aggregate(arr, F.lit(0.0), lambda a, b: a + b).alias("hot"),
                             F.size(arr).alias("width")))


# ------------------------------------------------------------------ E1b / E1
@query("e1b_simple_impute", f"""WITH {O.ORDERS_NULLS},
f AS (SELECT avg(o_totalprice) AS mean_p, quantile_cont(o_totalprice, 0.5) AS med_p FROM onl),
m AS (SELECT o_orderpriority AS mode_v FROM onl WHERE o_orderpriority IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, round(coalesce(o_totalprice, mean_p), 4) AS price_mean,
       round(coalesce(o_totalprice, med_p), 4) AS price_median,
       coalesce(o_orderpriority, mode_v) AS priority_mode FROM onl, f, m""")
def e1b_simple_impute(spark, sf):
    o = orders_with_nulls(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority")
    mean = E.SimpleImputer(["o_totalprice"], ["price_mean"], "mean").fit(o)
    med = E.SimpleImputer(["o_totalprice"], ["price_median"], "median").fit(o)
    mode = E.SimpleImputer(["o_orderpriority"], ["priority_mode"], "mode").fit(o)
    out = mode.transform(med.transform(mean.transform(o)))
    return finish(out.select("o_orderkey", F.round("price_mean", 4).alias("price_mean"),
                             F.round("price_median", 4).alias("price_median"), "priority_mode"))


@query("e1_iterative_impute", f"""WITH {T1N},
r AS (SELECT regr_slope(value, k) AS b, regr_intercept(value, k) AS a FROM t1n)
SELECT event_id, round(coalesce(value, a + b * k), 4) AS value FROM t1n, r""")
def e1_iterative_impute(spark, sf):
    t = t1_nulls(spark, sf).select("event_id", "value", "k")
    model = E.IterativeImputer(["value", "k"], rounds=5).fit(t)
    return finish(model.transform(t).select("event_id", F.round("value", 4).alias("value")))


def _two_predictors(i: int, table: str, y: str, a: str, b: str, miss: str) -> str:
    """CTEs that refill ``y`` of ``table`` by least squares on ``a`` and ``b`` over its observed rows."""
    keep = [c for c in ("value", "k", "h") if c != y]
    return f"""
m{i} AS (SELECT avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, covar_pop({a}, {a}) AS aa, covar_pop({b}, {b}) AS bb,
  covar_pop({a}, {b}) AS ab, covar_pop({a}, {y}) AS ay, covar_pop({b}, {y}) AS byy FROM {table} WHERE NOT {miss}),
w{i} AS (SELECT (ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb, my, ma, mb FROM m{i}),
s{i} AS (SELECT event_id, nv, nk, {", ".join(keep)}, CASE WHEN {miss} THEN my + wa * ({a} - ma) + wb * ({b} - mb) ELSE {y} END AS {y} FROM {table}, w{i})"""


def _gaps(spark, sf):
    """T1 with gaps by rule in ``value`` and ``k``, in some rows in both."""
    gap = lambda c, m: F.when(F.col("event_id") % m != 0, F.col(c)).alias(c)
    return t1_events(spark, sf).select("event_id", gap("value", 5), gap("k", 7), F.col("h").cast("double").alias("h"))


@query("e1_moment_sweeps", f"""WITH {O.T1},
g AS (SELECT event_id, event_id % 5 = 0 AS nv, event_id % 7 = 0 AS nk, value, k, CAST(h AS DOUBLE) AS h FROM t1),
a0 AS (SELECT avg(CASE WHEN NOT nv THEN value END) AS mv, avg(CASE WHEN NOT nk THEN k END) AS mk FROM g),
s0 AS (SELECT event_id, nv, nk, CASE WHEN nv THEN mv ELSE value END AS value, CASE WHEN nk THEN mk ELSE k END AS k, h FROM g, a0),
{", ".join(_two_predictors(i + 1, f"s{i}", *(("k", "value", "h", "nk") if i % 2 == 0 else ("value", "k", "h", "nv"))) for i in range(6))}
SELECT event_id, round(value, 4) AS value, round(k, 4) AS k FROM s6""")
def e1_moment_sweeps(spark, sf):
    """Three rounds over two columns with gaps and a whole one, from the moments of four patterns."""
    t = _gaps(spark, sf)
    out = E.IterativeImputer(["value", "k", "h"], rounds=3).fit(t).transform(t)
    return finish(out.select("event_id", F.round("value", 4).alias("value"), F.round("k", 4).alias("k")))


# ------------------------------------------------------------------ E2 / E3 / E4
@query("e2_robust_scale", f"""WITH {O.T1},
q AS (SELECT quantile_disc(value, 0.5) AS med, quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3,
             quantile_disc(k, 0.5) AS kmed, quantile_disc(k, 0.25) AS kq1, quantile_disc(k, 0.75) AS kq3 FROM t1)
SELECT event_id, round((value - med) * (CASE WHEN q3 - q1 <> 0 THEN 1.0 / (q3 - q1) ELSE 0 END), 6) AS value_rs,
       round((k - kmed) * (CASE WHEN kq3 - kq1 <> 0 THEN 1.0 / (kq3 - kq1) ELSE 0 END), 6) AS k_rs FROM t1, q""")
def e2_robust_scale(spark, sf):
    t = t1_events(spark, sf).select("event_id", "value", "k")
    m = E.RobustScaler(["value", "k"], ["value_rs", "k_rs"]).fit(t)
    return finish(m.transform(t).select("event_id", "value_rs", "k_rs"))


YJ = """CASE WHEN x >= 0 THEN (CASE WHEN lam = 0 THEN ln(1 + x) ELSE (pow(x + 1, lam) - 1) / lam END)
        ELSE (CASE WHEN lam = 2 THEN -ln(1 - x) ELSE -(pow(1 - x, 2 - lam) - 1) / (2 - lam) END) END"""


@query("e3_yeo_johnson", f"""WITH {O.T1}, xs AS (SELECT value AS x FROM t1),
s AS (SELECT count(x) AS n, sum(sign(x) * ln(1 + abs(x))) AS sl FROM xs),
g1 AS (SELECT CAST(i - 20 AS DOUBLE) / 10 AS lam FROM range(0, 41) t(i)),
l1 AS (SELECT lam, -(n / 2.0) * ln(var_pop({YJ})) + (lam - 1) * sl AS ll FROM g1, xs, s GROUP BY lam, n, sl),
b1 AS (SELECT lam AS c FROM l1 ORDER BY ll DESC, lam LIMIT 1),
g2 AS (SELECT c + CAST(j - 10 AS DOUBLE) / 100 AS lam FROM range(0, 21) t(j), b1),
l2 AS (SELECT lam, -(n / 2.0) * ln(var_pop({YJ})) + (lam - 1) * sl AS ll FROM g2, xs, s GROUP BY lam, n, sl),
b2 AS (SELECT lam FROM l2 ORDER BY ll DESC, lam LIMIT 1)
SELECT event_id, round(lam, 6) AS lambda,
       round({YJ.replace('x', 'value').replace('lvalue', 'lx').replace('value_', 'x_')}, 6) AS value_yj FROM t1, b2""")
def e3_yeo_johnson(spark, sf):
    t = t1_events(spark, sf).select("event_id", "value")
    m = E.YeoJohnson(["value"], ["value_yj"]).fit(t)
    return finish(m.transform(t).select("event_id", F.lit(m.lambdas()["value"]).alias("lambda"), "value_yj"))


@query("e4_remove_outliers", f"""WITH {O.T1},
m AS (SELECT avg(value) AS m1, avg(k) AS m2, var_samp(value) AS c11, covar_samp(value, k) AS c12, var_samp(k) AS c22 FROM t1),
d AS (SELECT event_id, ((value - m1) * (value - m1) * c22 - 2 * (value - m1) * (k - m2) * c12
                       + (k - m2) * (k - m2) * c11) / (c11 * c22 - c12 * c12) AS d2 FROM t1, m),
q AS (SELECT quantile_cont(d2, 0.95) AS cut FROM d)
SELECT event_id FROM d, q WHERE d2 > cut""")
def e4_remove_outliers(spark, sf):
    t = t1_events(spark, sf).select("event_id", "value", "k")
    flagged = E.remove_outliers(t, ["value", "k"], 0.05, flag="outlier")
    return finish(flagged.where("outlier = 1").select("event_id"))


# ------------------------------------------------------------------ E6-E8
_GEN = ["l_quantity", "l_discount", "l_tax"]


def _gen_sql():
    parts = []
    for i, a in enumerate(_GEN):
        for b in _GEN[i + 1:]:
            parts.append(f"round({a} * {b}, 6) AS {a}_x_{b}")
    for a in _GEN:
        for b in _GEN:
            if a != b:
                parts.append(f"round(CASE WHEN {b} = 0 THEN 0 ELSE {a} / {b} END, 6) AS {a}_div_{b}")
    for a in _GEN:
        parts.append(f"round({a} * {a}, 6) AS {a}_sq")
    return ", ".join(parts)


@query("e6_e8_generated_features", f"SELECT l_orderkey, {_gen_sql()} FROM lineitem")
def e6_e8_generated_features(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", *_GEN)
    out = E.FeatureGenerator(_GEN).transform(li)
    return finish(out.drop(*_GEN))


_WIDE = [f"c{i}" for i in range(12)]
_WIDE_COLS = ", ".join(f"CAST(l_{n} AS DOUBLE) + {i} AS c{i}" for i, n in enumerate(["quantity", "extendedprice", "discount", "tax"] * 3))


def _wide_sql():
    # products of prices reach 1e10, where a double holds no sixth decimal: four decimals are exact for cents
    out = [f"round({a} * {b}, 4) AS {a}_x_{b}" for i, a in enumerate(_WIDE) for b in _WIDE[i + 1:]]
    out += [f"round(CASE WHEN {b} = 0 THEN 0 ELSE {a} / {b} END, 6) AS {a}_div_{b}" for a in _WIDE for b in _WIDE if a != b]
    return ", ".join(out + [f"round({a} * {a}, 4) AS {a}_sq" for a in _WIDE])


@query("e6_e8_wide", f"SELECT l_orderkey, {_wide_sql()} FROM (SELECT l_orderkey, {_WIDE_COLS} FROM lineitem)")
def e6_e8_wide(spark, sf):
    """Twelve numeric columns: all 210 products, ratios and squares."""
    li = table(spark, sf, "lineitem")
    cols = [(F.col(f"l_{n}").cast("double") + i).alias(f"c{i}") for i, n in enumerate(["quantity", "extendedprice", "discount", "tax"] * 3)]
    out = E.FeatureGenerator(_WIDE).transform(li.select("l_orderkey", *cols)).drop(*_WIDE)
    return finish(out.select(*[F.round(c, 4).alias(c) if "_x_" in c or c.endswith("_sq") else F.col(c) for c in out.columns]))


# ------------------------------------------------------------------ E9
@query("e9_rare_levels", f"""
WITH tr AS (SELECT * FROM documents WHERE {O.is_train('doc_id')}),
sh AS (SELECT 'lang' AS c, lang AS v, count(*) / sum(count(*)) OVER () AS s FROM tr GROUP BY lang
       UNION ALL SELECT 'source', source, count(*) / sum(count(*)) OVER () FROM tr GROUP BY source)
SELECT doc_id,
  CASE WHEN lang IN (SELECT v FROM sh WHERE c = 'lang' AND s >= 0.1) THEN lang ELSE '__rare__' END AS lang,
  CASE WHEN source IN (SELECT v FROM sh WHERE c = 'source' AND s >= 0.1) THEN source ELSE '__rare__' END AS source
FROM documents""")
def e9_rare_levels(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    train, _ = S.holdout(d, "doc_id")
    m = E.RareLevelCombiner(["lang", "source"], threshold=0.1).fit(train)
    return finish(m.transform(d))


# ------------------------------------------------------------------ E10 / E13 / E12
_MC = ["value", "k", "h", "value2", "k2"]


def _mc_frame(spark, sf):
    t = t1_events(spark, sf)
    return t.select("value", "k", "h", (F.col("value") * 1.5 + F.col("h") * 0.01).alias("value2"),
                    (F.col("k") + F.col("h") * 0.1).alias("k2"), "y")


def _mc_sql():
    pairs = [(a, b) for i, a in enumerate(_MC) for b in _MC[i + 1:]]
    rs = ", ".join(f"corr({a}, {b}) AS r_{a}_{b}" for a, b in pairs)
    ts = ", ".join(f"corr({c}, y) AS t_{c}" for c in _MC)
    drops = " UNION ALL ".join(
        f"SELECT CASE WHEN abs(t_{a}) < abs(t_{b}) THEN '{a}' ELSE '{b}' END AS c FROM cr WHERE abs(r_{a}_{b}) > 0.9"
        for a, b in pairs)
    cols = " UNION ALL ".join(f"SELECT '{c}' AS c" for c in _MC)
    return f"""WITH {O.T1}, x AS (SELECT value, k, h, value * 1.5 + h * 0.01 AS value2, k + h * 0.1 AS k2, y FROM t1),
cr AS (SELECT {rs}, {ts} FROM x), dr AS ({drops}), al AS ({cols})
SELECT c AS "column", CAST(CASE WHEN c IN (SELECT c FROM dr) THEN 1 ELSE 0 END AS BIGINT) AS dropped FROM al"""


@query("e10_multicollinearity", _mc_sql())
def e10_multicollinearity(spark, sf):
    m = E.CorrelationFilter(_MC, threshold=0.9, targetCol="y").fit(_mc_frame(spark, sf))
    dropped = set(m.dropped())
    return finish(spark.createDataFrame([(c, int(c in dropped)) for c in _MC], "column string, dropped bigint"))


_PC = ["l_quantity", "q2", "l_discount", "l_tax"]


@query("e13_perfect_collinearity", "WITH x AS (SELECT l_quantity, l_quantity * 2 AS q2, l_discount, l_tax FROM lineitem),\n"
       + "cr AS (SELECT " + ", ".join(f"corr({a}, {b}) AS r_{a}_{b}" for i, a in enumerate(_PC) for b in _PC[i + 1:])
       + " FROM x), dr AS (" + " UNION ALL ".join(
           f"SELECT '{b}' AS c FROM cr WHERE abs(r_{a}_{b}) >= 1 - 1e-9" for i, a in enumerate(_PC) for b in _PC[i + 1:])
       + "), al AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c" for c in _PC) + """)
SELECT c AS "column", CAST(CASE WHEN c IN (SELECT c FROM dr) THEN 1 ELSE 0 END AS BIGINT) AS dropped FROM al""")
def e13_perfect_collinearity(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_quantity") * 2).alias("q2"), "l_discount", "l_tax")
    m = E.CorrelationFilter(_PC, perfect=True).fit(li)
    dropped = set(m.dropped())
    return finish(spark.createDataFrame([(c, int(c in dropped)) for c in _PC], "column string, dropped bigint"))


_LV = ["o_orderstatus", "flag", "one", "o_totalprice"]


@query("e12_low_variance", """
WITH x AS (SELECT o_orderstatus, CASE WHEN o_orderkey % 100 = 0 THEN 'rare' ELSE 'common' END AS flag,
                  1.0 AS one, o_totalprice FROM orders),
n AS (SELECT count(*) AS n FROM x),
cat AS (SELECT c, count(*) AS d, max(CASE WHEN r = 1 THEN cnt END) AS c1, max(CASE WHEN r = 2 THEN cnt END) AS c2 FROM (
          SELECT c, v, cnt, row_number() OVER (PARTITION BY c ORDER BY cnt DESC, v) AS r FROM (
            SELECT 'o_orderstatus' AS c, o_orderstatus AS v, count(*) AS cnt FROM x GROUP BY 2
            UNION ALL SELECT 'flag', flag, count(*) FROM x GROUP BY 2)) GROUP BY c),
num AS (SELECT 'one' AS c, var_pop(one) AS v FROM x UNION ALL SELECT 'o_totalprice', var_pop(o_totalprice) FROM x)
SELECT c AS "column", CAST(CASE WHEN d <= 1 OR (d / n < 0.1 AND c2 IS NOT NULL AND c1 / c2 > 20) THEN 1 ELSE 0 END AS BIGINT) AS dropped
FROM cat, n
UNION ALL SELECT c, CAST(CASE WHEN v IS NULL OR v = 0 THEN 1 ELSE 0 END AS BIGINT) FROM num""")
def e12_low_variance(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderstatus", F.when(F.col("o_orderkey") % 100 == 0, "rare").otherwise("common").alias("flag"),
        F.lit(1.0).alias("one"), "o_totalprice")
    m = E.LowVarianceFilter(_LV).fit(o)
    dropped = set(m.dropped())
    return finish(spark.createDataFrame([(c, int(c in dropped)) for c in _LV], "column string, dropped bigint"))


# ------------------------------------------------------------------ E15
@query("e15_count_encode", f"""
WITH tr AS (SELECT CAST(o_custkey AS VARCHAR) AS v, count(*) AS cnt FROM orders WHERE {O.is_train('o_orderkey')} GROUP BY 1)
SELECT o_orderkey, CAST(coalesce(tr.cnt, 0) AS BIGINT) AS custkey_count
FROM orders LEFT JOIN tr ON CAST(orders.o_custkey AS VARCHAR) = tr.v""")
def e15_count_encode(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    train, _ = S.holdout(o, "o_orderkey")
    m = E.CountEncoder(["o_custkey"], ["custkey_count"]).fit(train)
    return finish(m.transform(o).select("o_orderkey", "custkey_count"))


# ------------------------------------------------------------------ K1 / K2 regression


@query("k1_linear_regression", """
SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS value FROM lineitem
UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem""")
def k1_linear_regression(spark, sf):
    li = assemble(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity"])
    m = make_regressor("lr", label="l_extendedprice").fit(li)
    rows = [("intercept", float(m.intercept)), ("l_quantity", float(m.coefficients[0]))]
    return spark.createDataFrame(rows, "term string, value double").select("term", F.round("value", 4).alias("value"))


@query("k2_regression_metrics", """
WITH p AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500.0 AS yhat FROM lineitem)
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(avg(abs(yhat - y)), 4) AS mae,
       round(avg((yhat - y) * (yhat - y)), 2) AS mse, round(sqrt(avg((yhat - y) * (yhat - y))), 4) AS rmse,
       round(1 - avg((yhat - y) * (yhat - y)) / var_pop(y), 6) AS r2,
       round(avg(CASE WHEN y <> 0 THEN abs((yhat - y) / y) END), 6) AS mape
FROM p GROUP BY l_returnflag""")
def k2_regression_metrics(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"),
                                             (F.col("l_quantity") * 1500.0).alias("yhat"))
    m = regression_metrics(li, "y", "yhat", ["l_returnflag"])
    return m.select("l_returnflag", "n", F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"),
                    F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"), F.round("mape", 6).alias("mape"))


@query("k1_regressor_menu")
def k1_regressor_menu(spark, sf):
    li = assemble(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax",
                                                      "l_extendedprice"), ["l_quantity", "l_discount", "l_tax"])
    tr, te = (stored_split(part.select("features", "l_extendedprice"), "menu-rows").frame for part in S.holdout(li, "l_orderkey"))
    outs = []
    for code in ("lr", "rf", "gbr"):
        m = make_regressor(code, label="l_extendedprice").fit(tr)
        outs.append(regression_metrics(m.transform(te), "l_extendedprice", "prediction").withColumn("model", F.lit(code)))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return finish(out)


# ------------------------------------------------------------------ A1 / A2 / A4 / B8 / B9


@query("a1_read_table", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM orders")
def a1_read_table(spark, sf):
    o = read_table(spark, f"{sf}/orders.parquet")
    return finish(o.select("o_orderkey", "o_orderstatus", "o_totalprice"))


@query("a2_read_validation", "SELECT event_id, event_type, round(value, 6) AS value FROM events")
def a2_read_validation(spark, sf):
    like = table(spark, sf, "events")
    v = read_validation(spark, f"{sf}/events.parquet", like)
    return finish(v.select("event_id", "event_type", "value"))


@query("a4_preview", """
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5""")
def a4_preview(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return finish(preview(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5))


_B8 = ["nb", "lda", "dummy"]


@query("b8_add_prediction", f"""
SELECT p_nb.event_id, CAST(p_nb.prediction AS DOUBLE) AS pred_nb, CAST(p_lda.prediction AS DOUBLE) AS pred_lda,
       CAST(p_dummy.prediction AS DOUBLE) AS pred_dummy
FROM ({FLAG_MODELS['nb'][1]}) p_nb JOIN ({FLAG_MODELS['lda'][1]}) p_lda USING (event_id)
JOIN ({FLAG_MODELS['dummy'][1]}) p_dummy USING (event_id)""")
def b8_add_prediction(spark, sf):
    from sparkselect.operators.models import make_estimator
    from sparkselect.plans.common import assemble
    t = t1_events(spark, sf)
    tr, te = S.holdout(t, "event_id")
    tr = tr.withColumn("label", F.col("y").cast("double"))
    scored = te.select("event_id", "value", "k", "h")
    for code in _B8:
        cols = FLAG_MODELS[code][0]
        est = make_estimator(code, features=f"f_{code}")
        model = Pipeline(stages=[__import__("pyspark.ml.feature", fromlist=["VectorAssembler"]).VectorAssembler(
            inputCols=cols, outputCol=f"f_{code}"), est]).fit(tr)
        scored = B.add_prediction(scored, model, f"pred_{code}")
    return finish(scored.select("event_id", *[f"pred_{c}" for c in _B8]))


@query("b9_project_label", f"SELECT CAST(prediction AS DOUBLE) AS \"Label\" FROM ({FLAG_MODELS['nb'][1]}) p")
def b9_project_label(spark, sf):
    from sparkselect.operators.models import make_estimator
    from sparkselect.plans.common import assemble
    t = t1_events(spark, sf)
    tr, te = S.holdout(t, "event_id")
    m = make_estimator("nb").fit(assemble(tr, ["value", "k", "h"]).withColumn("label", F.col("y").cast("double")))
    return finish(B.project_label(m.transform(assemble(te, ["value", "k", "h"]))))
