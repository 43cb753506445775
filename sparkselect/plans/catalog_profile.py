"""Registered profiling queries (D1-D18) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkselect.functions.ranking import value_counts_long
from sparkselect.operators import profile as P
from sparkselect.plans import oracle_sql as O
from sparkselect.plans.common import finish
from sparkselect.plans.registry import query
from sparkselect.plans.tasks import orders_with_nulls, t1_events, t4_orders
from sparkselect.sources.io import table

LNUM = ["l_quantity", "l_discount", "l_tax"]
LCORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ONL_ALL = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
U = O.union_per_column


@query("d1_profile_overview", f"""
WITH {O.ORDERS_NULLS},
d AS (SELECT coalesce(sum(cnt - 1), 0) AS dup FROM (
        SELECT count(*) AS cnt FROM onl
        GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        HAVING count(*) > 1))
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(6 AS BIGINT) AS columns,
       CAST(sum((o_totalprice IS NULL)::INT + (o_orderpriority IS NULL)::INT) AS BIGINT) AS missing_cells,
       round(sum((o_totalprice IS NULL)::INT + (o_orderpriority IS NULL)::INT) / (count(*) * 6.0), 6) AS missing_share,
       CAST(max(d.dup) AS BIGINT) AS duplicate_rows, round(max(d.dup) / count(*), 6) AS duplicate_share,
       CAST(3 AS BIGINT) AS numeric_columns, CAST(2 AS BIGINT) AS categorical_columns,
       CAST(1 AS BIGINT) AS datetime_columns
FROM onl, d""")
def d1_profile_overview(spark, sf):
    return finish(P.profile_overview(orders_with_nulls(spark, sf)))


@query("d1_profile_overview_dups", f"""
WITH d AS (SELECT coalesce(sum(cnt - 1), 0) AS dup FROM (
        SELECT count(*) AS cnt FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity HAVING count(*) > 1))
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(3 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS missing_cells,
       CAST(0.0 AS DOUBLE) AS missing_share, CAST(max(d.dup) AS BIGINT) AS duplicate_rows,
       round(max(d.dup) / count(*), 6) AS duplicate_share,
       CAST(1 AS BIGINT) AS numeric_columns, CAST(2 AS BIGINT) AS categorical_columns,
       CAST(0 AS BIGINT) AS datetime_columns
FROM lineitem, d""")
def d1_profile_overview_dups(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return finish(P.profile_overview(li))


_D2 = """SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, CAST(count(*) - count({c}) AS BIGINT) AS missing,
  CAST(count(DISTINCT {c}) AS BIGINT) AS distinct, CAST(sum(CASE WHEN {c} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros,
  CAST(sum(CASE WHEN {c} < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
  round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 9) AS mean, round(sum({c}), 6) AS sum,
  round(stddev_samp({c}), 6) AS std, round(var_samp({c}), 6) AS variance,
  round(stddev_samp({c}) / avg({c}), 6) AS cv,
  round(avg(power({c} - m, 3)) / power(var_pop({c}), 1.5), 6) AS skewness,
  round(avg(power({c} - m, 4)) / power(var_pop({c}), 2) - 3, 6) AS kurtosis,
  round(max(mad), 6) AS mad
FROM lineitem, (SELECT avg({c}) AS m FROM lineitem) a,
     (SELECT quantile_cont(abs({c} - med), 0.5) AS mad
        FROM lineitem, (SELECT quantile_cont({c}, 0.5) AS med FROM lineitem) q) b"""


@query("d2_profile_numeric", U(LNUM, _D2))
def d2_profile_numeric(spark, sf):
    li = table(spark, sf, "lineitem")
    return finish(P.profile_numeric(li, LNUM), overrides={"mean": 9})


_D2N = """SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, CAST(count(*) - count({c}) AS BIGINT) AS missing,
  CAST(count(DISTINCT {c}) AS BIGINT) AS distinct, round(avg({c}), 4) AS mean, round(max(mad), 4) AS mad
FROM onl, (SELECT quantile_cont(abs({c} - med), 0.5) AS mad
        FROM onl, (SELECT quantile_cont({c}, 0.5) AS med FROM onl) q) b"""


@query("d2_profile_numeric_nulls", f"WITH {O.ORDERS_NULLS} " + U(["o_totalprice"], _D2N))
def d2_profile_numeric_nulls(spark, sf):
    o = orders_with_nulls(spark, sf)
    return finish(P.profile_numeric(o, ["o_totalprice"]).select(
        "column", "count", "missing", "distinct", F.round("mean", 4).alias("mean"), F.round("mad", 4).alias("mad")))


_D3 = """SELECT '{c}' AS "column", round(quantile_cont({c}, 0.05), 6) AS p05, round(quantile_cont({c}, 0.25), 6) AS p25,
  round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
  round(quantile_cont({c}, 0.95), 6) AS p95, round(max({c}) - min({c}), 6) AS range,
  round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr FROM {t}"""


@query("d3_profile_quantiles", U(LNUM, _D3.replace("{t}", "lineitem")) + "\nUNION ALL\n"
       + U(["p_retailprice", "p_size"], _D3.replace("{t}", "part")))
def d3_profile_quantiles(spark, sf):
    a = P.profile_quantiles(table(spark, sf, "lineitem"), LNUM)
    b = P.profile_quantiles(table(spark, sf, "part"), ["p_retailprice", "p_size"])
    return finish(a.unionByName(b))


_D4 = """SELECT '{c}' AS "column", CAST(b.bin AS BIGINT) AS bin, round(lo + (b.bin - 1) * (hi - lo) / 10, 6) AS low,
  round(lo + b.bin * (hi - lo) / 10, 6) AS high,
  CAST((SELECT count(*) FROM part WHERE CASE WHEN hi > lo THEN least(floor((p_retailprice_x - lo) / (hi - lo) * 10) + 1, 10) ELSE 1 END = b.bin) AS BIGINT) AS count
FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM part) r, range(1, 11) b(bin)"""


@query("d4_profile_histogram", "\nUNION ALL\n".join(
    _D4.replace("{c}", c).replace("p_retailprice_x", c) for c in ["p_retailprice", "p_size"]))
def d4_profile_histogram(spark, sf):
    return finish(P.profile_histogram(table(spark, sf, "part"), ["p_retailprice", "p_size"], bins=10))


_D5 = """SELECT "column", level, count, share, rank FROM (
  SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS level, CAST(count(*) AS BIGINT) AS count,
         round(count(*) / sum(count(*)) OVER (), 6) AS share,
         CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS BIGINT) AS rank
  FROM part WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 10"""


@query("d5_profile_categorical", U(["p_brand", "p_type", "p_name"], _D5))
def d5_profile_categorical(spark, sf):
    return finish(P.profile_categorical(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"], top=10))


_D6 = """SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS distinct,
  CAST(sum(CASE WHEN cnt = 1 THEN 1 ELSE 0 END) AS BIGINT) AS seen_once,
  CAST(CASE WHEN count(*) = sum(cnt) THEN 1 ELSE 0 END AS BIGINT) AS is_unique
FROM (SELECT {c}, count(*) AS cnt FROM onl WHERE {c} IS NOT NULL GROUP BY {c})"""


@query("d6_profile_distinct", f"WITH {O.ORDERS_NULLS} " + U(ONL_ALL, _D6))
def d6_profile_distinct(spark, sf):
    return finish(P.profile_distinct(orders_with_nulls(spark, sf), ONL_ALL))


@query("d7_profile_missing", f"""WITH {O.ORDERS_NULLS} """ + U(ONL_ALL, """
SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS missing,
       round((count(*) - count({c})) / count(*), 6) AS share FROM onl"""))
def d7_profile_missing(spark, sf):
    return finish(P.profile_missing(orders_with_nulls(spark, sf), ONL_ALL)[0])


@query("d7_profile_missing_pairs", f"""WITH {O.ORDERS_NULLS}
SELECT 'o_totalprice' AS column_a, 'o_orderpriority' AS column_b,
       CAST(sum(CASE WHEN o_totalprice IS NULL AND o_orderpriority IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS both_missing,
       round(corr(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0.0 END,
                  CASE WHEN o_orderpriority IS NULL THEN 1.0 ELSE 0.0 END), 6) AS corr
FROM onl""")
def d7_profile_missing_pairs(spark, sf):
    return finish(P.profile_missing(orders_with_nulls(spark, sf), ONL_ALL)[1])


@query("d8_profile_duplicates", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(count(*) AS BIGINT) AS count
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
ORDER BY count DESC, l_orderkey, l_linenumber LIMIT 10""")
def d8_profile_duplicates(spark, sf):
    li = table(spark, sf, "lineitem")
    return finish(P.profile_duplicates(li, ["l_orderkey", "l_linenumber"], top=10))


_PAIRS = [(a, b) for i, a in enumerate(LCORR) for b in LCORR[i + 1:]]


@query("d9_profile_pearson", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def d9_profile_pearson(spark, sf):
    return finish(P.profile_pearson(table(spark, sf, "lineitem"), LCORR))


@query("d10_profile_spearman", "WITH rk AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in LCORR)
    + " FROM lineitem)\n" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS rho FROM rk" for a, b in _PAIRS))
def d10_profile_spearman(spark, sf):
    return finish(P.profile_spearman(table(spark, sf, "lineitem"), LCORR))


_KPAIRS = [("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax")]
_D11 = """SELECT '{a}' AS column_a, '{b}' AS column_b,
  round((sum(CASE WHEN p.x < q.x AND p.y < q.y THEN p.n * q.n ELSE 0 END)
       - sum(CASE WHEN p.x < q.x AND p.y > q.y THEN p.n * q.n ELSE 0 END))
   / sqrt((max(n0) - max(n1)) * (max(n0) - max(n2))), 6) AS tau_b, CAST(1 AS BIGINT) AS exact
FROM (SELECT {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL) p,
     (SELECT {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL) q,
     (SELECT count(*) * (count(*) - 1) / 2.0 AS n0 FROM lineitem) z,
     (SELECT sum(t * (t - 1) / 2.0) AS n1 FROM (SELECT count(*) AS t FROM lineitem GROUP BY {a})) u,
     (SELECT sum(t * (t - 1) / 2.0) AS n2 FROM (SELECT count(*) AS t FROM lineitem GROUP BY {b})) v"""


@query("d11_profile_kendall", "\nUNION ALL\n".join(_D11.format(a=a, b=b) for a, b in _KPAIRS))
def d11_profile_kendall(spark, sf):
    li = table(spark, sf, "lineitem")
    return finish(P.profile_kendall(li, ["l_quantity", "l_discount", "l_tax"]))


_CPAIRS = [("o_orderstatus", "o_orderpriority"), ("o_orderstatus", "c_mktsegment"), ("o_orderpriority", "c_mktsegment")]
_D12 = """SELECT '{a}' AS column_a, '{b}' AS column_b,
  round(sqrt(greatest(sum((nij - e) * (nij - e) / e), 0) / max(n) / (least(max(r), max(c)) - 1)), 6) AS cramers_v
FROM (SELECT a.a, b.b, coalesce(x.nij, 0) AS nij, a.ri * b.cj / t.n AS e, t.n, t.r, t.c
      FROM (SELECT {a} AS a, CAST(count(*) AS DOUBLE) AS ri FROM t4 GROUP BY 1) a
      CROSS JOIN (SELECT {b} AS b, CAST(count(*) AS DOUBLE) AS cj FROM t4 GROUP BY 1) b
      CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT {a}) AS r, count(DISTINCT {b}) AS c FROM t4) t
      LEFT JOIN (SELECT {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS nij FROM t4 GROUP BY 1, 2) x
        ON x.a = a.a AND x.b = b.b)"""


@query("d12_profile_cramers_v", f"WITH {O.T4} " + "\nUNION ALL\n".join(_D12.format(a=a, b=b) for a, b in _CPAIRS))
def d12_profile_cramers_v(spark, sf):
    t4 = t4_orders(spark, sf)
    return finish(P.profile_cramers_v(t4, ["o_orderstatus", "o_orderpriority", "c_mktsegment"]))


_D13 = """SELECT '{c}' AS "column", side, rank, round(value, 6) AS value, CAST(0 AS BIGINT) AS rest, count FROM (
  SELECT 'min' AS side, CAST(row_number() OVER (ORDER BY {c}) AS BIGINT) AS rank, CAST({c} AS DOUBLE) AS value,
         CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY {c}
  UNION ALL
  SELECT 'max' AS side, CAST(row_number() OVER (ORDER BY {c} DESC) AS BIGINT) AS rank, CAST({c} AS DOUBLE) AS value,
         CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY {c}) WHERE rank <= 5"""


@query("d13_profile_extremes", U(LCORR, _D13))
def d13_profile_extremes(spark, sf):
    return finish(P.profile_extremes(table(spark, sf, "lineitem"), LCORR, n=5))


_ALERT_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
_ALERT_CAT = ["o_orderstatus", "o_orderpriority"]


@query("d14_profile_alerts", f"""
WITH {O.ORDERS_NULLS},
st AS ({U(_ALERT_NUM + _ALERT_CAT, '''SELECT '{c}' AS "column", count(DISTINCT {c}) AS nd, count({c}) AS nn,
        count(*) - count({c}) AS missing FROM onl''')}),
num AS ({U(_ALERT_NUM, '''SELECT '{c}' AS "column", sum(CASE WHEN {c} = 0 THEN 1 ELSE 0 END) AS zeros,
        avg(power({c} - (SELECT avg({c}) FROM onl), 3)) / power(var_pop({c}), 1.5) AS skew FROM onl''')}),
ent AS ({U(_ALERT_CAT, '''SELECT '{c}' AS "column", count(*) AS k, -sum(cnt / tot * ln(cnt / tot)) AS h
        FROM (SELECT count(*) AS cnt, sum(count(*)) OVER () AS tot FROM onl WHERE {c} IS NOT NULL GROUP BY {c})''')}),
pr AS ({'''
UNION ALL
'''.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM onl"
         for i, a in enumerate(_ALERT_NUM) for b in _ALERT_NUM[i + 1:])})
SELECT "column", 'constant' AS alert FROM st WHERE nd = 1
UNION ALL SELECT "column", 'unique' FROM st WHERE nd = nn
UNION ALL SELECT "column", 'missing' FROM st WHERE missing > 0
UNION ALL SELECT "column", 'high_cardinality' FROM st WHERE "column" IN ('o_orderstatus', 'o_orderpriority') AND nd > 50
UNION ALL SELECT "column", 'imbalanced' FROM ent WHERE k > 1 AND 1 - h / ln(k) > 0.5
UNION ALL SELECT "column", 'zeros' FROM num WHERE zeros > 0.1 * (SELECT count(*) FROM onl)
UNION ALL SELECT "column", 'skewed' FROM num WHERE abs(skew) > 20
UNION ALL SELECT DISTINCT c AS "column", 'high_correlation' FROM (
   SELECT a AS c FROM pr WHERE abs(r) > 0.9 UNION ALL SELECT b FROM pr WHERE abs(r) > 0.9)""")
def d14_profile_alerts(spark, sf):
    return finish(P.profile_alerts(orders_with_nulls(spark, sf), _ALERT_NUM, _ALERT_CAT))


@query("d15_profile_interactions", f"""
WITH {O.T1}, r AS (SELECT min(value) AS x0, max(value) AS x1, min(k) AS y0, max(k) AS y1 FROM t1)
SELECT 'value' AS column_x, 'k' AS column_y,
  CAST(CASE WHEN x1 > x0 THEN least(floor((value - x0) / (x1 - x0) * 10) + 1, 10) ELSE 1 END AS BIGINT) AS bin_x,
  CAST(CASE WHEN y1 > y0 THEN least(floor((k - y0) / (y1 - y0) * 10) + 1, 10) ELSE 1 END AS BIGINT) AS bin_y,
  CAST(count(*) AS BIGINT) AS count
FROM t1, r GROUP BY ALL""")
def d15_profile_interactions(spark, sf):
    return finish(P.profile_interactions(t1_events(spark, sf), "value", "k", bins=10))


@query("d16_profile_sample", """
SELECT * FROM (SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, 'first' AS position FROM orders ORDER BY o_orderkey LIMIT 10)
UNION ALL
SELECT * FROM (SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, 'last' AS position FROM orders ORDER BY o_orderkey DESC LIMIT 10)""")
def d16_profile_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return finish(P.profile_sample(o, "o_orderkey", 10))


_D17 = """SELECT '{c}' AS "column", CAST(min(length(t)) AS BIGINT) AS min_length, round(avg(length(t)), 6) AS mean_length,
  CAST(max(length(t)) AS BIGINT) AS max_length, CAST(min(w) AS BIGINT) AS min_words, round(avg(w), 6) AS mean_words,
  CAST(max(w) AS BIGINT) AS max_words, CAST(sum(w) AS BIGINT) AS total_words
FROM (SELECT text AS t, len(regexp_split_to_array(text, '[ \n]+')) AS w FROM {tab} WHERE text IS NOT NULL)"""


@query("d17_profile_text", "\nUNION ALL\n".join(
    _D17.format(c=f"{t}.text", tab=t) for t in ["documents", "conversations", "benchmark"]))
def d17_profile_text(spark, sf):
    outs = []
    for t in ["documents", "conversations", "benchmark"]:
        df = table(spark, sf, t).select(F.col("text").alias(f"{t}.text"))
        outs.append(P.profile_text(df, [f"{t}.text"]))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return finish(out)


@query("d18_profile_datetime", """
SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min,
       strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max,
       round(epoch(max(o_orderdate) - min(o_orderdate)) / 86400.0, 6) AS span_days FROM orders""")
def d18_profile_datetime(spark, sf):
    return finish(P.profile_datetime(table(spark, sf, "orders"), "o_orderdate")[0])


@query("d18_rows_per_month", """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS rows
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1""")
def d18_rows_per_month(spark, sf):
    return finish(P.profile_datetime(table(spark, sf, "orders"), "o_orderdate")[1])


@query("a6_write_profile")
def a6_write_profile(spark, sf):
    """Every profile section of ``part`` written as Parquet and read back: (section, rows)."""
    import uuid

    from sparkselect.session import checkpoint_dir
    from sparkselect.sources.io import write_profile
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand", "p_type")
    sections = P.profile(part, key="p_partkey")
    base = f"{checkpoint_dir(spark).rstrip('/')}/profile-{uuid.uuid4().hex[:10]}"
    paths = write_profile(sections, base)
    counts = [(name, spark.read.parquet(p).count()) for name, p in zip(sections, paths)]
    return spark.createDataFrame(counts, "section string, rows bigint")


# ------------------------------------------------------------------ cases outside the first fixtures
_KC = [("c_acctbal", "c_custkey"), ("c_acctbal", "c_nationkey")]


@query("d11_kendall_continuous", "\nUNION ALL\n".join(_D11.format(a=a, b=b).replace("lineitem", "customer") for a, b in [*_KC, ("c_custkey", "c_nationkey")]))
def d11_kendall_continuous(spark, sf):
    """Columns of nearly as many values as rows."""
    return finish(P.profile_kendall(table(spark, sf, "customer"), ["c_acctbal", "c_custkey", "c_nationkey"]))


_BIG = 2 ** 53


@query("d2_big_integers", f"""
SELECT 'big' AS "column", count(DISTINCT event_id + {_BIG}) AS "distinct" FROM events""")
def d2_big_integers(spark, sf):
    """Integers beyond 2^53, of which several share a double."""
    big = table(spark, sf, "events").select((F.col("event_id") + _BIG).alias("big"))
    return finish(P.profile_numeric(big, ["big"], with_mad=False).select("column", "distinct"))


@query("d13_big_integers", f"""
SELECT 'big' AS "column", side, rank, round(CAST(x AS DOUBLE), 6) AS value,
       CAST(x - CAST(CAST(x AS DOUBLE) AS HUGEINT) AS BIGINT) AS rest, count FROM (
  SELECT 'min' AS side, event_id + {_BIG} AS x, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS rank,
         CAST(count(*) AS BIGINT) AS count FROM events GROUP BY event_id
  UNION ALL
  SELECT 'max', event_id + {_BIG}, CAST(row_number() OVER (ORDER BY event_id DESC) AS BIGINT),
         CAST(count(*) AS BIGINT) FROM events GROUP BY event_id) WHERE rank <= 5""")
def d13_big_integers(spark, sf):
    big = table(spark, sf, "events").select((F.col("event_id") + _BIG).alias("big"))
    return finish(P.profile_extremes(big, ["big"], n=5))
