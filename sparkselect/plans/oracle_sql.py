"""DuckDB texts for the correctness gate, written from the definitions.

They share a few building blocks (task views, split predicate, the metric
formulas) so that every registered query has an independent SQL twin.
"""

from __future__ import annotations

T1 = """t1 AS (
  SELECT event_id, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
         hour(ts) AS h, event_type,
         CASE WHEN (value + CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) > 90)
                   <> (CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 2) AS BIGINT) < 20)
              THEN 1 ELSE 0 END AS y
  FROM events)"""

T2 = """t2 AS (
  SELECT l.doc_id,
         CAST(d.n_chars AS DOUBLE) AS c,
         CAST(len(regexp_split_to_array(d.text, '[ \n]+')) AS DOUBLE) AS w,
         CAST(length(regexp_replace(d.text, '[A-Za-zÀ-ÿ .,\n]', '', 'g')) AS DOUBLE) AS np,
         CAST(len(list_distinct(regexp_split_to_array(d.text, '[ \n]+'))) AS DOUBLE) AS u,
         d.lang, d.source, l.quality AS y
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def bucket(key: str, seed: int = 786) -> str:
    return f"CAST('0x' || substr(md5(concat('{seed}:', CAST({key} AS VARCHAR))), 1, 8) AS BIGINT)"


def is_train(key: str, fraction: float = 0.8, seed: int = 786) -> str:
    return f"({bucket(key, seed)} < {fraction} * 4294967296)"


def metrics_from(src: str, by: str = "model") -> str:
    """CTEs ending in ``met`` with (by, n, accuracy, auc, recall, precision, f1, kappa, mcc)
    from a relation ``src`` with columns (by, y, yhat)."""
    return f"""
cc AS (SELECT {by}, CAST(y AS DOUBLE) AS y, CAST(yhat AS DOUBLE) AS yhat, CAST(count(*) AS DOUBLE) AS cnt
       FROM {src} WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY ALL),
cb AS (SELECT {by}, sum(cnt) AS n,
              sum(CASE WHEN y = yhat THEN cnt ELSE 0 END) AS correct,
              sum(CASE WHEN y = 1 AND yhat = 1 THEN cnt ELSE 0 END) AS tp,
              sum(CASE WHEN y = 0 AND yhat = 1 THEN cnt ELSE 0 END) AS fp,
              sum(CASE WHEN y = 1 AND yhat = 0 THEN cnt ELSE 0 END) AS fn,
              sum(CASE WHEN y = 0 AND yhat = 0 THEN cnt ELSE 0 END) AS tn,
              max(CASE WHEN y NOT IN (0, 1) OR yhat NOT IN (0, 1) THEN 1 ELSE 0 END) AS nonbin,
              count(DISTINCT y) AS ny
       FROM cc GROUP BY {by}),
ct AS (SELECT {by}, y AS cls, sum(cnt) AS t FROM cc GROUP BY ALL),
cp AS (SELECT {by}, yhat AS cls, sum(cnt) AS p FROM cc GROUP BY ALL),
ck AS (SELECT {by}, sum(coalesce(t, 0) * coalesce(p, 0)) AS stp, sum(coalesce(p, 0) * coalesce(p, 0)) AS spp,
              sum(coalesce(t, 0) * coalesce(t, 0)) AS stt
       FROM ct FULL JOIN cp USING ({by}, cls) GROUP BY {by}),
met AS (
  SELECT {by}, CAST(n AS BIGINT) AS n,
         correct / n AS accuracy,
         CASE WHEN nonbin = 0 AND ny = 2 THEN
              ((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END)
             + (CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END)) / 2 END AS auc,
         CASE WHEN nonbin = 0 THEN CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END END AS recall,
         CASE WHEN nonbin = 0 THEN CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END END AS precision,
         CASE WHEN nonbin = 0 THEN CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END END AS f1,
         CASE WHEN stp / (n * n) <> 1 THEN (correct / n - stp / (n * n)) / (1 - stp / (n * n)) END AS kappa,
         CASE WHEN (n * n - stt) * (n * n - spp) > 0
              THEN (correct * n - stp) / sqrt((n * n - stt) * (n * n - spp)) ELSE 0 END AS mcc
  FROM cb JOIN ck USING ({by}))"""


def rounded(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


METRIC_COLS = ["accuracy", "auc", "recall", "precision", "f1", "kappa", "mcc"]

ORDERS_NULLS = """onl AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""

T4 = """t4 AS (SELECT o.*, c.c_nationkey, c.c_acctbal, c.c_mktsegment
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


def union_per_column(cols: list[str], template: str) -> str:
    """``template`` formatted with {c} for each column, joined by UNION ALL."""
    return "\nUNION ALL\n".join(template.format(c=c) for c in cols)
