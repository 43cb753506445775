"""Registered queries of the trees grown by the library itself, with DuckDB twins of first trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sparkselect.operators import split as S
from sparkselect.operators.boosting import LeafBoostingClassifier, SoftmaxBoostingClassifier
from sparkselect.operators.extra_trees import ExtraTreesClassifier
from sparkselect.operators.models import make_estimator
from sparkselect.operators.trees import Tree, shapley_table
from sparkselect.plans import oracle_sql as O
from sparkselect.plans.common import assemble, finish
from sparkselect.plans.registry import query
from sparkselect.plans.tasks import t1_events, t3_embeddings

_T1_COLS = ["value", "k", "h"]


def _t1(spark, sf):
    df = assemble(t1_events(spark, sf), _T1_COLS).withColumn("label", F.col("y").cast("double"))
    return S.holdout(df, "event_id")


def _heap(tree: Tree) -> list[tuple[int, int]]:
    """(node, its number when the children of i are 2i + 1 and 2i + 2)."""
    out, stack = [], [(0, 0)]
    while stack:
        node, at = stack.pop()
        out.append((node, at))
        if tree.feature[node] >= 0:
            stack += [(int(tree.right[node]), 2 * at + 2), (int(tree.left[node]), 2 * at + 1)]
    return out


# ------------------------------------------------------------------ F8: first tree, best leaf first
_SPLITS = 7


def _best_sql(name: str, rows: str, feats: str, keys: str, gain: str, least: int) -> str:
    """CTE ``name``: the best split of every node of ``rows`` (keys, id, g, c); ``gain`` uses gl, nl, gr, nr, g, n."""
    on = " AND ".join(f"h.{k} = t.{k}" for k in keys.split(", "))
    return f"""
{name}_t AS (SELECT {keys}, sum(g) AS g, count(*) AS n FROM {rows} GROUP BY {keys}),
{name}_h AS (SELECT {keys}, f, v, sum(sum(g)) OVER w AS gl, sum(count(*)) OVER w AS nl FROM {rows} JOIN {feats} USING (id)
  GROUP BY {keys}, f, v WINDOW w AS (PARTITION BY {keys}, f ORDER BY v)),
{name}_c AS (SELECT h.*, t.g, t.n, t.g - gl AS gr, t.n - nl AS nr FROM {name}_h h JOIN {name}_t t ON {on}),
{name}_g AS (SELECT *, round({gain}, 9) AS gain FROM {name}_c WHERE nl >= {least} AND nr >= {least}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY gain DESC, f, v) AS rk FROM {name}_g WHERE gain > 1e-9) WHERE rk = 1)"""


def _first_tree_sql() -> str:
    out = [f"""WITH {O.T1},
tr AS (SELECT event_id AS id, value, CAST(k AS DOUBLE) AS k, CAST(h AS DOUBLE) AS h, y FROM t1 WHERE {O.is_train('event_id')}),
fe AS (SELECT id, 0 AS f, value AS v FROM tr UNION ALL SELECT id, 1, k FROM tr UNION ALL SELECT id, 2, h FROM tr),
p0 AS (SELECT avg(y) AS p FROM tr), r0 AS (SELECT id, 0 AS node, y - p AS g FROM tr, p0)"""]
    gain = "(SELECT gl * gl / nl + gr * gr / nr - g * g / n) / (SELECT p * (1 - p) FROM p0)"
    for i in range(_SPLITS):
        out.append(_best_sql(f"b{i}", f"r{i}", "fe", "node", gain, 20))
        out.append(f"""
s{i} AS (SELECT * FROM b{i} ORDER BY gain DESC, node LIMIT 1),
r{i + 1} AS (SELECT r.id, CASE WHEN s.node IS NULL OR r.node <> s.node THEN r.node WHEN fe.v <= s.v THEN {2 * i + 1} ELSE {2 * i + 2} END AS node, r.g
  FROM r{i} r LEFT JOIN s{i} s ON true LEFT JOIN fe ON fe.id = r.id AND fe.f = s.f)""")
    parts = [f"SELECT CAST({i} AS BIGINT) AS step, CAST(f AS BIGINT) AS feature, round(v, 6) AS threshold, round(gain, 6) AS gain, CAST(nl AS BIGINT) AS n_left, CAST(nr AS BIGINT) AS n_right FROM s{i}"
             for i in range(_SPLITS)]
    return ",".join(out) + "\n" + " UNION ALL ".join(parts)


@query("f8_first_tree", _first_tree_sql())
def f8_first_tree(spark, sf):
    """The first tree of the light boosting: its splits in the order in which the leaves were chosen."""
    tr, _ = _t1(spark, sf)
    model = LeafBoostingClassifier(maxIter=1, numLeaves=_SPLITS + 1, maxBins=65_000, everyCut=True).fit(tr)
    (tree, *_), _, _ = model.tree_arrays()
    gain = model.fitted()[:, 8]
    front, rows = [0], []
    while any(tree.feature[n] >= 0 for n in front):
        node = min((n for n in front if tree.feature[n] >= 0), key=lambda n: -gain[n])
        front.remove(node)
        left, right = int(tree.left[node]), int(tree.right[node])
        front += [left, right]
        rows.append((len(rows), int(tree.feature[node]), float(tree.threshold[node]), float(gain[node]), int(tree.cover[left]), int(tree.cover[right])))
    return finish(spark.createDataFrame(rows, "step long, feature long, threshold double, gain double, n_left long, n_right long"))


# ------------------------------------------------------------------ F7: first round of ten classes
_LEAST, _DEPTH = 20, 3


def _softmax_sql() -> str:
    out = [f"""WITH tr AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {O.is_train('vec_id')}),
cl AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS c, count(*) / sum(count(*)) OVER () AS p, count(*) OVER () AS k FROM tr GROUP BY label),
fe AS (SELECT id, unnest(range(len(e))) AS f, unnest(e) AS v FROM tr),
r0 AS (SELECT id, c, 0 AS node, CAST(tr.label = cl.label AS INT) - p AS g FROM tr, cl)"""]
    gain = "gl * gl / nl + gr * gr / nr - g * g / n"
    for i in range(_DEPTH):
        out.append(_best_sql(f"b{i}", f"r{i}", "fe", "c, node", gain, _LEAST))
        out.append(f"""
r{i + 1} AS (SELECT r.id, r.c, CASE WHEN s.node IS NULL THEN -1 WHEN fe.v <= s.v THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node, r.g
  FROM r{i} r LEFT JOIN b{i} s ON s.c = r.c AND s.node = r.node LEFT JOIN fe ON fe.id = r.id AND fe.f = s.f)""")
    nodes = [f"SELECT c, node, f AS feature, v AS threshold FROM b{i}" for i in range(_DEPTH)]
    every = " UNION ALL ".join(f"SELECT * FROM r{i} WHERE node >= 0" for i in range(_DEPTH + 1))
    return ",".join(out) + f""",
sp AS ({" UNION ALL ".join(nodes)}), al AS ({every}),
st AS (SELECT c, node, sum(g) AS g, count(*) AS n FROM al GROUP BY c, node)
SELECT CAST(st.c AS BIGINT) AS class, CAST(st.node AS BIGINT) AS node, CAST(coalesce(feature, -1) AS BIGINT) AS feature, round(coalesce(threshold, 0), 6) AS threshold,
       CAST(n AS BIGINT) AS n, round(CASE WHEN feature IS NULL THEN 0.1 * (k - 1) / k * g / (n * p * (1 - p)) ELSE 0 END, 6) AS value
FROM st JOIN cl USING (c) LEFT JOIN sp ON sp.c = st.c AND sp.node = st.node"""


@query("f7_softmax_first_round", _softmax_sql())
def f7_softmax_first_round(spark, sf):
    """All nodes of the ten trees of the first round, one a class, on every cut point."""
    tr, _ = S.holdout(t3_embeddings(spark, sf).withColumn("label", F.col("y").cast("double")), "vec_id")
    model = SoftmaxBoostingClassifier(maxIter=1, maxDepth=_DEPTH, minRows=_LEAST, maxBins=65_000, everyCut=True).fit(tr)
    trees, _, _ = model.tree_arrays()
    rows = [(c, at, int(t.feature[n]), float(t.threshold[n]), int(t.cover[n]), float(t.value[n, c])) for c, t in enumerate(trees) for n, at in _heap(t)]
    return finish(spark.createDataFrame(rows, "class long, node long, feature long, threshold double, n long, value double"))


@query("f7_gbc_multiclass_ovr")
def f7_gbc_multiclass_ovr(spark, sf):
    """Gradient boosting of all ten classes with default rounds (K trees a round; no longer one-vs-rest)."""
    tr, te = S.holdout(t3_embeddings(spark, sf).withColumn("label", F.col("y").cast("double")), "vec_id")
    model = make_estimator("gbc", n_classes=10).fit(tr)
    return finish(model.transform(te).select("vec_id", F.col("prediction").cast("bigint")))


# ------------------------------------------------------------------ F6: roots of all trees
_TREES, _SEED = 20, 123


def _roots_sql() -> str:
    def part(first, n):
        return f"CAST('0x' || substr(md5('{_SEED}:' || t || ':0:' || f), {first}, {n}) AS BIGINT) / 4294967296.0"
    return f"""WITH {O.T1},
tr AS (SELECT event_id AS id, value, CAST(k AS DOUBLE) AS k, CAST(h AS DOUBLE) AS h, y FROM t1 WHERE {O.is_train('event_id')}),
fe AS (SELECT id, y, 0 AS f, value AS v FROM tr UNION ALL SELECT id, y, 1, k FROM tr UNION ALL SELECT id, y, 2, h FROM tr),
rg AS (SELECT f, min(v) AS low, max(v) AS high, count(*) AS n, sum(y) AS n1 FROM fe GROUP BY f),
dr AS (SELECT t, f, n, n1, low + {part(1, 8)} * (high - low) AS cut, row_number() OVER (PARTITION BY t ORDER BY {part(9, 8)}, f) AS r FROM rg, range({_TREES}) x(t)),
lw AS (SELECT dr.t, dr.f, any_value(cut) AS cut, any_value(n) AS n, any_value(n1) AS n1, count(*) AS l, sum(fe.y) AS l1
       FROM dr JOIN fe ON fe.f = dr.f AND fe.v <= dr.cut WHERE r <= 2 GROUP BY dr.t, dr.f),
gi AS (SELECT *, round((n - (n1 * n1 + (n - n1) * (n - n1)) / n) - (l - (l1 * l1 + (l - l1) * (l - l1)) / l)
                       - ((n - l) - ((n1 - l1) * (n1 - l1) + (n - l - n1 + l1) * (n - l - n1 + l1)) / (n - l)), 9) AS gain FROM lw WHERE l < n)
SELECT CAST(t AS BIGINT) AS tree, CAST(f AS BIGINT) AS feature, round(cut, 6) AS threshold, round(gain, 6) AS gain, CAST(l AS BIGINT) AS n_left
FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY gain DESC, f) AS rk FROM gi) WHERE rk = 1"""


@query("f6_first_level", _roots_sql())
def f6_first_level(spark, sf):
    """The first level of twenty extra trees: two candidate features a node, one random cut each."""
    tr, _ = _t1(spark, sf)
    model = ExtraTreesClassifier(numTrees=_TREES, maxDepth=1, numCandidates=2, seed=_SEED).fit(tr)
    trees, _, _ = model.tree_arrays()
    gain = model.fitted()[model.fitted()[:, 1] >= 0, 6]
    rows = [(i, int(t.feature[0]), float(t.threshold[0]), float(g), int(t.cover[t.left[0]])) for (i, t), g in zip(enumerate(trees), gain, strict=True)]
    return finish(spark.createDataFrame(rows, "tree long, feature long, threshold double, gain double, n_left long"))


# ------------------------------------------------------------------ I1: exact Shapley values of tree models
@query("i1_tree_shapley")
def i1_tree_shapley(spark, sf):
    """Exact Shapley values of a random forest's class shares for every test row."""
    tr, te = _t1(spark, sf)
    model = make_estimator("rf", numTrees=20, maxDepth=5).fit(tr)
    return finish(shapley_table(model, te, _T1_COLS, "event_id").where("output = 1"))
