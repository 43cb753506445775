"""Exact top-k inner-product search with two cover trees.

Vectors become integers, floor(SCALE * x). Equal vectors are one point with its smallest
k + 1 ids (more can never be in a result of k rows), so that a very common vector costs as
much as any other. Points are dealt by hash into blocks of at most about BLOCK points, and each
block is indexed by a cover tree: a node covers its points with a ball around one of them, its
children are a net of that ball at 1 / BASE of the radius (centers further apart than that,
each point with a center that covers it). Queries are indexed alike, in groups.

Search: for a node of each tree, no product exceeds
    <q, r> + radius(q) |r| + radius(r) |q| + radius(q) radius(r)
over their centers q and r; the pair is pruned if that is below the worst kth score of the query
node's group. A first round searches one block for every query group, which gives each query
a kth score to start from; a second round searches all blocks. Products are exact: they are taken
in doubles only if every sum stays below 2 ** 53, else in 64-bit integers.

Defined results: rows with a null id or a null, empty or non-finite vector (or component) take
no part; vectors of different lengths don't meet; a query's own row is left out once, so that a
repeated row finds its copy; ties go to the smaller id; fewer than k candidates give all of
them; an empty table gives an empty result. Vectors whose lengths multiply to 2 ** 62 or more once scaled raise
a ValueError, as their products may not fit a 64-bit integer.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, written

SCALE = 64
TOP = 20
QUERY_EVERY = 20
BLOCK, GROUP = 4096, 1024
BASE, LEAF = 1.3, 48
#: Below any score; the product of the greatest lengths of two blocks must stay below MOST.
NONE = -(1 << 62)
MOST = 2.0 ** 62


class CoverTree:
    """Points in tree order and nodes as arrays; the children of a node are consecutive."""

    def __init__(self, points: np.ndarray):
        points = np.ascontiguousarray(points, float)
        n = len(points)
        order = np.arange(n)
        center, radius, low, high, first, last = [0], [0.0], [0], [n], [0], [0]
        norms = np.einsum("ij,ij->i", points, points)

        def distances(own: np.ndarray, c: int) -> np.ndarray:
            return np.sqrt(np.maximum(norms[own] + norms[c] - 2 * (points[own] @ points[c]), 0.0))

        i = 0
        while i < len(center):
            own = order[low[i]:high[i]]
            away = distances(own, center[i]) if len(own) else np.empty(0)
            radius[i] = float(away.max(initial=0.0))
            if len(own) > LEAF and radius[i] > 1e-6:
                scale, left, parts = radius[i] / BASE, own, []
                c, d = center[i], away
                while len(left):
                    near = d <= scale
                    near[np.argmin(d)] = True  # rounding: the center is with itself
                    parts.append((c, left[near]))
                    left, away = left[~near], away[~near]
                    if len(left):
                        c = int(left[np.argmax(away)])
                        d = distances(left, c)
                if len(parts) > 1:
                    first[i], at = len(center), low[i]
                    for c, part in parts:
                        order[at:at + len(part)] = part
                        center.append(int(c))
                        radius.append(0.0)
                        low.append(at)
                        high.append(at + len(part))
                        first.append(0)
                        last.append(0)
                        at += len(part)
                    last[i] = len(center)
            i += 1
        self.order = order
        self.points = points[order]
        self.centers = points[center] if n else np.empty((0, points.shape[1]))
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.centers, self.centers))
        self.radius, self.low, self.high = np.array(radius), np.array(low), np.array(high)
        self.first, self.last = np.array(first), np.array(last)


class Best:
    """The best k + 1 (score, point) of each query; ties go to the point with the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k = k
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.point = np.full((n, k), -1)
        self.floor = floor.copy()  # no score below it can be in the result

    def add(self, query: int, score: np.ndarray, ids: np.ndarray, point: np.ndarray) -> None:
        good = score >= self.floor[query]
        if not good.any():
            return
        s, i, p = (np.concatenate(x) for x in ((self.score[query], score[good]), (self.id[query], ids[good]), (self.point[query], point[good])))
        best = np.lexsort((i, -s))[:self.k]
        self.score[query], self.id[query], self.point[query] = s[best], i[best], p[best]
        self.floor[query] = max(self.floor[query], self.score[query, -1])


def dual_search(queries: CoverTree, data: CoverTree, ids: np.ndarray, best: Best) -> int:
    """Fill ``best`` (rows in the tree order of the queries); ``ids`` are the data points' smallest
    ids in tree order. Returns how many products were taken at leaves."""
    exact = float(np.abs(queries.points).max(initial=0)) * float(np.abs(data.points).max(initial=0)) * max(1, data.points.shape[1]) < 2.0 ** 52
    q_points, d_points = (queries.points, data.points) if exact else (queries.points.astype(np.int64), data.points.astype(np.int64))
    taken = 0
    stack = [(0, np.array([0]))] if len(queries.points) and len(data.points) else []
    while stack:
        q, nodes = stack.pop()
        lo, hi = queries.low[q], queries.high[q]
        rq = queries.radius[q]
        top = data.centers[nodes] @ queries.centers[q] + rq * data.norms[nodes] + data.radius[nodes] * (queries.norms[q] + rq)
        top += 1e-9 * (np.abs(top) + queries.norms[q] * data.norms[nodes]) + 1e-6
        alive = top >= best.floor[lo:hi].min()
        nodes, top = nodes[alive], top[alive]
        if not len(nodes):
            continue
        inner = data.last[nodes] > 0
        if queries.last[q] > 0 and (not inner.any() or rq >= data.radius[nodes].max()):
            stack += [(c, nodes) for c in range(queries.first[q], queries.last[q])]
            continue
        if inner.any():  # open the balls of the data that promise most, keep its leaves
            opened = [np.arange(data.first[i], data.last[i]) for i in nodes[inner]]
            stack.append((q, np.concatenate([nodes[~inner], *opened])))
            continue
        if queries.last[q] > 0:
            stack += [(c, nodes) for c in range(queries.first[q], queries.last[q])]
            continue
        nodes = nodes[np.argsort(-top, kind="stable")]
        for s in range(0, len(nodes), 32):  # best leaves first, so that later ones can be pruned
            own = nodes[s:s + 32]
            if s:
                bound = data.centers[own] @ queries.centers[q] + rq * data.norms[own] + data.radius[own] * (queries.norms[q] + rq)
                own = own[bound + 1e-9 * (np.abs(bound) + queries.norms[q] * data.norms[own]) + 1e-6 >= best.floor[lo:hi].min()]
                if not len(own):
                    continue
            at = np.concatenate([np.arange(data.low[i], data.high[i]) for i in own])
            product = q_points[lo:hi] @ d_points[at].T
            taken += product.size
            score = np.rint(product).astype(np.int64) if exact else product
            for j in np.flatnonzero((score >= best.floor[lo:hi, None]).any(axis=1)):
                best.add(lo + j, score[j], ids[at], at)
    return taken


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v: array<long>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    return rows.where((F.size("x") > 0) & ~bad).select("id", F.transform("x", lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _trees(with_ids: bool):
    def build(table: pa.Table) -> pa.Table:
        tree = CoverTree(_matrix(table.column("v")))
        ids = table.column("ids").combine_chunks().to_pylist() if with_ids else None
        keys = table.column("key").to_numpy()[tree.order]
        body = {"tree": tree, "key": keys, "ids": [ids[i] for i in tree.order] if with_ids else None}
        return pa.table({"dim": [tree.points.shape[1]], "slot": [table.column("slot")[0].as_py()], "blob": [pickle.dumps(body, protocol=5)]},
                        schema=pa.schema([("dim", pa.int32()), ("slot", pa.int32()), ("blob", pa.binary())]))

    return build


def _longest(tree: CoverTree) -> float:
    return float(np.sqrt((tree.points.astype(float) ** 2).sum(axis=1).max()))


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_blob, d_blob, keys, floors in zip(*(batch.column(c) for c in ("q_blob", "blob", "known", "floors")), strict=True):
                q, d = pickle.loads(q_blob.as_py()), pickle.loads(d_blob.as_py())
                if _longest(q["tree"]) * _longest(d["tree"]) >= MOST:
                    raise ValueError("inner products of these vectors may not fit a 64-bit integer")
                floor = np.full(len(q["key"]), NONE)
                if keys.as_py():
                    known = dict(zip(keys.as_py(), floors.as_py(), strict=True))
                    floor = np.array([known.get(x, NONE) for x in q["key"].tolist()], np.int64)
                best = Best(len(q["key"]), k, floor)
                dual_search(q["tree"], d["tree"], np.array([i[0] for i in d["ids"]], np.int64), best)
                rows, ids, scores = [], [], []
                for j, key in enumerate(q["key"].tolist()):
                    own = [(-int(s), i) for s, p in zip(best.score[j], best.point[j], strict=True) if p >= 0 for i in d["ids"][p]]
                    own = sorted(own)[:k]
                    if own:
                        rows.append(key)
                        ids.append([i for _, i in own])
                        scores.append([-s for s, _ in own])
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.int64()))], names=["key", "ids", "scores"])

    return search


_FOUND = "key long, ids array<long>, scores array<long>"


def _slots(rows: DataFrame, size: int) -> Column:
    """Number of hash slots that hold about ``size`` rows each."""
    return max(1, -(-rows.count() // size))


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(key, id, score): the best k of each query point over all blocks."""
    rows = found.select("key", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("key", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k greatest products of every query row; ``vectors``
    is (id, v) and ``is_query`` a condition on it."""
    keep = k + 1  # a query's own row may be among them
    rows = written(vectors.withColumn("key", F.xxhash64("v")), "vectors")
    first = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep)
    points = written(few.groupBy("v").agg(F.first("key").alias("key"), F.array_sort(F.collect_list("id")).alias("ids")), "points")
    asked = written(rows.where(is_query).select("id", "v"), "queries")
    q_points = written(asked.select("v").distinct().withColumn("key", F.xxhash64("v")), "query-points")

    dealt = lambda df, n, seed: df.withColumn("dim", F.size("v")).withColumn("slot", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n)).cast("int"))
    blocks, groups = _slots(points, BLOCK), _slots(q_points, GROUP)
    schema = "dim int, slot int, blob binary"
    data = written(dealt(points, blocks, 1).groupBy("dim", "slot").applyInArrow(_trees(True), schema), "data-trees")
    query = written(dealt(q_points, groups, 2).groupBy("dim", "slot").applyInArrow(_trees(False), schema), "query-trees")
    query = query.withColumnRenamed("slot", "q_slot").withColumnRenamed("blob", "q_blob")
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("known", "floors")]

    one = data.groupBy("dim").agg(F.min("slot").alias("slot"))
    start = query.join(data.join(one, ["dim", "slot"]), "dim").select("q_blob", "blob", *none).repartition(F.xxhash64("q_blob"))
    found = written(start.mapInArrow(frugal(_search(keep)), _FOUND), "first-round")
    floors = found.where(F.size("scores") >= keep).select("key", F.element_at("scores", -1).alias("floor"))
    slot_of = dealt(q_points, groups, 2).select("dim", F.col("slot").alias("q_slot"), "key")
    known = floors.join(slot_of, "key").groupBy("dim", "q_slot").agg(F.collect_list("key").alias("known"), F.collect_list("floor").alias("floors"))
    pairs = query.join(known, ["dim", "q_slot"], "left").join(data, "dim").select("q_blob", "blob", "known", "floors", F.xxhash64("slot", "q_slot").alias("h"))
    every = written(pairs.repartition("h").drop("h").mapInArrow(frugal(_search(keep)), _FOUND), "second-round")

    best = _merged(every, keep).select("key", F.col("id").alias("vec_id"), "score")
    asked = asked.withColumn("key", F.xxhash64("v")).withColumn("copy", F.row_number().over(Window.partitionBy("key", "id").orderBy("id")))
    rows = asked.select(F.col("id").alias("query_id"), "copy", "key").join(best, "key")
    seen = F.row_number().over(Window.partitionBy("query_id", "copy", "vec_id").orderBy("score"))
    others = rows.withColumn("seen", seen).where((F.col("vec_id") != F.col("query_id")) | (F.col("seen") > 1))
    order = Window.partitionBy("query_id", "copy", "key").orderBy(F.desc("score"), "vec_id")
    return others.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_frame(embeddings: DataFrame) -> DataFrame:
    return top_k(scaled(embeddings), F.col("id") % QUERY_EVERY == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
) WHERE rank <= 20
"""
