"""Exact k nearest neighbours (F10) and SMOTE (E14) by pivot partitions.

Base rows are cut into the cells of pivots and queries go only to the cells that
can hold one of their neighbours (``pivots``); base rows that fit one block need no
cells. Each block of queries meets a block of base rows in one group of a cogrouped
``applyInPandas`` (no cross join), NumPy computes the distances inside the
task and only the k best base rows per query leave it. A final window per
query keeps the k best of its candidates. Block sizes are bounded, so
no task holds more than one query block and one base block. Where the data have
no structure the bounds exclude little, and the work is n_query x n_base.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from sparkselect.functions.hashing import SESSION_SEED, hash_small, md5_order
from sparkselect.functions.ranking import row_number_exact
from sparkselect.operators.estimators import CustomEstimator, CustomModel, label_classes
from sparkselect.operators.persist import CompositePersistence
from sparkselect.operators.pivots import pivot_blocks

BLOCK_ROWS = 50_000
#: Distances that a task holds at a time, and queries measured together.
MATRIX_CELLS = 2_000_000
QUERY_ROWS = 256
#: Blocks of at most BOX_DIMENSIONS dimensions are cut into boxes of about BOX_ROWS rows; where
#: values reach BOX_RANGE, squares leave the doubles and all rows are measured.
BOX_DIMENSIONS = 16
BOX_ROWS = 256
BOX_RANGE = 1e150
#: Classes whose counts are brought to the driver at most.
MAX_CLASSES = 10_000


def _boxes(X: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers cut at medians of the widest dimension until about ``rows`` are left in each part."""
    parts, done = [np.arange(len(X))], []
    while parts:
        at = parts.pop()
        spread = np.ptp(X[at], axis=0)
        if len(at) <= rows or not spread.max() > 0:
            done.append(at)
            continue
        at = at[np.argsort(X[at, spread.argmax()], kind="stable")]
        parts += [at[len(at) // 2:], at[:len(at) // 2]]
    return done


class _Boxes:
    """Which base rows can be among the ``m`` nearest of some queries, by the boxes they lie in."""

    def __init__(self, Xb: np.ndarray):
        self.parts = _boxes(Xb, BOX_ROWS)
        self.lo = np.stack([Xb[p].min(axis=0) for p in self.parts])
        self.hi = np.stack([Xb[p].max(axis=0) for p in self.parts])
        self.size = np.array([len(p) for p in self.parts])

    def near(self, Q: np.ndarray, m: int) -> np.ndarray:
        """Rows of all boxes that are no farther than the far corners of boxes that hold ``m`` rows."""
        least, most = np.zeros((len(Q), len(self.parts))), np.zeros((len(Q), len(self.parts)))
        for j in range(Q.shape[1]):
            q, lo, hi = Q[:, j, None], self.lo[None, :, j], self.hi[None, :, j]
            least += np.maximum(np.maximum(lo - q, q - hi), 0) ** 2
            most += np.maximum(np.abs(q - lo), np.abs(q - hi)) ** 2
        order = np.argsort(most, axis=1, kind="stable")
        held = np.cumsum(self.size[order], axis=1)
        at = (held >= m).argmax(axis=1)  # m is at most the number of rows
        limit = np.take_along_axis(most, order, axis=1)[np.arange(len(Q)), at]
        wanted = (least * (1 - 1e-9) <= limit[:, None] * (1 + 1e-9)).any(axis=0)
        return np.sort(np.concatenate([p for p, w in zip(self.parts, wanted, strict=True) if w]))


def knn_candidates(queries: DataFrame, base: DataFrame, k: int, qkey: str, bkey: str, qx: str, bx: str,
                   label: str | None = None, exclude_self: bool = False,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(qkey, bkey, dist2, [label], nb_rank) for the k nearest base rows of every query.

    Distances are squared Euclidean; ties go to the lower base key. With
    ``exclude_self`` a base row never neighbours the query with the same key (base keys
    are unique then). Null vectors and those with NaN or infinite components take no part.
    """
    qtype = queries.schema[qkey].dataType
    btype = base.schema[bkey].dataType
    q = queries.select(F.col(qkey).alias("qk"), vector_to_array(F.col(qx), "float64").alias("x"))
    bcols = [F.col(bkey).alias("bk"), vector_to_array(F.col(bx), "float64").alias("x")]
    if label:
        bcols.append(F.col(label).cast("double").alias("lab"))
    finite = F.forall("x", lambda v: F.abs(v) < float("inf"))
    q, b = q.where(finite), base.select(*bcols).where(finite)
    nb = b.count()
    if nb > block_rows:
        q, b, _ = pivot_blocks(q, b, k + exclude_self, block_rows, nb)
    else:
        qblocks = max(1, math.ceil(q.count() / block_rows))
        q = q.withColumn("qb", (F.abs(F.xxhash64("qk")) % qblocks).cast("int")).withColumn("bb", F.lit(0))
        b = b.withColumn("bb", F.lit(0)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))
    fields = [StructField("qk", qtype), StructField("bk", btype), StructField("dist2", DoubleType())]
    if label:
        fields.append(StructField("lab", DoubleType()))
    schema = StructType(fields)

    def block(qpdf: pd.DataFrame, bpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or bpdf.empty:
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in schema.fields})
        Xq = np.stack(qpdf["x"].to_numpy()).astype(float)
        Xb = np.stack(bpdf["x"].to_numpy()).astype(float)
        bk = bpdf["bk"].to_numpy()
        qk = qpdf["qk"].to_numpy()
        # the expanded form of a distance is off by at most this: rows within it of the k-th
        # distance, however many are equally far, are measured again directly
        slack = 32 * np.finfo(float).eps * max(1, Xb.shape[1])
        few = Xb.shape[1] <= BOX_DIMENSIONS and len(Xb) > max(4 * BOX_ROWS, k) and len(Xq) >= 16
        boxes = _Boxes(Xb) if few and max(np.abs(Xq).max(), np.abs(Xb).max()) < BOX_RANGE else None
        lead = np.concatenate(_boxes(Xq, 64)) if boxes else np.arange(len(Xq))  # queries that lie together share boxes

        def measured(at: np.ndarray, own: np.ndarray, X: np.ndarray) -> pd.DataFrame:
            """The k nearest of the base rows ``own``, which are ``X``, of the queries ``at``."""
            Q, keys, m = Xq[at], bk[own], min(len(own), k)
            d = Q @ X.T
            d *= -2.0
            d += (Q * Q).sum(axis=1)[:, None]
            bn = (X * X).sum(axis=1)
            d += bn[None, :]
            if exclude_self:
                d[qk[at, None] == keys[None, :]] = np.inf
            kth = np.partition(d, m - 1, axis=1)[:, m - 1]
            limit = kth + slack * ((Q * Q).sum(axis=1) + bn.max())
            rows, dist, n = [], [], []
            for i in range(len(Q)):
                near = np.flatnonzero(d[i] <= limit[i]) if np.isfinite(kth[i]) else np.flatnonzero(np.isfinite(d[i]))
                exact = ((X[near] - Q[i]) ** 2).sum(axis=1)
                best = np.lexsort((keys[near], exact))[:k]
                rows.append(own[near[best]])
                dist.append(exact[best])
                n.append(len(best))
            rows = np.concatenate(rows)
            part = {"qk": np.repeat(qk[at], n), "bk": bk[rows], "dist2": np.concatenate(dist)}
            if label:
                part["lab"] = bpdf["lab"].to_numpy()[rows]
            return pd.DataFrame(part)

        every, step = np.arange(len(Xb)), max(1, min(QUERY_ROWS, MATRIX_CELLS // len(Xb)))
        outs = []
        for s in range(0, len(Xq), 64 if boxes else step):
            at = lead[s:s + (64 if boxes else step)]
            own = boxes.near(Xq[at], min(len(Xb), k + exclude_self)) if boxes else every
            X, part = Xb[own] if boxes else Xb, max(1, MATRIX_CELLS // len(own))
            outs += [measured(at[i:i + part], own, X) for i in range(0, len(at), part)]
        return pd.concat(outs, ignore_index=True)

    cand = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInPandas(block, schema)
    w = Window.partitionBy("qk").orderBy("dist2", "bk")  # at most k x B rows per query
    best = cand.withColumn("nb_rank", F.row_number().over(w).cast("bigint")).where(F.col("nb_rank") <= k)
    return best.withColumnRenamed("qk", qkey if qkey != bkey else "qkey").withColumnRenamed("bk", bkey)


class KNNClassifier(CustomEstimator):
    """k = 5, Euclidean, majority vote; ties to the lower label, distance ties to the
    lower base key. ``baseKeyCol`` names a training key (else a content hash is used)."""

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    baseKeyCol = Param(Params._dummy(), "baseKeyCol", "training key", TypeConverters.toString)

    def __init__(self, k: int = 5, baseKeyCol: str | None = None, **kw):
        super().__init__(**kw)
        self._setDefault(k=5)
        self._set(k=k)
        if baseKeyCol:
            self._set(baseKeyCol=baseKeyCol)

    def _fit(self, df):
        label = self.getLabelCol()
        classes = label_classes(df, label)
        key = self.getOrDefault(self.baseKeyCol) if self.isDefined(self.baseKeyCol) else None
        bk = F.col(key) if key else F.sha2(F.to_json(F.struct(vector_to_array(F.col(self.getFeaturesCol())),
                                                              F.col(label))), 256)
        base = df.select(bk.alias("__bk"), F.col(self.getFeaturesCol()).alias("__bx"),
                         F.col(label).cast("double").alias("__lab"))
        m = self._copy_io(KNNModel())
        m._set(k=self.getOrDefault(self.k))
        m.set_fitted(classes, np.zeros(1))
        m.base = base
        return m


class KNNModel(CompositePersistence, CustomModel):
    k = KNNClassifier.k
    base: DataFrame | None = None
    _sub_frames = ("base",)

    def _transform(self, df):
        if self.base is None:
            raise ValueError("training rows not attached (KNNModel.base)")
        classes = self.getOrDefault(self.classes)
        k = self.getOrDefault(self.k)
        feats = self.getFeaturesCol()
        qk = F.sha2(F.to_json(vector_to_array(F.col(feats))), 256)
        keyed = df.withColumn("__qk", qk)
        queries = keyed.select("__qk", feats).dropDuplicates(["__qk"])
        cand = knn_candidates(queries, self.base, k, "__qk", "__bk", feats, "__bx", label="__lab")
        votes = cand.groupBy("__qk", "lab").agg(F.count("*").alias("__v"))
        wv = Window.partitionBy("__qk").orderBy(F.col("__v").desc(), F.col("lab").asc())
        top = votes.withColumn("__r", F.row_number().over(wv))
        per = top.groupBy("__qk").agg(
            F.max(F.when(F.col("__r") == 1, F.col("lab"))).alias(self.getPredictionCol()),
            F.map_from_entries(F.collect_list(F.struct("lab", "__v"))).alias("__m"))
        from pyspark.ml.functions import array_to_vector
        probs = F.array(*[F.coalesce(F.col("__m")[F.lit(float(c))], F.lit(0)) / F.lit(float(k)) for c in classes])
        per = per.select("__qk", self.getPredictionCol(), array_to_vector(probs).alias(self.getProbabilityCol()))
        return keyed.join(per, "__qk", "left").withColumn(self.getRawPredictionCol(), F.col(self.getProbabilityCol())) \
            .drop("__qk")


def smote(df: DataFrame, label: str, key: str, features: list[str], k: int = 5, seed: int = SESSION_SEED,
          categorical: list[str] | None = None) -> DataFrame:
    """E14 (training rows only): synthetic rows for every smaller class, up to the count of
    the largest (of several largest, the last label); a class of one row has no neighbour
    and stays as it is.

    For each row of a smaller class (the minority, of m rows) (ranked by md5(seed:key), key) c = N div m copies,
    plus one for the first N mod m rows, where N = majority - minority count.
    Copy j picks neighbour (md5(seed:key:j) first byte) mod min(k, m - 1) of its
    k nearest minority rows and the gap (next two bytes) / 65536; the new row is
    x + gap (x_nb - x). Categorical values are copied. Returns only the new
    rows with ``key`` = '<key>#<j>' and ``copy`` = j.
    """
    counts = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label}")
    counts.sort(key=lambda r: (r["count"], r[label]))
    parts = [_smote_class(df, label, key, features, r[label], r["count"], counts[-1]["count"] - r["count"], k, seed, categorical)
             for r in counts[:-1] if r["count"] >= 2 and r["count"] < counts[-1]["count"]]
    if not parts:
        cols = [F.col(key).cast("string").alias(key), F.lit(0).cast("bigint").alias("copy"), *[F.col(c).cast("double").alias(c) for c in features],
                *(categorical or []), F.col(label)]
        return df.select(*cols).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _smote_class(df: DataFrame, label: str, key: str, features: list[str], minority, m: int, need: int, k: int, seed: int,
                 categorical: list[str] | None) -> DataFrame:
    """The synthetic rows of one class."""
    from pyspark.ml.feature import VectorAssembler
    kk = min(k, m - 1)
    from sparkselect.session import materialize
    cats = list(categorical or [])
    mino = VectorAssembler(inputCols=features, outputCol="__x").transform(
        df.where(F.col(label) == minority).select(key, *features, *cats, label))
    # the minority rows are read by several passes: materialise them once
    ranked = materialize(row_number_exact(mino, [md5_order(key, seed), F.col(key)], name="__r"))
    per, extra = divmod(need, m)
    ranked = ranked.withColumn("__copies", F.lit(per) + F.when(F.col("__r") <= extra, 1).otherwise(0))
    cand = knn_candidates(ranked, ranked, kk, key, key, "__x", "__x", exclude_self=True) \
        .withColumnRenamed("qkey", "__q").select("__q", F.col(key).alias("__nb"), F.col("nb_rank"))
    copies = ranked.where(F.col("__copies") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).withColumn("copy", F.col("copy").cast("bigint"))
    hj = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), F.col("copy").cast("string")))
    copies = copies.withColumn("__pick", (F.conv(F.substring(hj, 1, 2), 16, 10).cast("bigint") % kk) + 1) \
        .withColumn("__gap", F.conv(F.substring(hj, 3, 4), 16, 10).cast("bigint") / 65536.0)
    nbx = ranked.select(F.col(key).alias("__nb"), *[F.col(c).alias(f"__nb_{c}") for c in features])
    joined = copies.join(cand, (copies[key] == cand["__q"]) & (copies["__pick"] == cand["nb_rank"]), "inner") \
        .join(nbx, "__nb", "inner")
    out = joined.select(
        F.concat(F.col(key).cast("string"), F.lit("#"), F.col("copy").cast("string")).alias(key), "copy",
        *[(F.col(c) + F.col("__gap") * (F.col(f"__nb_{c}") - F.col(c))).alias(c) for c in features],
        *[F.col(c) for c in cats], F.col(label))
    return out


def apply_smote(df: DataFrame, label: str, key: str, features: list[str], **kw) -> DataFrame:
    """Training rows plus the synthetic ones (key cast to text)."""
    syn = smote(df, label, key, features, **kw)
    cols = [key, *features, *(kw.get("categorical") or []), label]
    base = df.select(F.col(key).cast("string").alias(key), *cols[1:])
    return base.unionByName(syn.select(*cols))
