"""Shared machinery for the custom classifiers.

Fitted values live in ``Param``s, so ``DefaultParamsWritable`` persists the
models next to the built-in ones inside a ``PipelineModel`` (A7/A9).
Scoring is built-in column expressions (higher-order array functions), so it
runs inside the JVM without a Python worker.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol,
                                     HasRawPredictionCol, HasSeed, HasWeightCol)
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _ClassifierParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol,
                        HasRawPredictionCol, HasWeightCol, HasSeed):
    def _weight(self) -> Column:
        if self.isDefined(self.weightCol) and self.getWeightCol():
            return F.col(self.getWeightCol()).cast("double")
        return F.lit(1.0)


class _FittedParams(Params):
    classes = Param(Params._dummy(), "classes", "label values in index order", TypeConverters.toListFloat)
    values = Param(Params._dummy(), "values", "fitted numbers, flattened", TypeConverters.toListFloat)
    shape = Param(Params._dummy(), "shape", "shape of the fitted numbers", TypeConverters.toListInt)


class CustomEstimator(Estimator, _ClassifierParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, **kw):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction",
                         probabilityCol="probability", rawPredictionCol="rawPrediction", seed=123)
        self._set(**{k: v for k, v in kw.items() if v is not None and self.hasParam(k)})

    def _copy_io(self, model):
        for p in ("featuresCol", "labelCol", "predictionCol", "probabilityCol", "rawPredictionCol"):
            model._set(**{p: self.getOrDefault(p)})
        return model


class CustomModel(Model, _ClassifierParams, _FittedParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction",
                         probabilityCol="probability", rawPredictionCol="rawPrediction", seed=123)

    def fitted(self) -> np.ndarray:
        return np.array(self.getOrDefault(self.values), dtype=float).reshape(self.getOrDefault(self.shape))

    def set_fitted(self, classes, arr: np.ndarray):
        arr = np.asarray(arr, dtype=float)
        self._set(classes=[float(c) for c in classes], values=arr.ravel().tolist(), shape=list(arr.shape))
        return self

    def _features(self) -> Column:
        return vector_to_array(F.col(self.getFeaturesCol()), "float64")


MAX_CLASSES = 10_000


#: Numbers of all classes' scatter matrices that a task and the driver hold at most (8 bytes each).
MAX_MOMENTS = 50_000_000


def label_classes(df: DataFrame, label: str, max_classes: int = MAX_CLASSES) -> list[float]:
    """Sorted distinct label values; refuses a label with more than ``max_classes`` values
    (it is not a class label), so the driver never receives an unbounded list."""
    vals = [r[0] for r in df.select(F.col(label).cast("double").alias("l")).where("l is not null")
            .distinct().limit(max_classes + 1).collect()]
    if len(vals) > max_classes:
        raise ValueError(f"label {label!r} has more than {max_classes} distinct values")
    return sorted(vals)


def dot(arr: Column, coef) -> Column:
    """Dot product of an array column with a literal vector."""
    lit = F.array(*[F.lit(float(c)) for c in coef])
    return F.aggregate(F.zip_with(arr, lit, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def quad_form(arr: Column, center, mat: np.ndarray) -> Column:
    """(x - c)' M (x - c) as array expressions."""
    d = F.zip_with(arr, F.array(*[F.lit(float(c)) for c in center]), lambda a, b: a - b)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in mat])
    md = F.transform(rows, lambda r: F.aggregate(F.zip_with(r, d, lambda a, b: a * b), F.lit(0.0),
                                                 lambda s, v: s + v))
    return F.aggregate(F.zip_with(d, md, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def with_scores(df: DataFrame, model: CustomModel, raw: list[Column], probs: bool = True,
                prob_cols: list[Column] | None = None) -> DataFrame:
    """Add rawPrediction, probability (softmax of raw unless given) and prediction (first argmax)."""
    classes = F.array(*[F.lit(float(c)) for c in model.getOrDefault(model.classes)])
    r = F.array(*raw)
    out = df.withColumn("__raw", r)
    idx = F.array_position(F.col("__raw"), F.array_max(F.col("__raw")))
    out = out.withColumn(model.getRawPredictionCol(), array_to_vector(F.col("__raw")))
    if probs:
        if prob_cols is not None:
            pr = F.array(*prob_cols)
        else:
            mx = F.array_max(F.col("__raw"))
            ex = F.transform(F.col("__raw"), lambda v: F.exp(v - mx))
            tot = F.aggregate(ex, F.lit(0.0), lambda s, v: s + v)
            pr = F.transform(ex, lambda e: e / tot)
        out = out.withColumn(model.getProbabilityCol(), array_to_vector(pr))
    out = out.withColumn(model.getPredictionCol(), F.element_at(classes, idx.cast("int")))
    return out.drop("__raw")


_MOMENTS_CACHE: dict | None = None


class shared_moments:
    """Context in which ``class_moments`` results are reused for identical inputs
    (same analysed plan, columns and weights), e.g. LDA, QDA and ridge fitted on
    one training table share one pass."""

    def __enter__(self):
        global _MOMENTS_CACHE
        self._prev = _MOMENTS_CACHE
        _MOMENTS_CACHE = {}
        return self

    def __exit__(self, *exc):
        global _MOMENTS_CACHE
        _MOMENTS_CACHE = self._prev
        return False


def class_moments(df: DataFrame, features_col: str, label_col: str, weight: Column | None = None):
    """Per class: weight sum, row count, mean and centred scatter matrix.

    Values are shifted by one data row (read with a one-row limit) to keep the
    sums well conditioned; one pass forms partial sums per (partition, class)
    with NumPy inside the tasks, and Spark adds them up by class. Nothing
    larger than classes x p^2 numbers reaches the driver.
    Returns (classes, wsum, count, means[K,p], scatter[K,p,p]).
    """
    base = df.select(F.col(label_col).cast("double").alias("l"),
                     (weight if weight is not None else F.lit(1.0)).alias("w"),
                     vector_to_array(F.col(features_col), "float64").alias("x")) \
        .where(F.col("l").isNotNull())
    key = None
    if _MOMENTS_CACHE is not None:
        key = base.semanticHash()
        if key in _MOMENTS_CACHE:
            return _MOMENTS_CACHE[key]
    first = base.where(~F.exists("x", lambda v: F.isnan(v))).select("x").first()
    if first is None:
        raise ValueError("no rows to fit")
    shift = np.asarray(first["x"], dtype=float)
    p = len(shift)
    most = max(1, MAX_MOMENTS // max(1, p * p))  # classes whose scatter matrices are held

    def partial(it):
        acc: dict[float, list] = {}
        for pdf in it:
            if pdf.empty:
                continue
            X = np.stack(pdf["x"].to_numpy()).astype(float) - shift
            w = pdf["w"].to_numpy(dtype=float)
            for lab, idx in pdf.groupby("l").indices.items():
                Xi, wi = X[idx], w[idx]
                a = acc.setdefault(float(lab), [0.0, 0, np.zeros(p), np.zeros((p, p))])
                if len(acc) > most:
                    raise ValueError(f"over {most} classes of {p} x {p} sums: use a model without class covariances")
                a[0] += wi.sum()
                a[1] += len(idx)
                a[2] += wi @ Xi
                a[3] += (Xi * wi[:, None]).T @ Xi
        if not acc:  # empty partition: emit nothing (an empty frame has no list types)
            return
        yield pd.DataFrame({"l": list(acc), "w": [a[0] for a in acc.values()],
                            "n": [a[1] for a in acc.values()],
                            "s": [a[2].tolist() for a in acc.values()],
                            "ss": [a[3].ravel().tolist() for a in acc.values()]})

    part = base.mapInPandas(partial, "l double, w double, n long, s array<double>, ss array<double>")
    tot = part.groupBy("l").agg(F.sum("w").alias("w"), F.sum("n").alias("n"),
                                Summarizer.sum(array_to_vector("s")).alias("s"),
                                Summarizer.sum(array_to_vector("ss")).alias("ss")).orderBy("l").limit(most + 1).collect()
    if len(tot) > most:
        raise ValueError(f"over {most} classes of {p} x {p} sums: use a model without class covariances")
    classes = np.array([r["l"] for r in tot])
    wsum = np.array([r["w"] for r in tot])
    cnt = np.array([r["n"] for r in tot])
    means = np.zeros((len(tot), p))
    scat = np.zeros((len(tot), p, p))
    for i, r in enumerate(tot):
        s = r["s"].toArray()
        ss = r["ss"].toArray().reshape(p, p)
        d = s / wsum[i]
        means[i] = d + shift
        scat[i] = ss - wsum[i] * np.outer(d, d)
    out = (classes, wsum, cnt, means, scat)
    if key is not None:
        _MOMENTS_CACHE[key] = out
    return out
