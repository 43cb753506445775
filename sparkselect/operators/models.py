"""The classifier menu (F1-F14) and its closed-form members.

Built-in Spark ML estimators cover logistic regression, naive Bayes, the
tree ensembles, gradient boosting and the linear SVM. Dummy, discriminant
analysis and ridge are closed forms of per-class counts, means and scatter
matrices: two passes over the data and a p x p solve on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       NaiveBayes, OneVsRest, RandomForestClassifier)
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkselect.operators.estimators import (MAX_CLASSES, CustomEstimator, CustomModel, class_moments, dot, quad_form,
                                              with_scores)


# ---------------------------------------------------------------- F12 dummy
class DummyClassifier(CustomEstimator):
    """class priors; predicts the most frequent class (ties to the lower label)."""

    def _fit(self, df: DataFrame):
        rows = df.where(F.col(self.getLabelCol()).isNotNull()) \
            .groupBy(F.col(self.getLabelCol()).cast("double").alias("l")) \
            .agg(F.sum(self._weight()).alias("w")).orderBy("l").limit(MAX_CLASSES + 1).collect()
        if len(rows) > MAX_CLASSES:
            raise ValueError(f"label {self.getLabelCol()!r} has more than {MAX_CLASSES} distinct values")
        classes = [r["l"] for r in rows]
        w = np.array([r["w"] for r in rows], dtype=float)
        return self._copy_io(DummyModel()).set_fitted(classes, w / w.sum())


class DummyModel(CustomModel):
    def _transform(self, df):
        pri = self.fitted()
        raw = [F.lit(float(p)) for p in pri]
        return with_scores(df, self, raw, prob_cols=raw)


# ---------------------------------------------------------------- F2 / F5 discriminants
class LDAClassifier(CustomEstimator):
    """F2: class means, pooled covariance scatter/(n-K); linear scores
    x'S^-1 m_k - m_k'S^-1 m_k / 2 + ln prior_k, softmax for probabilities."""

    def _fit(self, df):
        classes, w, n, means, scat = class_moments(df, self.getFeaturesCol(), self.getLabelCol(), self._weight())
        k = len(classes)
        cov = scat.sum(axis=0) / max(w.sum() - k, 1.0)
        inv = np.linalg.pinv(cov)
        a = means @ inv
        b = -0.5 * np.einsum("kp,kp->k", a, means) + np.log(w / w.sum())
        return self._copy_io(LDAModel()).set_fitted(classes, np.hstack([a, b[:, None]]))


class LDAModel(CustomModel):
    def _transform(self, df):
        ab = self.fitted()
        x = self._features()
        raw = [dot(x, r[:-1]) + F.lit(float(r[-1])) for r in ab]
        return with_scores(df, self, raw)

    def coefficients(self) -> np.ndarray:
        return self.fitted()[:, :-1]


class QDAClassifier(CustomEstimator):
    """per-class covariance scatter_k/(n_k-1); scores
    -ln|S_k|/2 - (x-m_k)'S_k^-1(x-m_k)/2 + ln prior_k."""

    def _fit(self, df):
        classes, w, n, means, scat = class_moments(df, self.getFeaturesCol(), self.getLabelCol(), self._weight())
        k, p = means.shape
        packed = np.zeros((k, 2 + p + p * p))
        for i in range(k):
            cov = scat[i] / max(w[i] - 1.0, 1.0)
            sign, logdet = np.linalg.slogdet(cov)
            if sign <= 0:  # singular class covariance: tiny ridge keeps it usable
                cov = cov + np.eye(p) * 1e-9 * max(np.trace(cov), 1.0)
                sign, logdet = np.linalg.slogdet(cov)
            packed[i, 0] = -0.5 * logdet + np.log(w[i] / w.sum())
            packed[i, 1] = 0.0
            packed[i, 2:2 + p] = means[i]
            packed[i, 2 + p:] = np.linalg.pinv(cov).ravel()
        return self._copy_io(QDAModel()).set_fitted(classes, packed)


class QDAModel(CustomModel):
    def _transform(self, df):
        packed = self.fitted()
        p = int((-1 + np.sqrt(1 + 4 * (packed.shape[1] - 2))) / 2)
        x = self._features()
        raw = [F.lit(float(r[0])) - 0.5 * quad_form(x, r[2:2 + p], r[2 + p:].reshape(p, p)) for r in packed]
        return with_scores(df, self, raw)


# ---------------------------------------------------------------- F14 ridge
class RidgeClassifier(CustomEstimator):
    """least squares on a +1/-1 target with an L2 penalty alpha on the
    slopes (intercept free); label = sign for two classes, argmax of the
    one-vs-rest scores otherwise. No probabilities."""

    alpha = Param(Params._dummy(), "alpha", "L2 strength", TypeConverters.toFloat)

    def __init__(self, alpha: float = 1.0, **kw):
        super().__init__(**kw)
        self._set(alpha=alpha)

    def _fit(self, df):
        classes, w, n, means, scat = class_moments(df, self.getFeaturesCol(), self.getLabelCol(), self._weight())
        k, p = means.shape
        wt = w.sum()
        mu = (w[:, None] * means).sum(axis=0) / wt
        between = np.einsum("k,kp,kq->pq", w, means - mu, means - mu)
        sxx = scat.sum(axis=0) + between
        targets = np.where(np.eye(k) > 0, 1.0, -1.0) if k > 2 else np.array([[-1.0], [1.0]])[:k]
        tbar = (w[:, None] * targets).sum(axis=0) / wt
        sxt = np.einsum("k,kp,kt->pt", w, means - mu, targets - tbar)
        beta = np.linalg.solve(sxx + self.getOrDefault(self.alpha) * np.eye(p), sxt)
        icpt = tbar - mu @ beta
        return self._copy_io(RidgeModel()).set_fitted(classes, np.vstack([beta, icpt[None, :]]).T)


class RidgeModel(CustomModel):
    def _transform(self, df):
        bt = self.fitted()  # targets x (p + 1)
        x = self._features()
        scores = [dot(x, r[:-1]) + F.lit(float(r[-1])) for r in bt]
        if len(bt) == 1:
            # a score of exactly 0 goes to the first class (first argmax)
            raw = [F.lit(0.0) - scores[0], scores[0]]
        else:
            raw = scores
        return with_scores(df, self, raw, probs=False)


# ---------------------------------------------------------------- menu
# Menu names and codes of the reference (name -> code).
MENU = {
    "Logistic Regression": "lr",
    "Linear Discriminant Analysis": "lda",
    "Naive Bayes": "nb",
    "Random Forest Classifier": "rf",
    "Quadratic Discriminant Analysis": "qda",
    "Extra Trees Classifier": "et",
    "Gradient Boosting Classifier": "gbc",
    "Light Gradient Boosting Machine": "lightgbm",
    "Ada Boost Classifier": "ada",
    "K Neighbors Classifier": "knn",
    "Decision Tree Classifier": "dt",
    "Dummy Classifier": "dummy",
    "SVM - Linear Kernel": "svm",
    "Ridge Classifier": "ridge",
}
CODES = list(MENU.values())
#: models that give class probabilities
HAS_PROBABILITY = {"lr", "lda", "nb", "rf", "qda", "et", "gbc", "lightgbm", "ada", "knn", "dt", "dummy"}
#: models that only take labels 0/1 natively (one-vs-rest beyond)
BINARY_ONLY = {"gbc", "lightgbm", "svm"}


def codes_for(names) -> list[str]:
    """menu names or codes -> codes; empty means all fourteen."""
    if not names:
        return list(CODES)
    out = []
    for n in names:
        out.append(MENU.get(n, n))
        if out[-1] not in CODES:
            raise ValueError(f"unknown model {n!r}")
    return out


def make_estimator(code: str, features: str = "features", label: str = "label", weight: str | None = None,
                   seed: int = 123, n_classes: int = 2, **params):
    io = dict(featuresCol=features, labelCol=label)
    wt = dict(weightCol=weight) if weight else {}
    if code == "lr":
        return LogisticRegression(maxIter=params.get("maxIter", 100), regParam=params.get("regParam", 0.01),
                                  elasticNetParam=0.0, **io, **wt)
    if code == "nb":
        return NaiveBayes(modelType="gaussian", **io, **wt)
    if code == "rf":
        return RandomForestClassifier(numTrees=params.get("numTrees", 100), maxDepth=params.get("maxDepth", 10),
                                      seed=seed, **io, **wt)
    if code == "dt":
        return DecisionTreeClassifier(impurity="gini", maxDepth=params.get("maxDepth", 10), seed=seed, **io, **wt)
    if code == "gbc" and n_classes > 2:
        from sparkselect.operators.boosting import SoftmaxBoostingClassifier
        return SoftmaxBoostingClassifier(seed=seed, **params, **io, **wt)
    if code == "gbc":
        return GBTClassifier(maxIter=params.get("maxIter", 100), stepSize=params.get("stepSize", 0.1),
                             maxDepth=params.get("maxDepth", 3), seed=seed, **io, **wt)
    if code == "lightgbm":
        from sparkselect.operators.boosting import LeafBoostingClassifier
        return LeafBoostingClassifier(seed=seed, **params, **io, **wt)
    if code == "svm":
        base = LinearSVC(maxIter=params.get("maxIter", 100), regParam=params.get("regParam", 0.01), **io, **wt)
        return base if n_classes <= 2 else OneVsRest(classifier=base, **io, **wt)
    if code == "dummy":
        return DummyClassifier(**io, **wt)
    if code == "lda":
        return LDAClassifier(**io, **wt)
    if code == "qda":
        return QDAClassifier(**io, **wt)
    if code == "ridge":
        return RidgeClassifier(alpha=params.get("alpha", 1.0), **io, **wt)
    if code == "knn":
        from sparkselect.operators.neighbors import KNNClassifier
        return KNNClassifier(k=params.get("k", 5), **io)
    if code == "et":
        from sparkselect.operators.extra_trees import ExtraTreesClassifier
        return ExtraTreesClassifier(seed=seed, **params, **io, **wt)
    if code == "ada":
        from sparkselect.operators.ensembles import AdaBoostClassifier
        return AdaBoostClassifier(numRounds=params.get("numRounds", 50), seed=seed, **io, **wt)
    raise ValueError(f"unknown model code {code!r}")
