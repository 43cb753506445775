"""Meta-estimators: F9/G6 AdaBoost (SAMME), G5 bagging, G7 blending, G8 stacking
(F6 extra trees are in ``extra_trees``).

Members are ordinary Spark ML models; the wrappers only combine their
probability vectors (or labels) with column expressions. Iterative fits
(boosting) cut their lineage with reliable checkpoints.
"""

from __future__ import annotations

import math
from contextlib import nullcontext

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkselect.functions.hashing import hash_unit
from sparkselect.operators.extra_trees import ExtraTreesClassifier, ExtraTreesModel  # noqa: F401
from sparkselect.operators.estimators import CustomEstimator, CustomModel, label_classes, shared_moments, with_scores
from sparkselect.operators.persist import CompositePersistence
from sparkselect.session import stored, stored_split, stored_wide


def _member_scores(model, df: DataFrame, classes: list[float], tag: str) -> tuple[DataFrame, list[Column], Column]:
    """Transform with one member; keep its probability array (if any) and label under ``tag``."""
    scored = model.transform(df)
    keep = [c for c in df.columns]
    has_prob = "probability" in scored.columns
    cols = [F.col(f"`{c}`") for c in keep]
    cols.append(F.col("prediction").alias(f"{tag}_pred"))
    if has_prob:
        cols.append(vector_to_array("probability").alias(f"{tag}_prob"))
    out = scored.select(*cols)
    probs = [F.col(f"{tag}_prob")[i] for i in range(len(classes))] if has_prob else None
    return out, probs, F.col(f"{tag}_pred")


def combine(df: DataFrame, members: list, classes: list[float], owner: CustomModel, soft: bool | None = None,
            weights: list[float] | None = None) -> DataFrame:
    """Soft vote (mean probability) when every member has probabilities, else a hard
    majority vote; ties to the lower label."""
    cur = df
    probs, preds = [], []
    for i, m in enumerate(members):
        cur, p, y = _member_scores(m, cur, classes, f"__m{i}")
        probs.append(p)
        preds.append(y)
    w = weights or [1.0] * len(members)
    use_soft = all(p is not None for p in probs) if soft is None else soft
    if use_soft:
        tot = float(sum(w))
        avg = [sum((probs[i][k] * F.lit(w[i]) for i in range(len(members))), F.lit(0.0)) / F.lit(tot)
               for k in range(len(classes))]
        out = with_scores(cur, owner, avg, prob_cols=avg)
    else:
        votes = [sum((F.when(preds[i] == F.lit(c), F.lit(w[i])).otherwise(F.lit(0.0)) for i in range(len(members))),
                     F.lit(0.0)) for c in classes]
        out = with_scores(cur, owner, votes, probs=False)
    drop = [c for c in out.columns if c.startswith("__m")]
    return out.drop(*drop)


class _MemberModel(CompositePersistence, CustomModel):
    """A model whose members are fitted Spark ML models; ``soft`` None = soft vote when
    every member has probabilities, True/False forces it."""

    members: list = []
    soft: bool | None = None
    _sub_models = ("members",)
    _sub_values = ("soft",)

    def _transform(self, df):
        return combine(df, self.members, self.getOrDefault(self.classes), self, soft=self.soft)


# ------------------------------------------------------------------ F9 / G6
def samme_step(df: DataFrame, y: str, yhat: str, w: str, k: int) -> tuple[DataFrame, float | None, float | None]:
    """One SAMME round given a learner's predictions: weighted error e,
    alpha = ln((1-e)/e) + ln(K-1), and the new weights w exp(alpha [miss]) renormalised
    to sum 1. Returns (rows with ``w_next``, e, alpha); alpha is None when e is 0 or
    no better than chance (1 - 1/K). One pass: the new sum follows from both old ones."""
    miss = (F.col(yhat) != F.col(y)).cast("double")
    e, missed, whole = df.agg(F.sum(F.col(w) * miss) / F.sum(w), F.sum(F.col(w) * miss), F.sum(F.when(miss.isNotNull(), F.col(w)))).first()
    if e is None or e <= 0 or e >= 1.0 - 1.0 / k:
        return df.withColumn("w_next", F.col(w)), e, None
    alpha = math.log((1 - e) / e) + math.log(k - 1)
    tot = (whole - missed) + missed * math.exp(alpha)
    return df.withColumn("w_next", F.col(w) * F.exp(F.lit(alpha) * miss) / F.lit(tot)), e, alpha


class AdaBoostClassifier(CustomEstimator):
    """SAMME (Zhu et al. 2009). Round t fits the base learner (a depth-1 tree by
    default) with the current weights; e = weighted error; alpha = ln((1-e)/e) + ln(K-1);
    weights of misses grow by exp(alpha) and are renormalised. Stops early when e = 0 or
    e >= 1 - 1/K. Scores are alpha-weighted votes; probability = vote share.
    The weighted table is written to the checkpoint folder every few rounds."""

    numRounds = Param(Params._dummy(), "numRounds", "boosting rounds", TypeConverters.toInt)
    checkpointEvery = Param(Params._dummy(), "checkpointEvery", "rounds between checkpoints", TypeConverters.toInt)

    def __init__(self, numRounds=50, base=None, checkpointEvery=3, **kw):
        super().__init__(**kw)
        self._setDefault(numRounds=50, checkpointEvery=3)
        self._set(numRounds=numRounds, checkpointEvery=checkpointEvery)
        self.base = base

    def _fit(self, df):
        feats, label = self.getFeaturesCol(), self.getLabelCol()
        classes = label_classes(df, label)
        k = max(len(classes), 2)
        w0 = self._weight()
        # with the number of labels stated, a learner needs no pass to find it
        stated = {"ml_attr": {"type": "nominal", "num_vals": int(classes[-1]) + 1}} if classes and classes[-1] >= 0 else {}
        table = stored_split(df.select(F.col(feats).alias("__f"), F.col(label).cast("double").alias("__y", metadata=stated), w0.alias("__w")), "ada-rows")
        tot = table.frame.agg(F.sum("__w")).first()[0]
        cur = table.frame.withColumn("__w", F.col("__w") / F.lit(tot))
        members, alphas, errors = [], [], []
        for t in range(self.getOrDefault(self.numRounds)):
            base = self.base.copy() if self.base is not None else DecisionTreeClassifier(maxDepth=1)
            base = base.copy({base.featuresCol: "__f", base.labelCol: "__y"})
            if base.hasParam("weightCol"):
                base = base.copy({base.getParam("weightCol"): "__w"})
            if base.hasParam("seed"):
                base = base.copy({base.getParam("seed"): self.getSeed() + t})
            m = base.fit(cur)
            scored = m.transform(cur).select("__f", "__y", "__w", F.col("prediction").alias("__p"))
            nxt, e, alpha = samme_step(scored, "__y", "__p", "__w", k)
            if alpha is None:
                if e is not None and e <= 0:  # perfect learner: keep it with a large weight and stop
                    members.append(m)
                    alphas.append(10.0 + math.log(k - 1))
                    errors.append(0.0)
                elif not members:  # keep one learner so the model can score
                    members.append(m)
                    alphas.append(1.0)
                    errors.append(e)
                break
            members.append(m)
            alphas.append(alpha)
            errors.append(e)
            cur = nxt.select("__f", "__y", F.col("w_next").alias("__w"))
            if (t + 1) % self.getOrDefault(self.checkpointEvery) == 0:
                done, table = table, stored(cur, "ada-rows")  # a file a task: dealt at the start
                done.drop()
                cur = table.frame
        table.drop()
        model = self._copy_io(AdaBoostModel())
        model.set_fitted(classes, np.array([alphas, [float("nan") if x is None else x for x in errors]]))
        model.members = members
        return model


class AdaBoostModel(CompositePersistence, CustomModel):
    members: list = []
    _sub_models = ("members",)

    def alphas(self) -> list[float]:
        return self.fitted()[0].tolist()

    def errors(self) -> list[float]:
        return self.fitted()[1].tolist()

    def _transform(self, df):
        classes = self.getOrDefault(self.classes)
        alphas = self.alphas()
        cur = df.withColumn("__f", F.col(self.getFeaturesCol()))
        preds = []
        for i, m in enumerate(self.members):
            m2 = m.copy()
            m2._set(predictionCol=f"__ap{i}")
            for pc in ("probabilityCol", "rawPredictionCol"):
                if m2.hasParam(pc):
                    m2._set(**{pc: f"__ax{i}_{pc}"})
            cur = m2.transform(cur)
            cur = cur.drop(*[c for c in cur.columns if c.startswith(f"__ax{i}_")])
            preds.append(f"__ap{i}")
        total = float(sum(alphas))
        votes = [sum((F.when(F.col(p) == F.lit(c), F.lit(a)).otherwise(F.lit(0.0)) for p, a in zip(preds, alphas)),
                     F.lit(0.0)) for c in classes]
        out = with_scores(cur, self, votes, prob_cols=[v / F.lit(total) for v in votes])
        return out.drop("__f", *preds)


# ------------------------------------------------------------------ G5 bagging
# Poisson(1) cumulative probabilities (e^-1 sum 1/j!), up to the last below 1 in doubles:
# beyond it no hash value is left.
POISSON1_CDF = [c for c in (math.exp(-1) * math.fsum(1 / math.factorial(j) for j in range(k + 1)) for k in range(30)) if c < 1.0]


def poisson_weight(key: Column | str, seed: int) -> Column:
    """Bootstrap multiplicity ~ Poisson(1) from a key hash (inverse CDF)."""
    return _poisson_count(hash_unit(key, seed))


def _poisson_count(u: Column) -> Column:
    expr = F.lit(len(POISSON1_CDF))
    for k in reversed(range(len(POISSON1_CDF))):
        expr = F.when(u < F.lit(POISSON1_CDF[k]), F.lit(k)).otherwise(expr)
    return expr


class BaggingClassifier(CustomEstimator):
    """G5 (Breiman 1996): n members, each fitted on a bootstrap copy of the rows where
    row multiplicity ~ Poisson(1) is a hash of (key, member); mean probability or vote."""

    n = Param(Params._dummy(), "n", "members", TypeConverters.toInt)
    keyCol = Param(Params._dummy(), "keyCol", "row key", TypeConverters.toString)

    def __init__(self, base=None, n=10, keyCol=None, **kw):
        super().__init__(**kw)
        self._setDefault(n=10)
        self._set(n=n)
        if keyCol:
            self._set(keyCol=keyCol)
        self.base = base

    def _fit(self, df):
        label = self.getLabelCol()
        classes = label_classes(df, label)
        key = F.col(self.getOrDefault(self.keyCol)) if self.isDefined(self.keyCol) else \
            F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != self.getFeaturesCol()],
                                      vector_to_array(self.getFeaturesCol()))), 256)
        # a fit reads its rows several times: they and their weights are computed once for all members
        numbers = range(self.getOrDefault(self.n))
        rows = stored_split(df.withColumn("__key", key), "bagging-rows")
        places = rows.frame.select(*[F.col(f"`{c}`") for c in df.columns], *[hash_unit("__key", self.getSeed() * 1000 + b).alias(f"__u{b}") for b in numbers])
        counted = places.select(*[F.col(f"`{c}`") for c in df.columns], *[_poisson_count(F.col(f"__u{b}")).alias(f"__copies{b}") for b in numbers])
        table = stored(counted, "bagging-weights")
        rows.drop()
        members = []
        for b in numbers:
            boot = table.frame.where(f"__copies{b} > 0").select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.sequence(F.lit(1), F.col(f"__copies{b}"))).alias("__c")).drop("__c")
            members.append(self.base.copy().fit(boot))
        table.drop()
        m = self._copy_io(_MemberModel())
        m.set_fitted(classes, np.zeros(1))
        m.members = members
        return m


def blend(models: list, classes: list[float], soft: bool | None = None) -> CustomModel:
    """A model that averages probabilities (or votes) of fitted members."""
    m = _MemberModel()
    m.set_fitted(classes, np.zeros(1))
    m.members = list(models)
    m.soft = soft
    return m


# ------------------------------------------------------------------ G8 stacking
class StackingClassifier(CustomEstimator):
    """G8 (Wolpert 1992): out-of-fold scores of every base estimator (probability of each
    class, or the raw margin when a model has no probability) plus the original features
    feed a logistic meta-model; base estimators are refitted on all rows for scoring."""

    foldCol = Param(Params._dummy(), "foldCol", "fold column", TypeConverters.toString)

    def __init__(self, bases=None, foldCol="fold", meta=None, frames=None, **kw):
        """``frames``: (fold, train, held) triples prepared fold by fold, used instead of ``foldCol``
        for the out-of-fold scores; the held rows' features then come from other fits of the
        preparation, so only the scores feed the meta-model."""
        super().__init__(**kw)
        self._set(foldCol=foldCol)
        self.bases = list(bases or [])
        self.meta = meta
        self.frames = frames

    def _meta_cols(self, scored: DataFrame, i: int, k: int) -> list[Column]:
        if "probability" in scored.columns:
            arr = vector_to_array("probability")
            return [arr[j].alias(f"__stk{i}_{j}") for j in range(1 if k == 2 else 0, k)]
        arr = vector_to_array("rawPrediction")
        return [arr[j].alias(f"__stk{i}_{j}") for j in range(1 if k == 2 else 0, k)]

    def _scores(self, models: list, df: DataFrame, k: int) -> DataFrame:
        cur = df
        for i, m in enumerate(models):
            sc = m.transform(cur)
            cur = sc.select(*[F.col(f"`{c}`") for c in cur.columns], *self._meta_cols(sc, i, k))
        return cur

    def _fit(self, df):
        if self.frames is not None:
            return self._fit_stack(df)
        # every fold of every base reads the rows: folds are numbered once
        table = stored_wide(df, "stacking-rows")
        try:
            return self._fit_stack(table.frame)
        finally:
            table.drop()

    def _fit_stack(self, df):
        label, fold = self.getLabelCol(), self.getOrDefault(self.foldCol)
        classes = label_classes(df, label)
        k = len(classes)
        if self.frames is not None:
            frames = [(a, b.select(label, self.getFeaturesCol())) for f, a, b in self.frames if f is not None]
        else:
            folds = sorted(r[0] for r in df.select(fold).distinct().collect())
            frames = [(df.where(F.col(fold) != f), df.where(F.col(fold) == f)) for f in folds]
        parts = []
        for train, held in frames:
            with nullcontext() if self.frames is not None else shared_moments():
                models = [b.copy().fit(train) for b in self.bases]
            scored = self._scores(models, held, k)
            parts.append(scored.drop(self.getFeaturesCol()) if self.frames is not None else scored)
        oof = parts[0]
        for p in parts[1:]:
            oof = oof.unionByName(p)
        meta_in = [c for c in oof.columns if c.startswith("__stk")]
        va = VectorAssembler(inputCols=meta_in if self.frames is not None else [*meta_in, self.getFeaturesCol()], outputCol="__meta")
        meta = (self.meta or LogisticRegression(maxIter=100, regParam=0.01)).copy()
        meta = meta.copy({meta.featuresCol: "__meta", meta.labelCol: label})
        meta_model = meta.fit(va.transform(oof))
        full = [b.copy().fit(df) for b in self.bases]
        m = self._copy_io(StackingModel())
        m.set_fitted(classes, np.zeros(1))
        m.bases, m.meta_model, m.assembler, m.k = full, meta_model, va, k
        return m


class StackingModel(CompositePersistence, CustomModel):
    bases: list = []
    meta_model = None
    assembler = None
    k = 2
    _sub_models = ("bases", "meta_model", "assembler")
    _sub_values = ("k",)

    def _transform(self, df):
        cur = df
        for i, b in enumerate(self.bases):
            sc = b.transform(cur)
            cur = sc.select(*[F.col(f"`{c}`") for c in cur.columns],
                            *StackingClassifier._meta_cols(None, sc, i, self.k))  # type: ignore[arg-type]
        out = self.meta_model.transform(self.assembler.transform(cur))
        drop = [c for c in out.columns if c.startswith("__stk")] + ["__meta"]
        return out.drop(*drop)


def vote(df: DataFrame, pred_cols: list[str], name: str = "vote") -> DataFrame:
    """G7 over finished predictions: majority label across columns, ties to the lower label."""
    arr = F.array(*[F.col(f"`{c}`").cast("double") for c in pred_cols])
    levels = F.array_sort(F.array_distinct(F.filter(arr, lambda x: x.isNotNull())))
    counts = F.transform(levels, lambda v: F.size(F.filter(arr, lambda x: x == v)))
    pos = F.array_position(counts, F.array_max(counts))
    return df.withColumn(name, F.element_at(levels, pos.cast("int")))


def soft_vote(df: DataFrame, prob_cols: list[str], name: str = "vote") -> DataFrame:
    """G7 soft form over probability arrays/vectors of equal length: argmax of the mean."""
    arrs = [vector_to_array(c) if dict(df.dtypes)[c] != "array<double>" else F.col(c) for c in prob_cols]
    mean = F.transform(arrs[0], lambda v, i: sum((a[i] for a in arrs[1:]), v) / F.lit(float(len(arrs))))
    return df.withColumn(name, (F.array_position(mean, F.array_max(mean)) - 1).cast("double"))
