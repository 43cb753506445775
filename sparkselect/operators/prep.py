"""Preparation stages (E1-E15) as ``pyspark.ml`` estimators and transformers.

Each stage fits on training rows only and persists inside a
``PipelineModel``. Fitted state is small by construction (per-column
numbers, kept level lists, coefficient vectors); level-to-count maps whose
size grows with the data are kept as a table and joined, broadcast only
below a checked size.
"""

from __future__ import annotations

import json
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkselect.functions.pairs import pair_correlations
from sparkselect.functions.patterns import pattern_moments, present
from sparkselect.functions.ranking import exact_quantiles, value_counts_long
from sparkselect.operators import chained
from sparkselect.operators.estimators import class_moments, quad_form
from sparkselect.session import stored_split

RARE = "__rare__"


class _Cols(Params):
    inputCols = Param(Params._dummy(), "inputCols", "input columns", TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "output columns", TypeConverters.toListString)
    state = Param(Params._dummy(), "state", "fitted state as JSON", TypeConverters.toString)

    def _ins(self) -> list[str]:
        return self.getOrDefault(self.inputCols)

    def _outs(self) -> list[str]:
        if self.isDefined(self.outputCols) and self.getOrDefault(self.outputCols):
            return self.getOrDefault(self.outputCols)
        return self._ins()

    def _state(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


class _Stage(_Cols, DefaultParamsReadable, DefaultParamsWritable):
    def _init(self, inputCols=None, outputCols=None, **kw):
        if inputCols is not None:
            self._set(inputCols=list(inputCols))
        if outputCols is not None:
            self._set(outputCols=list(outputCols))
        for k, v in kw.items():
            if v is not None and self.hasParam(k):
                self._set(**{k: v})


class _FittedModel(Model, _Stage):
    def __init__(self):
        super().__init__()

    @classmethod
    def of(cls, est, state: dict):
        m = cls()
        m._set(inputCols=est._ins(), outputCols=est._outs(), state=json.dumps(state))
        for p in est.params:
            if m.hasParam(p.name) and est.isDefined(p) and p.name not in ("inputCols", "outputCols", "state"):
                m._set(**{p.name: est.getOrDefault(p)})
        return m


def _replace(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """One select that replaces or adds columns (no withColumn loop)."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in exprs]
    return df.select(*keep, *[e.alias(n) for n, e in exprs.items()])


# ------------------------------------------------------------------ E1b simple imputer
class SimpleImputer(Estimator, _Stage):
    """Fill nulls with the mean, median (exact, interpolated) or most frequent value
    (ties to the smallest); strings always take the most frequent level."""

    strategy = Param(Params._dummy(), "strategy", "mean | median | mode", TypeConverters.toString)

    def __init__(self, inputCols=None, outputCols=None, strategy="mean"):
        super().__init__()
        self._setDefault(strategy="mean")
        self._init(inputCols, outputCols, strategy=strategy)

    def _fit(self, df):
        cols = self._ins()
        types = dict(df.dtypes)
        num = [c for c in cols if types[c] not in ("string", "boolean")]
        cat = [c for c in cols if c not in num]
        fill: dict[str, object] = {}
        strat = self.getOrDefault(self.strategy)
        if num and strat == "mean":
            row = df.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in num]).first()
            fill.update({c: row[c] for c in num})
        elif num and strat == "median":
            q = exact_quantiles(df, num, [0.5]).collect()
            fill.update({r["column"]: r["value"] for r in q})
        elif num:
            cat = cat + num
        if cat:
            lc = value_counts_long(df, cat, value_type="string")
            from sparkselect.functions.ranking import top_k_per_group
            top = top_k_per_group(lc, ["column"], [F.col("cnt").desc(), F.col("value").asc()], 1).collect()
            for r in top:
                v = r["value"]
                fill[r["column"]] = float(v) if r["column"] in num else v
        return SimpleImputerModel.of(self, {"fill": fill})


class SimpleImputerModel(_FittedModel):
    strategy = SimpleImputer.strategy

    def _transform(self, df):
        fill = self._state()["fill"]
        types = dict(df.dtypes)
        ex = {}
        for c, o in zip(self._ins(), self._outs()):
            v = fill.get(c)
            lit = F.lit(v).cast(types[c]) if v is not None else F.lit(None).cast(types[c])
            ex[o] = F.coalesce(F.col(f"`{c}`"), lit)
        return _replace(df, ex)


# ------------------------------------------------------------------ E1 iterative imputer
#: Steps of the chain up to which new rows are filled by column expressions; longer chains in Arrow batches.
MAX_STEP_EXPRESSIONS = 60


class IterativeImputer(Estimator, _Stage):
    """Chained equations (van Buuren & Groothuis-Oudshoorn 2011). Start from the mean
    (numeric) or most frequent level (``categoricalCols``); then for ``rounds`` rounds, for
    each column with missing values (fewest missing first) fit, over its observed rows,
    least squares on all numeric columns (numeric target) or a decision tree on them
    (categorical target), and refill its missing rows. Null and NaN are missing. A column
    without any value is filled with 0 (or the level "missing") and takes no part.

    The numeric chain needs the table's moments per pattern of missing values only
    (``operators/chained.py``): one pass, whatever the number of rounds. Where the patterns are
    too many for ``functions/patterns.py``, each step reads the rows. Levels are never
    predictors, so the tree of the last round alone decides a categorical column and only
    that one is fitted. The model keeps the coefficients and trees and replays them on new rows.
    """

    rounds = Param(Params._dummy(), "rounds", "rounds", TypeConverters.toInt)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "categorical columns", TypeConverters.toListString)

    def __init__(self, inputCols=None, rounds=5, categoricalCols=None):
        super().__init__()
        self._setDefault(rounds=5, categoricalCols=[])
        self._init(inputCols, None, rounds=rounds, categoricalCols=list(categoricalCols or []))

    def _fit(self, df):
        from pyspark.ml.classification import DecisionTreeClassifier
        from pyspark.ml.feature import StringIndexer, VectorAssembler
        cols = self._ins()
        cats = self.getOrDefault(self.categoricalCols)
        rounds = self.getOrDefault(self.rounds)
        found = pattern_moments(df, cols) if cols else None
        if found is not None:
            gone, mean = chained.start(*found)
            n = found[1][:, 0, 0].sum()
            miss, means = dict(zip(cols, gone)), dict(zip(cols, map(float, mean)))
        else:
            r = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(present(c)).alias(f"c{i}") for i, c in enumerate(cols)],
                       *[F.coalesce(F.avg(present(c)), F.lit(0.0)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
            n = r["n"]
            miss = {c: n - r[f"c{i}"] for i, c in enumerate(cols)}
            means = {c: r[f"m{i}"] for i, c in enumerate(cols)}
        modes = {}
        if cats:
            r = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cats)]).first()
            miss.update({c: n - r[f"c{i}"] for i, c in enumerate(cats)})
            modes = SimpleImputer(cats, strategy="mode").fit(df)._state()["fill"]
        allc = cols + cats
        empty = [c for c in allc if miss[c] == n]
        order = sorted([c for c in allc if 0 < miss[c] < n], key=lambda c: (miss[c], allc.index(c)))
        modes = {c: "missing" if c in empty else modes.get(c) for c in cats}
        nums = [c for c in order if c in cols]
        if found is not None:
            steps = chained.sweep(*found, [cols.index(c) for c in nums], [cols.index(c) for c in empty if c in cols], rounds)
            chain = [{"col": cols[c], "kind": "num", "others": [cols[o] for o in others], "coef": [float(v) for v in coef], "icpt": icpt}
                     for c, others, coef, icpt in steps]
        else:
            chain = self._row_chain(df, nums, means, empty, rounds)
        others = [o for o in cols if o not in empty]
        trees, levels = [], {}
        for c in [c for c in order if c in cats] if others and rounds else []:
            # the tree reads the numeric state of its place in the last round
            later = sum(s["col"] in nums and order.index(s["col"]) > order.index(c) for s in chain[-len(nums):]) if nums else 0
            at = len(chain) - later
            upto = IterativeImputerModel.of(self, {"means": means, "modes": {}, "chain": chain[:at]})
            upto._set(categoricalCols=[])
            obs = upto._transform(df.where(F.col(f"`{c}`").isNotNull())
                                  .select(*[F.col(f"`{o}`") for o in cols], F.col(f"`{c}`").cast("string").alias("__c")))
            obs = VectorAssembler(inputCols=others, outputCol="__x").transform(obs)
            si = StringIndexer(inputCol="__c", outputCol="__ci", stringOrderType="alphabetAsc").fit(obs)
            dt = DecisionTreeClassifier(featuresCol="__x", labelCol="__ci", maxDepth=5, seed=123).fit(si.transform(obs)).copy()
            dt._set(predictionCol="__cp", probabilityCol="__cpr", rawPredictionCol="__cr")
            levels.setdefault(at, []).append({"col": c, "kind": "cat", "others": others, "labels": list(si.labels), "tree": len(trees)})
            trees.append(dt)
        chain = [s for i in range(len(chain) + 1) for s in levels.get(i, []) + chain[i:i + 1]]
        m = IterativeImputerModel.of(self, {"means": means, "modes": modes, "chain": chain})
        m.trees = trees
        return m

    def _row_chain(self, df, nums, means, empty, rounds):
        """The numeric chain with a model fit a step, for tables with too many patterns."""
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import LinearRegression
        from sparkselect.session import cut_lineage
        cols = self._ins()
        work = df.select(*[F.coalesce(present(c), F.lit(means[c])).alias(c) for c in cols],
                         *[present(c).isNull().alias(f"__m_{c}") for c in nums])
        chain = []
        for _ in range(rounds):
            for c in nums:
                others = [o for o in cols if o != c and o not in empty]
                if not others:
                    continue
                obs = VectorAssembler(inputCols=others, outputCol="__x").transform(work.where(~F.col(f"`__m_{c}`")))
                lr = LinearRegression(featuresCol="__x", labelCol=c, solver="normal", regParam=0.0).fit(obs)
                chain.append({"col": c, "kind": "num", "others": others, "coef": [float(v) for v in lr.coefficients],
                              "icpt": float(lr.intercept)})
                work = work.withColumn(c, F.when(F.col(f"`__m_{c}`"), _affine(chain[-1])).otherwise(F.col(f"`{c}`")))
            work = cut_lineage(work)
        return chain


def _affine(step: dict) -> Column:
    return F.lit(step["icpt"]) + sum((F.col(f"`{o}`") * F.lit(w) for o, w in zip(step["others"], step["coef"])), F.lit(0.0))


def _fill_in_batches(cols: list[str], means: dict, chain: list[dict]) -> Column:
    """All numeric columns after the chain as one array: one matrix product a pattern and batch."""
    at = {c: i for i, c in enumerate(cols)}
    mean = np.array([means[c] for c in cols])
    steps = [(at[s["col"]], [at[o] for o in s["others"]], np.array(s["coef"]), s["icpt"]) for s in chain]

    @F.pandas_udf("array<double>")
    def fill(x: pd.DataFrame) -> pd.Series:
        x = x.to_numpy(float)
        gone = np.isnan(x)
        z = np.hstack((np.ones((len(x), 1)), np.where(gone, 0.0, x)))
        kinds, rows = np.unique(gone, axis=0, return_inverse=True)
        out = np.empty_like(x)
        for i, kind in enumerate(kinds):
            here = rows.ravel() == i
            out[here] = z[here] @ chained.pattern_map(kind, mean, steps).T
        return pd.Series(list(out))

    return fill(F.struct(*[present(c).alias(f"c{i}") for i, c in enumerate(cols)]))


class IterativeImputerModel(_FittedModel):
    rounds = IterativeImputer.rounds
    categoricalCols = IterativeImputer.categoricalCols
    trees: list = []
    _sub_models = ("trees",)

    def write(self):
        from sparkselect.operators.persist import CompositeWriter
        return CompositeWriter(self)

    @classmethod
    def read(cls):
        from sparkselect.operators.persist import CompositeReader
        return CompositeReader(cls)

    def _transform(self, df):
        from pyspark.ml.feature import VectorAssembler
        st = self._state()
        cols = self._ins()
        cats = self.getOrDefault(self.categoricalCols)
        flags = {c: f"__m_{c}" for c in cols + cats}
        chain = st["chain"]
        nums = [s for s in chain if s["kind"] == "num"]
        batches = len(nums) > MAX_STEP_EXPRESSIONS  # an array a place in the chain at which a tree, or the result, reads it
        cur = df.select("*", *[present(c).isNull().alias(flags[c]) for c in cols],
                        *[F.col(f"`{c}`").isNull().alias(flags[c]) for c in cats])
        if batches:
            places = sorted({sum(t["kind"] == "num" for t in chain[:i]) for i, s in enumerate(chain) if s["kind"] == "cat"} | {len(nums)})
            cur = cur.select("*", *[_fill_in_batches(cols, st["means"], nums[:k]).alias(f"__at_{k}") for k in places])
        else:
            cur = _replace(cur, {c: F.coalesce(present(c), F.lit(st["means"][c])) for c in cols})
        cur = _replace(cur, {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(st["modes"].get(c))) for c in cats}) if cats else cur
        done = 0
        for step in chain:
            c = step["col"]
            if step["kind"] == "num":
                done += 1
                if not batches:
                    cur = cur.withColumn(c, F.when(F.col(f"`{flags[c]}`"), _affine(step)).otherwise(F.col(f"`{c}`")))
                continue
            state = cur.withColumn("__x", array_to_vector(F.array(*[F.col(f"__at_{done}")[cols.index(o)] for o in step["others"]]))) \
                if batches else VectorAssembler(inputCols=step["others"], outputCol="__x").transform(cur)
            labels = F.array(*[F.lit(x) for x in step["labels"]])
            scored = self.trees[step["tree"]].transform(state).drop("__x", "__cpr", "__cr")
            cur = scored.withColumn(c, F.when(F.col(f"`{flags[c]}`"), F.element_at(labels, F.col("__cp").cast("int") + 1))
                                    .otherwise(F.col(f"`{c}`"))).drop("__cp")
        if batches:
            last = F.col(f"__at_{len(nums)}")
            cur = _replace(cur, {c: F.when(F.col(f"`{flags[c]}`"), last[i]).otherwise(F.col(f"`{c}`").cast("double")) for i, c in enumerate(cols)})
            cur = cur.drop(*[f"__at_{k}" for k in places])
        return cur.drop(*flags.values())


# ------------------------------------------------------------------ E2 robust scaler
class RobustScaler(Estimator, _Stage):
    """(x - median) / (q75 - q25), quantiles taken from the data (no interpolation:
    the value at 0-based position ceil(n q) - 1); an IQR of 0 scales to 0."""

    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._init(inputCols, outputCols)

    def _fit(self, df):
        q = exact_quantiles(df, self._ins(), [0.25, 0.5, 0.75], method="disc").collect()
        st: dict[str, dict] = {}
        for r in q:
            st.setdefault(r["column"], {})[str(r["prob"])] = r["value"]
        return RobustScalerModel.of(self, st)


class RobustScalerModel(_FittedModel):
    def _transform(self, df):
        st = self._state()
        ex = {}
        for c, o in zip(self._ins(), self._outs()):
            s = st.get(c, {})
            med, q1, q3 = s.get("0.5"), s.get("0.25"), s.get("0.75")
            if med is None:
                ex[o] = F.lit(None).cast("double")
                continue
            iqr = q3 - q1
            ex[o] = (F.col(f"`{c}`").cast("double") - F.lit(med)) * F.lit(1.0 / iqr if iqr != 0 else 0.0)
        return _replace(df, ex)


# ------------------------------------------------------------------ E3 Yeo-Johnson
def yeo_johnson(x: Column, lam: float) -> Column:
    """Yeo & Johnson (2000) transform of a column for a fixed lambda."""
    pos = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    neg = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson_col(x: Column, lam: Column) -> Column:
    """The same transform with lambda taken from a column."""
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    neg = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


class YeoJohnson(Estimator, _Stage):
    """Lambda per column by maximum log-likelihood, first on -2..2 step 0.1, then on a
    step-0.01 grid of +-0.1 around the best (ties to the smaller lambda).

    LL(l) = -n/2 ln var_pop(yj(x, l)) + (l - 1) sum sign(x) ln(1 + |x|). Columns are
    stacked and each value is paired with the grid by a generator (no join), so one
    grouped aggregation with (columns x grid) groups scores every lambda of every column.
    """

    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._init(inputCols, outputCols)

    def _fit(self, df):
        cols = self._ins()
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols
        ])).alias("s")).select("s.column", "s.x").where(F.col("x").isNotNull())
        base = {r["column"]: (r["n"], r["sl"] or 0.0) for r in long.groupBy("column").agg(
            F.count("*").alias("n"), F.sum(F.signum("x") * F.log1p(F.abs("x"))).alias("sl")).collect()}
        best: dict[str, float] = {}
        # stage 1: the same 41 lambdas for every column
        g1 = long.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(40)))) \
            .withColumn("lam", (F.col("j") - 20) / F.lit(10.0))
        rows1 = g1.groupBy("column", "lam").agg(F.var_pop(yeo_johnson_col(F.col("x"), F.col("lam"))).alias("v")).collect()
        best = _pick(rows1, base)
        # stage 2: 21 lambdas of step 0.01 around each column's best
        centers = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(float(best.get(c, 1.0))))])
        g2 = long.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(20)))) \
            .withColumn("lam", F.element_at(centers, F.col("column")) + (F.col("j") - 10) / F.lit(100.0))
        rows2 = g2.groupBy("column", "lam").agg(F.var_pop(yeo_johnson_col(F.col("x"), F.col("lam"))).alias("v")).collect()
        best2 = _pick(rows2, base)
        lambdas = {c: best2.get(c, best.get(c, 1.0)) for c in cols}
        return YeoJohnsonModel.of(self, {"lambdas": lambdas})


def _pick(rows, base) -> dict[str, float]:
    """Best lambda per column from (column, lam, var_pop) rows; ties to the smaller lambda."""
    scored: dict[str, list] = {}
    for r in rows:
        n, s = base.get(r["column"], (0, 0.0))
        if r["v"] is None or r["v"] <= 0 or n == 0:
            continue
        scored.setdefault(r["column"], []).append((-(n / 2.0) * np.log(r["v"]) + (r["lam"] - 1) * s, -r["lam"], r["lam"]))
    return {c: max(v)[2] for c, v in scored.items()}


class YeoJohnsonModel(_FittedModel):
    def lambdas(self) -> dict[str, float]:
        return self._state()["lambdas"]

    def _transform(self, df):
        lam = self.lambdas()
        return _replace(df, {o: yeo_johnson(F.col(f"`{c}`").cast("double"), lam[c])
                             for c, o in zip(self._ins(), self._outs())})


# ------------------------------------------------------------------ E4 outliers
def remove_outliers(df: DataFrame, cols: list[str], share: float = 0.05, flag: str | None = None) -> DataFrame:
    """E4 (training rows only): drop rows whose squared Mahalanobis distance from the
    mean (sample covariance of ``cols``) is above its exact (1 - share) quantile.

    Equals the squared norm in whitened full-rank PCA space. With ``flag`` the
    rows are kept and marked instead. A null in ``cols`` raises: impute first.
    """
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=cols, outputCol="__x", handleInvalid="error")
    x = va.transform(df).withColumn("__one", F.lit(0.0))
    _, w, _, means, scat = class_moments(x, "__x", "__one")
    cov = scat[0] / max(w[0] - 1.0, 1.0)
    inv = np.linalg.pinv(cov)
    from pyspark.ml.functions import vector_to_array
    d2 = quad_form(vector_to_array(F.col("__x"), "float64"), means[0], inv)
    scored = x.withColumn("__d2", d2).drop("__x", "__one")
    cut = exact_quantiles(scored, ["__d2"], [1.0 - share]).first()["value"]
    if flag:
        return scored.withColumn(flag, (F.col("__d2") > F.lit(cut)).cast("int")).drop("__d2")
    return scored.where(F.col("__d2") <= F.lit(cut)).drop("__d2")


# ------------------------------------------------------------------ E6-E8 generated features
class FeatureGenerator(Transformer, _Stage):
    """E6 pairwise products ``a_x_b``, E7 ordered ratios ``a_div_b`` (divisor 0 -> 0),
    E8 squares ``a_sq`` (with the products, degree-2 polynomial terms).

    All of them are made: p numerics give p(p-1)/2 + p(p-1) + p columns, in the order
    products, ratios, squares. Switch a family off where that is too wide.
    """

    interactions = Param(Params._dummy(), "interactions", "products", TypeConverters.toBoolean)
    ratios = Param(Params._dummy(), "ratios", "ratios", TypeConverters.toBoolean)
    polynomial = Param(Params._dummy(), "polynomial", "squares", TypeConverters.toBoolean)

    def __init__(self, inputCols=None, interactions=True, ratios=True, polynomial=True):
        super().__init__()
        self._setDefault(interactions=True, ratios=True, polynomial=True)
        self._init(inputCols, None, interactions=interactions, ratios=ratios, polynomial=polynomial)

    def generated(self) -> dict[str, Column]:
        cols = self._ins()
        x = {c: F.col(f"`{c}`").cast("double") for c in cols}
        out: dict[str, Column] = {}
        if self.getOrDefault(self.interactions) or self.getOrDefault(self.polynomial):
            for a, b in combinations(cols, 2):
                out[f"{a}_x_{b}"] = x[a] * x[b]
        if self.getOrDefault(self.ratios):
            for a in cols:
                for b in cols:
                    if a != b:
                        out[f"{a}_div_{b}"] = F.coalesce(F.try_divide(x[a], x[b]), F.lit(0.0))
        if self.getOrDefault(self.polynomial):
            for a in cols:
                out[f"{a}_sq"] = x[a] * x[a]
        return out

    def _transform(self, df):
        return _replace(df, self.generated())


# ------------------------------------------------------------------ E9 rare levels
class RareLevelCombiner(Estimator, _Stage):
    """Levels whose training share is below ``threshold`` become ``__rare__``;
    levels unseen in training also do. At most 1/threshold levels are kept per column."""

    threshold = Param(Params._dummy(), "threshold", "share", TypeConverters.toFloat)

    def __init__(self, inputCols=None, outputCols=None, threshold=0.1):
        super().__init__()
        self._setDefault(threshold=0.1)
        self._init(inputCols, outputCols, threshold=threshold)

    def _fit(self, df):
        lc = value_counts_long(df, self._ins(), value_type="string")
        tot = lc.groupBy("column").agg(F.sum("cnt").alias("__n"))
        keep = lc.join(F.broadcast(tot), "column").where(
            F.col("cnt") / F.col("__n") >= self.getOrDefault(self.threshold)).select("column", "value").collect()
        st: dict[str, list] = {c: [] for c in self._ins()}
        for r in keep:
            st[r["column"]].append(r["value"])
        return RareLevelCombinerModel.of(self, {"keep": st})


class RareLevelCombinerModel(_FittedModel):
    threshold = RareLevelCombiner.threshold

    def _transform(self, df):
        keep = self._state()["keep"]
        ex = {}
        for c, o in zip(self._ins(), self._outs()):
            v = F.col(f"`{c}`").cast("string")
            kept = keep.get(c, [])
            ok = v.isin(kept) if kept else F.lit(False)
            ex[o] = F.when(v.isNull(), F.lit(None).cast("string")).when(ok, v).otherwise(F.lit(RARE))
        return _replace(df, ex)


# ------------------------------------------------------------------ E10 / E13 correlation filters
def correlation_matrix(df: DataFrame, cols: list[str], target: str | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """p x p Pearson matrix (and correlations with the target) from one pass of pair sums."""
    r = pair_correlations(df, [*cols, target] if target else cols)
    p = len(cols)
    t = r[:p, p] if target else None
    r = r[:p, :p].copy()
    np.fill_diagonal(r, 1.0)
    return r, t


def multicollinear_drop(r: np.ndarray, t: np.ndarray | None, cols: list[str], threshold: float) -> list[str]:
    """Greedy: pairs with |r| above the threshold, highest first; of a pair still whole,
    drop the one less correlated with the target (ties and no target: the later name)."""
    pairs = [(abs(r[i, j]), i, j) for i, j in combinations(range(len(cols)), 2)
             if not np.isnan(r[i, j]) and abs(r[i, j]) > threshold]
    pairs.sort(key=lambda x: (-x[0], x[1], x[2]))
    dropped: set[int] = set()
    for _, i, j in pairs:
        if i in dropped or j in dropped:
            continue
        if t is None:
            dropped.add(j)
            continue
        ti, tj = abs(np.nan_to_num(t[i])), abs(np.nan_to_num(t[j]))
        dropped.add(i if ti < tj else j)
    return [cols[i] for i in sorted(dropped)]


class CorrelationFilter(Estimator, _Stage):
    """E10 (threshold 0.9, target-aware) and E13 (``perfect=True``: |r| = 1 within 1e-9,
    drop the later column)."""

    threshold = Param(Params._dummy(), "threshold", "|r| above which a pair is collinear", TypeConverters.toFloat)
    targetCol = Param(Params._dummy(), "targetCol", "label column", TypeConverters.toString)
    perfect = Param(Params._dummy(), "perfect", "only exact collinearity", TypeConverters.toBoolean)

    def __init__(self, inputCols=None, threshold=0.9, targetCol=None, perfect=False):
        super().__init__()
        self._setDefault(threshold=0.9, perfect=False)
        self._init(inputCols, None, threshold=threshold, targetCol=targetCol, perfect=perfect)

    def _fit(self, df):
        cols = self._ins()
        perfect = self.getOrDefault(self.perfect)
        target = None if perfect or not self.isDefined(self.targetCol) else self.getOrDefault(self.targetCol)
        r, t = correlation_matrix(df, cols, target)
        thr = 1.0 - 1e-9 if perfect else self.getOrDefault(self.threshold)
        return CorrelationFilterModel.of(self, {"drop": multicollinear_drop(r, t, cols, thr)})


class CorrelationFilterModel(_FittedModel):
    threshold = CorrelationFilter.threshold
    targetCol = CorrelationFilter.targetCol
    perfect = CorrelationFilter.perfect

    def dropped(self) -> list[str]:
        return self._state()["drop"]

    def _transform(self, df):
        return df.drop(*self.dropped())


# ------------------------------------------------------------------ E12 low variance
class LowVarianceFilter(Estimator, _Stage):
    """Drop a categorical column when distinct/rows < 0.1 and the top level count is
    more than 20 times the second (Kuhn 2008); drop numeric columns with zero variance."""

    def __init__(self, inputCols=None):
        super().__init__()
        self._init(inputCols)

    def _fit(self, df):
        return LowVarianceFilterModel.of(self, {"drop": low_variance_columns(df, self._ins())})


def low_variance_columns(df: DataFrame, cols: list[str], unique_share: float = 0.1, ratio: float = 20.0) -> list[str]:
    from sparkselect.functions.ranking import top_k_per_group
    types = dict(df.dtypes)
    num = [c for c in cols if types[c] not in ("string", "boolean")]
    cat = [c for c in cols if c not in num]
    drop = []
    if num:
        row = df.agg(*[F.var_pop(F.col(f"`{c}`").cast("double")).alias(c) for c in num]).first()
        drop += [c for c in num if row[c] is None or row[c] == 0]
    if cat:
        n = df.count()
        lc = value_counts_long(df, cat, value_type="string")
        dist = {r["column"]: r["d"] for r in lc.groupBy("column").agg(F.count("*").alias("d")).collect()}
        top2 = top_k_per_group(lc, ["column"], [F.col("cnt").desc(), F.col("value").asc()], 2).collect()
        counts: dict[str, list] = {}
        for r in sorted(top2, key=lambda r: r["rank"]):
            counts.setdefault(r["column"], []).append(r["cnt"])
        for c in cat:
            cs = counts.get(c, [])
            if dist.get(c, 0) <= 1:
                drop.append(c)
            elif dist[c] / max(n, 1) < unique_share and len(cs) == 2 and cs[0] / cs[1] > ratio:
                drop.append(c)
    return [c for c in cols if c in drop]


class LowVarianceFilterModel(_FittedModel):
    def dropped(self) -> list[str]:
        return self._state()["drop"]

    def _transform(self, df):
        return df.drop(*self.dropped())


# ------------------------------------------------------------------ E15 count encoding
class CountEncoder(Estimator, _Stage):
    """Replace a level by its training row count; unseen levels get 0.

    The level table grows with the data, so it is stored as Parquet next to
    the model path when saved and joined at scoring; broadcast only when its
    measured row count is below ``broadcastRows``.
    """

    broadcastRows = Param(Params._dummy(), "broadcastRows", "broadcast limit", TypeConverters.toInt)

    def __init__(self, inputCols=None, outputCols=None, broadcastRows=1_000_000):
        super().__init__()
        self._setDefault(broadcastRows=1_000_000)
        self._init(inputCols, outputCols, broadcastRows=broadcastRows)

    def _fit(self, df):
        from sparkselect.session import materialize
        # the model keeps this table, so it must not hang on the rows it was counted from
        lc = materialize(value_counts_long(df, self._ins(), value_type="string"))
        m = CountEncoderModel.of(self, {"rows": {r["column"]: r["n"] for r in
                                                 lc.groupBy("column").agg(F.count("*").alias("n")).collect()}})
        m.levels = lc
        return m


class CountEncoderModel(_FittedModel):
    broadcastRows = CountEncoder.broadcastRows
    levels: DataFrame | None = None
    _sub_frames = ("levels",)

    def write(self):
        from sparkselect.operators.persist import CompositeWriter
        return CompositeWriter(self)

    @classmethod
    def read(cls):
        from sparkselect.operators.persist import CompositeReader
        return CompositeReader(cls)

    def _transform(self, df):
        if self.levels is None:
            raise ValueError("level table not loaded")
        rows = self._state()["rows"]
        out = df
        for c, o in zip(self._ins(), self._outs()):
            t = self.levels.where(F.col("column") == c).select(F.col("value").alias(f"__lv_{c}"),
                                                               F.col("cnt").alias(f"__cnt_{c}"))
            if rows.get(c, 0) <= self.getOrDefault(self.broadcastRows):
                t = F.broadcast(t)
            out = out.join(t, F.col(f"`{c}`").cast("string") == F.col(f"__lv_{c}"), "left")
            out = out.withColumn(o, F.coalesce(F.col(f"__cnt_{c}"), F.lit(0)).cast("bigint")) \
                .drop(f"__lv_{c}", f"__cnt_{c}")
        return out


# ------------------------------------------------------------------ E5 feature selection
def feature_scores(df: DataFrame, features: list[str], label: str, seed: int = 123) -> DataFrame:
    """E5 scores: mean of three shares per feature: random-forest importance, boosted-tree
    importance and |corr with the target|, each normalised to sum 1; features ordered by
    score with the cumulative share. A null in ``features`` raises: impute first."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    x = VectorAssembler(inputCols=features, outputCol="__fs", handleInvalid="error").transform(df)
    kept = stored_split(x.select("__fs", label), "feature-rows")
    x = kept.frame
    rf = RandomForestClassifier(featuresCol="__fs", labelCol=label, numTrees=50, seed=seed).fit(x)
    n_cls = x.select(label).distinct().count()
    if n_cls <= 2:
        gbt = GBTClassifier(featuresCol="__fs", labelCol=label, maxIter=20, seed=seed).fit(x)
        g = gbt.featureImportances.toArray()
    else:
        g = rf.featureImportances.toArray()
    kept.drop()
    r = rf.featureImportances.toArray()
    _, t = correlation_matrix(df, features, label)
    c = np.abs(np.nan_to_num(t))
    share = lambda v: v / v.sum() if v.sum() > 0 else np.zeros_like(v)
    score = (share(r) + share(g) + share(c)) / 3.0
    rows = sorted(zip(features, share(r), share(g), share(c), score), key=lambda z: (-z[4], z[0]))
    cum, out = 0.0, []
    for f, a, b, cc, s in rows:
        cum += s
        out.append((f, float(a), float(b), float(cc), float(s), float(cum)))
    return df.sparkSession.createDataFrame(out, "feature string, rf double, gbt double, corr double, score double, cumulative double")


def correlation_shares(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """The |corr| share part of E5 alone (exact)."""
    _, t = correlation_matrix(df, features, label)
    c = np.abs(np.nan_to_num(t))
    tot = c.sum()
    return df.sparkSession.createDataFrame([(f, float(v / tot if tot else 0.0)) for f, v in zip(features, c)],
                                           "feature string, corr_share double")


class FeatureSelector(Estimator, _Stage):
    """E5: keep the highest-scoring features until their cumulative share first reaches
    ``threshold`` (0.8)."""

    threshold = Param(Params._dummy(), "threshold", "cumulative share", TypeConverters.toFloat)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)

    def __init__(self, inputCols=None, labelCol="label", threshold=0.8):
        super().__init__()
        self._setDefault(threshold=0.8, labelCol="label")
        self._init(inputCols, None, labelCol=labelCol, threshold=threshold)

    def _fit(self, df):
        sc = feature_scores(df, self._ins(), self.getOrDefault(self.labelCol)).collect()
        keep = []
        for r in sc:
            keep.append(r["feature"])
            if r["cumulative"] >= self.getOrDefault(self.threshold):
                break
        return FeatureSelectorModel.of(self, {"keep": keep, "drop": [f for f in self._ins() if f not in keep]})


class FeatureSelectorModel(_FittedModel):
    threshold = FeatureSelector.threshold
    labelCol = FeatureSelector.labelCol

    def dropped(self) -> list[str]:
        return self._state()["drop"]

    def _transform(self, df):
        return df.drop(*self.dropped())


# ------------------------------------------------------------------ E11 cluster feature
class ClusterFeature(Estimator, _Stage):
    """K-means cluster id as a new categorical column; k in 2..8 chosen by the best
    silhouette, maxIter 20 (cluster_iter)."""

    outputCol = Param(Params._dummy(), "outputCol", "cluster column", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "k-means iterations", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self, inputCols=None, outputCol="cluster", maxIter=20, seed=123, ks=(2, 3, 4, 5, 6, 7, 8)):
        super().__init__()
        self._setDefault(outputCol="cluster", maxIter=20, seed=123)
        self._init(inputCols, None, outputCol=outputCol, maxIter=maxIter, seed=seed)
        self.ks = list(ks)

    def _fit(self, df):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.evaluation import ClusteringEvaluator
        from pyspark.ml.feature import StandardScaler, VectorAssembler
        va = VectorAssembler(inputCols=self._ins(), outputCol="__cx", handleInvalid="keep")
        sc = StandardScaler(inputCol="__cx", outputCol="__cz", withMean=True, withStd=True)
        # the scaler and every k read the rows: they are computed once, and by all cores
        table = stored_split(va.transform(df).select("__cx"), "cluster-rows")
        scm = sc.fit(table.frame)
        z = scm.transform(table.frame).select("__cz")
        best = None
        for k in self.ks:
            km = KMeans(featuresCol="__cz", predictionCol="__cl", k=k, maxIter=self.getOrDefault(self.maxIter),
                        seed=self.getOrDefault(self.seed)).fit(z)
            sil = ClusteringEvaluator(featuresCol="__cz", predictionCol="__cl").evaluate(km.transform(z))
            if best is None or sil > best[0]:
                best = (sil, k, km)
        table.drop()
        centers = [c.tolist() for c in best[2].clusterCenters()]
        return ClusterFeatureModel.of(self, {"k": best[1], "silhouette": best[0], "centers": centers,
                                             "mean": scm.mean.toArray().tolist(), "std": scm.std.toArray().tolist()})


class ClusterFeatureModel(_FittedModel):
    outputCol = ClusterFeature.outputCol
    maxIter = ClusterFeature.maxIter
    seed = ClusterFeature.seed

    def _transform(self, df):
        st = self._state()
        z = [(F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s if s else 1.0)
             for c, m, s in zip(self._ins(), st["mean"], st["std"])]
        d = [sum(((zi - F.lit(ci)) * (zi - F.lit(ci)) for zi, ci in zip(z, cen)), F.lit(0.0)) for cen in st["centers"]]
        arr = F.array(*d)
        return df.withColumn(self.getOrDefault(self.outputCol),
                             (F.array_position(arr, F.array_min(arr)) - 1).cast("string"))
