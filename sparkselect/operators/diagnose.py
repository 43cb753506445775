"""Model diagnostics as tables (I1-I17): the data behind each picture.

Curves are built from per-score counts: rows are first grouped by score
(map-side combined, so a score shared by a third of the rows costs nothing
extra), then running totals over the distinct scores are taken with the
sliced exact method, never a one-task window over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkselect.functions.metrics import confusion_counts
from sparkselect.functions.ranking import row_number_exact, running_totals
from sparkselect.session import stored_wide, tasks


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("__k", F.lit(1))


def score_counts(scored: DataFrame, y: str, score: str, by: Sequence[str] = (), positive=1) -> DataFrame:
    """(by..., score, pos, neg) per distinct score."""
    from sparkselect.session import materialize
    is_pos = (F.col(y) == positive).cast("double")
    # one row per distinct score, read by several passes: materialised once
    return materialize(scored.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(
        *by, F.col(score).cast("double").alias("score")
    ).agg(F.sum(is_pos).alias("pos"), F.sum(1 - is_pos).alias("neg")))


def _cumulative_desc(sc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add tp, fp (rows with score >= this score) and P, N totals."""
    # descending score as an ascending key on -score (one direction for slices and windows)
    cum = running_totals(sc, [-F.col("score")], {"tp": "pos", "fp": "neg"}, list(by))
    tot = sc.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if by:
        return cum.join(F.broadcast(tot), list(by))
    return _one(cum).join(F.broadcast(_one(tot)), "__k").drop("__k")


def roc_table(scored: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score; positive when score >= threshold."""
    c = _cumulative_desc(score_counts(scored, y, score, by), by)
    return c.select(*by, F.col("score").alias("threshold"), F.try_divide("fp", "N").alias("fpr"),
                    F.try_divide("tp", "P").alias("tpr"))


def auc_score(scored: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC from scores, rank form with average ranks (equals the trapezoid ROC area)."""
    sc = score_counts(scored, y, score, by).withColumn("cnt", F.col("pos") + F.col("neg"))
    cum = running_totals(sc, [F.col("score")], {"__c": "cnt"}, list(by))
    cum = cum.withColumn("avg_rank", F.col("__c") - F.col("cnt") + (F.col("cnt") + 1) / 2.0)
    g = cum.groupBy(*by).agg(F.sum(F.col("pos") * F.col("avg_rank")).alias("rs"), F.sum("pos").alias("P"),
                             F.sum("neg").alias("N"))
    return g.select(*by, F.try_divide(F.col("rs") - F.col("P") * (F.col("P") + 1) / 2,
                                      F.col("P") * F.col("N")).alias("auc"))


def confusion_table(scored: DataFrame, y: str, yhat: str) -> DataFrame:
    """Every (actual, predicted) pair of labels, with count and share of rows."""
    cc = confusion_counts(scored, y, yhat)
    # the label set is at most the number of classes: one small array, exploded twice
    labels = cc.select(F.explode(F.array("y", "yhat")).alias("l")).distinct()
    grid = labels.agg(F.collect_set("l").alias("ls")).select(F.explode("ls").alias("y"), "ls") \
        .select("y", F.explode("ls").alias("yhat"))
    n = cc.agg(F.sum("cnt").alias("__n"))
    out = grid.join(cc, ["y", "yhat"], "left").fillna(0, ["cnt"])
    return _one(out).join(F.broadcast(_one(n)), "__k").select(
        F.col("y").alias("actual"), F.col("yhat").alias("predicted"), F.col("cnt").cast("bigint").alias("count"),
        F.try_divide(F.col("cnt"), F.col("__n")).alias("share"))


def threshold_table(scored: DataFrame, y: str, score: str, steps: int = 100) -> DataFrame:
    """I4: precision, recall, f1 and queue rate at thresholds i/steps, i = 0..steps.

    Each row is counted once in the bucket of the highest threshold it
    reaches (exact double comparison), so the table is a running sum over
    steps + 1 buckets, not a join of rows with thresholds.
    """
    s = F.col(score).cast("double")
    c = F.floor(s * steps)
    c = F.when(F.lit(1.0) * (c + 1) / steps <= s, c + 1).when(F.lit(1.0) * c / steps > s, c - 1).otherwise(c)
    b = F.when(s < 0, F.lit(-1)).when(s >= 1, F.lit(steps)).otherwise(c).cast("int")
    is_pos = (F.col(y) == 1).cast("double")
    from sparkselect.session import materialize
    per = materialize(scored.where(F.col(score).isNotNull()).groupBy(b.alias("b")).agg(
        F.sum(is_pos).alias("pos"), F.count("*").cast("double").alias("cnt")))
    tot = per.agg(F.sum("pos").alias("P"), F.sum("cnt").alias("n"))
    # steps + 1 thresholds, each joined to its own bucket; counts at or above a
    # threshold are a running sum from the top over these steps + 1 rows
    grid = per.sparkSession.range(0, steps + 1).select(F.col("id").cast("int").alias("i"))
    j = grid.join(F.broadcast(per), F.col("i") == F.col("b"), "left").fillna(0.0, ["pos", "cnt"])
    top = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    j = j.select("i", F.sum("pos").over(top).alias("tp"), F.sum("cnt").over(top).alias("pp"))
    j = _one(j).join(F.broadcast(_one(tot)), "__k")
    prec = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(F.lit(0.0))
    rec = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(0.0))
    return j.select((F.col("i") / F.lit(float(steps))).alias("threshold"), prec.alias("precision"),
                    rec.alias("recall"),
                    F.when(F.col("pp") + F.col("P") > 0, 2 * F.col("tp") / (F.col("pp") + F.col("P")))
                    .otherwise(F.lit(0.0)).alias("f1"),
                    F.try_divide(F.col("pp"), F.col("n")).alias("queue_rate"))


def pr_table(scored: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, recall, precision) per distinct score, plus average precision
    AP = sum over thresholds (descending) of (R_k - R_{k-1}) P_k, on every row."""
    c = _cumulative_desc(score_counts(scored, y, score))
    c = c.withColumn("recall", F.try_divide("tp", "P")).withColumn(
        "precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))
    ap = c.agg(F.sum(F.try_divide(F.col("pos"), F.col("P")) * F.col("precision")).alias("average_precision"))
    return _one(c).join(F.broadcast(_one(ap)), "__k").select(
        F.col("score").alias("threshold"), "recall", "precision", "average_precision")


def error_table(scored: DataFrame, y: str, yhat: str) -> DataFrame:
    """(predicted, actual, count): per predicted class, how many of each actual class."""
    cc = confusion_counts(scored, y, yhat)
    return cc.select(F.col("yhat").alias("predicted"), F.col("y").alias("actual"),
                     F.col("cnt").cast("bigint").alias("count"))


def class_report(scored: DataFrame, y: str, yhat: str) -> DataFrame:
    """Per class precision, recall, f1 and support (one-vs-rest sums of the confusion table)."""
    cc = confusion_counts(scored, y, yhat)
    act = cc.groupBy(F.col("y").alias("cls")).agg(F.sum("cnt").alias("support"),
                                                  F.sum(F.when(F.col("y") == F.col("yhat"), F.col("cnt"))
                                                        .otherwise(0)).alias("tp"))
    pred = cc.groupBy(F.col("yhat").alias("cls")).agg(F.sum("cnt").alias("pp"))
    r = act.join(pred, "cls", "full").fillna(0, ["support", "tp", "pp"])
    return r.select(F.col("cls").alias("class"),
                    F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(F.lit(0.0)).alias("precision"),
                    F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0)).alias("recall"),
                    F.when(F.col("pp") + F.col("support") > 0, 2 * F.col("tp") / (F.col("pp") + F.col("support")))
                    .otherwise(F.lit(0.0)).alias("f1"),
                    F.col("support").cast("bigint").alias("support"))


def calibration_table(scored: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """Equal-width score bins on [0, 1]: mean score, observed positive rate, count."""
    s = F.col(score).cast("double")
    b = F.least(F.greatest(F.floor(s * bins), F.lit(0)), F.lit(bins - 1)).cast("bigint")
    return scored.where(s.isNotNull()).groupBy(b.alias("bin")).agg(
        F.avg(s).alias("mean_score"), F.avg((F.col(y) == 1).cast("double")).alias("observed_rate"),
        F.count("*").cast("bigint").alias("count"))


def brier_score(scored: DataFrame, y: str, score: str) -> DataFrame:
    """Mean squared gap between score and outcome."""
    e = F.col(score).cast("double") - (F.col(y) == 1).cast("double")
    return scored.agg(F.avg(e * e).alias("brier"))


def deciles(scored: DataFrame, score: str, key: str, groups: int = 10, name: str = "decile") -> DataFrame:
    """``ntile(groups) over (order by score desc, key)``, exact and sliced."""
    n = scored.count()
    ranked = row_number_exact(scored, [-F.col(score).cast("double"), F.col(key)], name="__rn")
    q, r = divmod(n, groups)
    rn = F.col("__rn")
    big = F.lit(r * (q + 1))
    tile = F.when(rn <= big, F.floor((rn - 1) / F.lit(q + 1)) + 1)
    if q > 0:
        tile = tile.otherwise(F.lit(r) + F.floor((rn - big - 1) / F.lit(q)) + 1)
    return ranked.withColumn(name, tile.cast("bigint")).drop("__rn")


def lift_table(scored: DataFrame, y: str, score: str, key: str, groups: int = 10) -> DataFrame:
    """Per decile of score (highest first): rows, positives, rate and lift over the base rate."""
    from sparkselect.session import materialize
    d = materialize(deciles(scored.where(F.col(score).isNotNull()).select(key, score, y), score, key, groups))
    per = d.groupBy("decile").agg(F.count("*").cast("bigint").alias("rows"),
                                  F.sum((F.col(y) == 1).cast("long")).cast("bigint").alias("positives"))
    base = d.agg(F.avg((F.col(y) == 1).cast("double")).alias("__base"))
    return _one(per).join(F.broadcast(_one(base)), "__k").select(
        "decile", "rows", "positives", (F.col("positives") / F.col("rows")).alias("rate"),
        F.try_divide(F.col("positives") / F.col("rows"), F.col("__base")).alias("lift"))


def gain_table(scored: DataFrame, y: str, score: str, key: str, groups: int = 10) -> DataFrame:
    """I16: cumulative share of rows and of positives by decile."""
    lt = lift_table(scored, y, score, key, groups)
    w = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)  # <= groups rows
    tot = Window.partitionBy()
    return lt.select("decile", (F.sum("rows").over(w) / F.sum("rows").over(tot)).alias("share_rows"),
                     F.try_divide(F.sum("positives").over(w), F.sum("positives").over(tot)).alias("share_positives"))


def ks_table(scored: DataFrame, y: str, score: str) -> DataFrame:
    """Per distinct threshold, cumulative shares of positives and negatives at or
    above it, their gap, and ``is_max`` on the threshold(s) of the largest gap."""
    c = _cumulative_desc(score_counts(scored, y, score))
    c = c.select(F.col("score").alias("threshold"), F.try_divide("tp", "P").alias("cum_pos"),
                 F.try_divide("fp", "N").alias("cum_neg"))
    c = c.withColumn("gap", F.col("cum_pos") - F.col("cum_neg"))
    mx = c.agg(F.max("gap").alias("ks"))
    return _one(c).join(F.broadcast(_one(mx)), "__k").select(
        "threshold", "cum_pos", "cum_neg", "gap", "ks", (F.col("gap") == F.col("ks")).cast("bigint").alias("is_max"))


# ------------------------------------------------------------------ model tables
import numpy as _np  # noqa: E402
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler  # noqa: E402
from pyspark.ml.functions import array_to_vector, vector_to_array  # noqa: E402

from sparkselect.functions.hashing import hash_small, hash_unit  # noqa: E402


def interpret_linear(df: DataFrame, coef: dict[str, float], key: str) -> tuple[DataFrame, DataFrame]:
    """I1 for linear models: contribution = coef x (x - mean x) per row and feature,
    and the mean absolute contribution per feature."""
    means = df.agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in coef]).first()
    long = df.select(F.col(key), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 (F.lit(float(w)) * (F.col(f"`{c}`") - F.lit(means[c]))).alias("contribution"))
        for c, w in coef.items()])).alias("s")).select(key, "s.feature", "s.contribution")
    summary = long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
    return long, summary


def model_coefficients(model, features: list[str]) -> dict[str, float] | None:
    """Linear coefficients of a fitted model (binary), if it has them."""
    for attr in ("coefficients",):
        if hasattr(model, attr):
            try:
                v = getattr(model, attr)
                v = v() if callable(v) else v
                arr = v.toArray() if hasattr(v, "toArray") else _np.asarray(v, dtype=float)
                if arr.ndim == 2:
                    arr = arr[-1] - arr[0]
                return dict(zip(features, arr.tolist()))
            except Exception:  # noqa: BLE001
                return None
    return None


def interpret_shapley(model, df: DataFrame, features: list[str], key: str, draws: int = 16,
                      background: int = 100, seed: int = 123, positive: int = 1) -> DataFrame:
    """I1 for any model: sampled Shapley values (Strumbelj & Kononenko 2014).

    For row x, feature j and draw m: a random order of the features and a
    background row z (both from key hashes); x+ takes x on the features up to
    and including j in that order and z elsewhere, x- the same without j. The
    value is the mean over draws of f(x+) - f(x-), f = probability of the
    positive class (or the label). The background is a hash-chosen sample of
    ``background`` rows (bounded, broadcast); scoring is one batched transform.
    """
    p = len(features)
    bg = df.select(*features).withColumn("__h", hash_unit(F.to_json(F.struct(*features)), seed)) \
        .orderBy("__h").limit(background).withColumn("__bi", F.row_number().over(Window.orderBy("__h")) - 1)
    nbg = bg.count()
    base = df.select(F.col(key), *[F.col(f).cast("double").alias(f) for f in features])
    # a row costs p x draws scorings of two points: rows of a small file are dealt to all cores
    base = base.repartition(tasks(df.sparkSession), *base.columns)
    ex = base.withColumn("feature_idx", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))) \
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    tag = F.concat_ws(":", F.col(key).cast("string"), F.col("feature_idx").cast("string"), F.col("draw").cast("string"))
    # position of every feature in this draw's random order: rank of hash(tag, f), hashed once a draw
    ranks = F.array(*[hash_small(F.concat(tag, F.lit(f":{i}")), seed + 1, 8) for i in range(p)])
    ex = ex.withColumns({"__bi": (hash_small(tag, seed, 8) % F.lit(nbg)).cast("int"), "__ranks": ranks})
    ex = ex.join(F.broadcast(bg.select("__bi", *[F.col(f).cast("double").alias(f"__z_{f}") for f in features])), "__bi")
    mine = F.element_at("__ranks", F.col("feature_idx") + 1)
    plus, minus = [], []
    for i, f in enumerate(features):
        before = F.col("__ranks")[i] < mine
        is_j = F.col("feature_idx") == i
        plus.append(F.when(before | is_j, F.col(f)).otherwise(F.col(f"__z_{f}")))
        minus.append(F.when(before, F.col(f)).otherwise(F.col(f"__z_{f}")))
    feats_col = model.getOrDefault("featuresCol") if model.hasParam("featuresCol") else "features"
    both = ex.select(key, "feature_idx", "draw", F.explode(F.array(
        F.struct(F.lit(1.0).alias("sign"), array_to_vector(F.array(*plus)).alias(feats_col)),
        F.struct(F.lit(-1.0).alias("sign"), array_to_vector(F.array(*minus)).alias(feats_col)))).alias("s")) \
        .select(key, "feature_idx", "draw", "s.sign", f"s.{feats_col}")
    scored = model.transform(both)
    f_val = vector_to_array("probability")[positive] if "probability" in scored.columns else F.col("prediction")
    contrib = scored.groupBy(key, "feature_idx").agg((F.sum(F.col("sign") * f_val) / F.lit(float(draws))).alias("shap"))
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("feature_idx") + 1)
    return contrib.select(key, names.alias("feature"), "shap")


def vector_names(df: DataFrame, features: str = "features") -> list[str]:
    """The name of every slot of an assembled vector column, from its attributes."""
    attrs = df.schema[features].metadata.get("ml_attr", {})
    named = {a["idx"]: a.get("name", f"{features}_{a['idx']}") for kind in attrs.get("attrs", {}).values() for a in kind}
    size = attrs.get("num_attrs", len(named))
    return [named.get(i, f"{features}_{i}") for i in range(size)]


def feature_importance(model, features: list[str]) -> DataFrame | None:
    """(feature, importance, rank) from featureImportances or |coefficients|."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = None
    if hasattr(model, "featureImportances"):
        imp = model.featureImportances.toArray()
    else:
        co = model_coefficients(model, features)
        if co is not None:
            imp = _np.abs(_np.array([co[f] for f in features]))
    if imp is None:
        return None
    if len(imp) != len(features):
        raise ValueError(f"{len(imp)} importances for {len(features)} names: pass one name per slot (vector_names)")
    rows = sorted(zip(features, [float(x) for x in imp], strict=True), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank bigint")


def permutation_importance(model, df: DataFrame, features: list[str], label: str, key: str, metric: str = "accuracy",
                           seed: int = 123) -> DataFrame:
    """I11 fallback: drop in the metric when one feature is replaced by its value on a
    hash-chosen other row (a shuffle by key order, done with a join on a rank)."""
    from sparkselect.functions.metrics import classification_metrics
    from sparkselect.functions.ranking import row_number_exact
    va = VectorAssembler(inputCols=features, outputCol="features")
    base_m = classification_metrics(model.transform(va.transform(df)), label, "prediction").first()[metric]
    n = df.count()
    ranked = row_number_exact(df, [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)],
                              name="__r")
    rows = []
    for f in features:
        donor = ranked.select((F.col("__r") % n + 1).alias("__r"), F.col(f).alias("__d"))
        perm = ranked.join(donor, "__r").withColumn(f, F.col("__d")).drop("__d", "__r")
        m = classification_metrics(model.transform(va.transform(perm)), label, "prediction").first()[metric]
        rows.append((f, float(base_m - m)))
    rows.sort(key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(rows)],
                                           "feature string, importance double, rank bigint")


def rfe_table(estimator, df: DataFrame, features: list[str], label: str = "label", fold: str = "fold",
              metric: str = "accuracy", min_features: int = 1) -> DataFrame:
    """I8: recursive elimination; at each step cross-validate, then drop the least important feature."""
    # every step and fold reads the rows: folds are numbered once, and their partitions stay (split points are sampled by partition)
    base = df.cache()
    try:
        return _rfe_rows(estimator, base, features, label, fold, metric, min_features)
    finally:
        base.unpersist()


def _rfe_rows(estimator, df: DataFrame, features: list[str], label: str, fold: str, metric: str, min_features: int) -> DataFrame:
    from sparkselect.operators.select import cross_validate
    cur, rows = list(features), []
    while len(cur) >= min_features:
        va = VectorAssembler(inputCols=cur, outputCol="__rfe")
        est = estimator.copy({estimator.featuresCol: "__rfe"})
        data = va.transform(df)
        _, s = cross_validate(est, data, label, fold, name="rfe", cache=False)
        score_ = s.first()[metric]
        model = est.fit(data)
        imp = feature_importance(model, cur)
        if imp is None:
            order = list(cur)
        else:
            order = [r["feature"] for r in imp.orderBy("rank").collect()]
        rows.append((len(cur), score_, ",".join(cur), order[-1] if len(cur) > min_features else None))
        if len(cur) == min_features:
            break
        cur = [c for c in cur if c != order[-1]]
    return df.sparkSession.createDataFrame(rows, "n_features bigint, score double, features string, dropped string")


# Training-size steps of the learning curve.
LEARNING_STEPS = [0.1, 0.325, 0.55, 0.775, 1.0]


def learning_sizes(df: DataFrame, key: str, fold: str = "fold", steps=None, seed: int = 123) -> DataFrame:
    """I9 sample sizes: training rows per (step, fold) of the nested hash samples."""
    steps = list(steps or LEARNING_STEPS)
    u = hash_unit(key, seed)
    folds = df.select(fold).distinct()
    rows = df.select(F.col(fold).alias("__f"), u.alias("__u")).withColumn(
        "share", F.explode(F.array(*[F.lit(float(s)) for s in steps]))).where(F.col("__u") < F.col("share"))
    per = rows.groupBy("share", "__f").agg(F.count("*").alias("n"))
    tot = per.groupBy("share").agg(F.sum("n").alias("all"))
    return per.join(tot, "share").select("share", F.col("__f").alias("fold"),
                                         (F.col("all") - F.col("n")).cast("bigint").alias("train_rows"))


def learning_table(estimator, df: DataFrame, key: str, label: str = "label", fold: str = "fold",
                   metric: str = "accuracy", steps=LEARNING_STEPS, seed: int = 123) -> DataFrame:
    """Train rows, train metric and CV metric at nested hash samples of the training folds.

    The rows with their folds and hashes are written once; the steps run side by side."""
    from sparkselect.functions.metrics import classification_metrics
    table = stored_wide(df.withColumn("__u", hash_unit(key, seed)), "learning-rows")
    base, u = table.frame, F.col("__u")
    counts = base.groupBy(fold).agg(*[F.sum((u < F.lit(float(s))).cast("long")).alias(f"n{i}") for i, s in enumerate(steps)]).collect()
    folds = sorted(r[0] for r in counts)

    def step(i: int) -> tuple:
        parts, s = [], float(steps[i])
        for f in folds:
            train = base.where((F.col(fold) != f) & (u < F.lit(s)))
            m = estimator.copy().fit(train)
            for kind, rows in (("cv", base.where(F.col(fold) == f)), ("train", train)):
                parts.append(m.transform(rows).select(F.lit(kind).alias("kind"), F.col(label).alias("y"), F.col("prediction").alias("yhat")))
        stacked = parts[0]
        for p in parts[1:]:
            stacked = stacked.unionByName(p)
        score = {r["kind"]: r[metric] for r in classification_metrics(stacked, "y", "yhat", ["kind"]).collect()}
        own = [r[f"n{i}"] or 0 for r in counts]
        return s, int(_np.mean([sum(own) - n for n in own])), score.get("train"), score.get("cv")

    with ThreadPoolExecutor(len(steps)) as pool:
        rows = list(pool.map(step, range(len(steps))))
    table.drop()
    return df.sparkSession.createDataFrame(rows, "share double, train_rows bigint, train_score double, cv_score double")


def validation_table(estimator, param: str, values: list, df: DataFrame, label: str = "label", fold: str = "fold",
                     metric: str = "accuracy") -> DataFrame:
    """Train and CV metric for each value of one parameter."""
    from sparkselect.functions.metrics import classification_metrics
    from sparkselect.operators.select import cross_validate, fold_frames, release
    candidates = [estimator.copy({estimator.getParam(param): v}) for v in values]
    models = [est.fit(df) for est in candidates]  # before the rows are kept: split points are sampled by partition
    frames, rows = fold_frames(df, fold), []  # every value reads the same numbered folds
    for v, est, m in zip(values, candidates, models, strict=True):
        _, s = cross_validate(est, None, label, fold, name=str(v), frames=frames)
        tr = classification_metrics(m.transform(df), label, "prediction").first()[metric]
        rows.append((str(v), tr, s.first()[metric]))
    release(frames)
    return df.sparkSession.createDataFrame(rows, "value string, train_score double, cv_score double")


def dimension_table(df: DataFrame, features: list[str], label: str, key: str, k: int = 2):
    """Standardised PCA to k components: (key, pc1.., class) and explained variance shares.
    A null in ``features`` raises: impute first."""
    va = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="error")
    sc = StandardScaler(inputCol="__x", outputCol="__z", withMean=True, withStd=True)
    x = va.transform(df)
    scm = sc.fit(x)
    z = scm.transform(x)
    pca = PCA(k=k, inputCol="__z", outputCol="__pc").fit(z)
    arr = vector_to_array("__pc")
    rows = pca.transform(z).select(F.col(key), *[arr[i].alias(f"pc{i + 1}") for i in range(k)],
                                   F.col(label).alias("class"))
    var = df.sparkSession.createDataFrame([(i + 1, float(v)) for i, v in enumerate(pca.explainedVariance.toArray())],
                                          "component bigint, explained_variance double")
    return rows, var, (scm, pca)


def boundary_table(model, df: DataFrame, features: list[str], steps: int = 50) -> DataFrame:
    """Predicted class over a steps x steps grid of the first two standardised
    principal components, mapped back to feature space (grid bounded by ``steps``). A null
    in ``features`` raises: impute first."""
    va = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="error")
    x = va.transform(df)
    scm = StandardScaler(inputCol="__x", outputCol="__z", withMean=True, withStd=True).fit(x)
    z = scm.transform(x)
    pca = PCA(k=2, inputCol="__z", outputCol="__pc").fit(z)
    arr = vector_to_array("__pc")
    r = pca.transform(z).select(arr[0].alias("a"), arr[1].alias("b")).agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    spark = df.sparkSession
    grid = spark.range(steps).select(F.col("id").alias("i")).select(
        "i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("j"))
    g1 = F.lit(r[0]) + F.col("i") * F.lit((r[1] - r[0]) / max(steps - 1, 1))
    g2 = F.lit(r[2]) + F.col("j") * F.lit((r[3] - r[2]) / max(steps - 1, 1))
    pcs = pca.pc.toArray()
    mean, std = scm.mean.toArray(), scm.std.toArray()
    feats_col = model.getOrDefault("featuresCol") if model.hasParam("featuresCol") else "features"
    back = [F.lit(float(mean[d])) + F.lit(float(std[d])) * (g1 * F.lit(float(pcs[d, 0])) + g2 * F.lit(float(pcs[d, 1])))
            for d in range(len(features))]
    pts = grid.select(g1.alias("grid_x"), g2.alias("grid_y"), array_to_vector(F.array(*back)).alias(feats_col))
    return model.transform(pts).select("grid_x", "grid_y", F.col("prediction").alias("predicted"))


def best_split_table(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """F11 companion: for each feature the exact best binary split ``x <= threshold`` by
    Gini decrease over all distinct values (binary label 0/1; ties to the lower threshold).
    Built from per-value class counts and sliced running totals, so a feature with
    billions of distinct values is not held by one task."""
    from sparkselect.functions.ranking import running_totals, top_k_per_group
    pos = (F.col(label) == 1).cast("double")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                                         for f in features])).alias("s"), pos.alias("__p")) \
        .select("s.feature", "s.value", "__p").where("value is not null")
    vc = long.groupBy("feature", "value").agg(F.sum("__p").alias("p"), F.sum(1 - F.col("__p")).alias("q"))
    cum = running_totals(vc, ["value"], {"lp": "p", "lq": "q"}, ["feature"])
    tot = vc.groupBy("feature").agg(F.sum("p").alias("__tp"), F.sum("q").alias("__tq"))
    c = cum.join(F.broadcast(tot), "feature")
    L = F.col("lp") + F.col("lq")
    N = F.col("__tp") + F.col("__tq")
    R = N - L
    rp, rq = F.col("__tp") - F.col("lp"), F.col("__tq") - F.col("lq")
    gini = lambda a, b, n: F.lit(1.0) - (a * a + b * b) / (n * n)
    gain = gini(F.col("__tp"), F.col("__tq"), N) - (L / N) * gini(F.col("lp"), F.col("lq"), L) - (R / N) * gini(rp, rq, R)
    splits = c.where(R > 0).select("feature", F.col("value").alias("threshold"), gain.alias("gain"),
                                   L.cast("bigint").alias("left_rows"), R.cast("bigint").alias("right_rows"))
    best = top_k_per_group(splits, ["feature"], [F.col("gain").desc(), F.col("threshold").asc()], 1)
    return best.drop("rank")
