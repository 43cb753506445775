"""Classification metrics from one grouped confusion count (H1-H9).

Every metric of the comparison table is a function of the counts
``(group, y, yhat) -> cnt``, so a whole table of candidates costs one
aggregation over the scored rows; everything after it runs on at most
groups x classes^2 rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric names in the order of the comparison table.
METRICS = ["accuracy", "auc", "recall", "precision", "f1", "kappa", "mcc"]
METRIC_ALIASES = {"accuracy": "accuracy", "auc": "auc", "recall": "recall", "precision": "precision",
                  "prec.": "precision", "f1": "f1", "kappa": "kappa", "mcc": "mcc"}


def metric_name(name: str) -> str:
    key = name.strip().lower()
    if key not in METRIC_ALIASES:
        raise ValueError(f"unknown metric {name!r}; choose from {METRICS}")
    return METRIC_ALIASES[key]


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson r over rows where both are present: covar_pop / (sd_pop sd_pop); null (not an
    ANSI division error) when a column is constant."""
    both = a.isNotNull() & b.isNotNull()
    aa, bb = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(aa, bb), F.stddev_pop(aa) * F.stddev_pop(bb))


def confusion_counts(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., y, yhat, cnt) over rows with both labels present."""
    return df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(
        *by, F.col(y).cast("double").alias("y"), F.col(yhat).cast("double").alias("yhat")
    ).agg(F.count("*").alias("cnt"))


def _div(a: Column, b: Column, default=0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def metrics_from_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Seven metrics per group from a confusion count table.

    Binary metrics (auc on hard labels, recall, precision, f1) take 1 as the
    positive class and are null when a label outside {0, 1} occurs; auc is
    also null when the truth has one class. Undefined ratios are 0, as the
    usual library rule; kappa is null when chance agreement is 1.
    """
    keys = list(by) or ["__all"]
    c = counts if by else counts.withColumn("__all", F.lit(1))
    y, yh, n_ = F.col("y"), F.col("yhat"), F.col("cnt")

    def s(cond):
        return F.sum(F.when(cond, n_).otherwise(F.lit(0))).cast("double")

    base = c.groupBy(*keys).agg(
        F.sum(n_).cast("double").alias("n"),
        s(y == yh).alias("correct"),
        s((y == 1) & (yh == 1)).alias("tp"), s((y == 0) & (yh == 1)).alias("fp"),
        s((y == 1) & (yh == 0)).alias("fn"), s((y == 0) & (yh == 0)).alias("tn"),
        F.max(F.when(~y.isin(0.0, 1.0) | ~yh.isin(0.0, 1.0), 1).otherwise(0)).alias("nonbin"),
        F.countDistinct(y).alias("ny"))
    actual = c.groupBy(*keys, F.col("y").alias("cls")).agg(F.sum(n_).cast("double").alias("t"))
    pred = c.groupBy(*keys, F.col("yhat").alias("cls")).agg(F.sum(n_).cast("double").alias("p"))
    cls = actual.join(pred, [*keys, "cls"], "full").fillna(0.0, ["t", "p"])
    sums = cls.groupBy(*keys).agg(F.sum(F.col("t") * F.col("p")).alias("stp"),
                                  F.sum(F.col("p") * F.col("p")).alias("spp"),
                                  F.sum(F.col("t") * F.col("t")).alias("stt"))
    m = base.join(sums, keys, "inner")
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    binary = F.col("nonbin") == 0
    po = F.col("correct") / n
    pe = F.col("stp") / (n * n)
    mcc_den = F.sqrt((n * n - F.col("stt")) * (n * n - F.col("spp")))
    out = m.select(
        *keys, F.col("n").cast("bigint").alias("n"),
        po.alias("accuracy"),
        F.when(binary & (F.col("ny") == 2),
               (_div(tp, tp + fn) + _div(tn, tn + fp)) / 2).alias("auc"),
        F.when(binary, _div(tp, tp + fn)).alias("recall"),
        F.when(binary, _div(tp, tp + fp)).alias("precision"),
        F.when(binary, _div(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        F.when(pe != 1, (po - pe) / (1 - pe)).alias("kappa"),
        _div(F.col("correct") * n - F.col("stp"), mcc_den).alias("mcc"))
    return out if by else out.drop("__all")


def classification_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """H1-H7 per group of ``by`` for truth ``y`` and predicted label ``yhat``.

    The confusion counts (groups x classes^2 rows) are materialised once, so
    the scored rows are read by a single pass however many tables follow."""
    from sparkselect.session import materialize
    return metrics_from_counts(materialize(confusion_counts(df, y, yhat, by)), by)


def stack_predictions(df: DataFrame, y: str, pred_cols: dict[str, str], name: str = "model") -> DataFrame:
    """Long form (model, y, yhat) of several prediction columns of one frame."""
    pairs = [F.struct(F.lit(m).alias(name), F.col(c).cast("double").alias("yhat")) for m, c in pred_cols.items()]
    return df.select(F.col(y).cast("double").alias(y), F.explode(F.array(*pairs)).alias("__p")) \
        .select(F.col(f"__p.{name}").alias(name), F.col(y), F.col("__p.yhat").alias("yhat"))


def metric_table(df: DataFrame, y: str, pred_cols: dict[str, str]) -> DataFrame:
    """H8: one row per model with the seven metrics; one aggregation for all models."""
    long = stack_predictions(df, y, pred_cols)
    return classification_metrics(long, y, "yhat", ["model"])


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """K2: MAE, MSE, RMSE, R2 and MAPE in one aggregation (MAPE over rows with y != 0)."""
    e = F.col(yhat) - F.col(y)
    g = df.groupBy(*by) if by else df.groupBy()
    m = g.agg(F.count("*").cast("bigint").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
              F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y)))).alias("mape"),
              F.var_pop(F.col(y)).alias("__vy"))
    return m.select(*by, "n", "mae", "mse", F.sqrt("mse").alias("rmse"),
                    F.when(F.col("__vy") > 0, 1 - F.col("mse") / F.col("__vy")).alias("r2"), "mape")
