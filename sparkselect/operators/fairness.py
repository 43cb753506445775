"""Fairness and validation scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkselect.functions.metrics import METRICS, classification_metrics, confusion_counts, metrics_from_counts
from sparkselect.session import materialize, stored


def fairness(scored: DataFrame, y: str, yhat: str, sensitive: Sequence[str]) -> DataFrame:
    """Per level of each sensitive column: rows, selection rate (share predicted 1) and H1-H7.

    The columns are stacked to (column, level) first, so all of them cost one
    aggregation.
    """
    long = scored.select(F.col(y).cast("double").alias("__y"), F.col(yhat).cast("double").alias("__yhat"),
                         F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                      F.col(f"`{c}`").cast("string").alias("level"))
                                             for c in sensitive])).alias("__s")) \
        .select("__y", "__yhat", "__s.column", "__s.level")
    counts = materialize(confusion_counts(long, "__y", "__yhat", ["column", "level"]))
    met = metrics_from_counts(counts, ["column", "level"])
    sel = counts.groupBy("column", "level").agg(
        (F.sum(F.when(F.col("yhat") == 1, F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("selection_rate"))
    return met.join(sel, ["column", "level"]).select("column", "level", F.col("n").alias("rows"),
                                                     "selection_rate", *METRICS)


def fairness_gap(fair: DataFrame) -> DataFrame:
    """Per column and metric, largest minus smallest value over levels and their ratio."""
    ms = ["selection_rate", *METRICS]
    long = fair.select("column", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"),
                                                              F.col(m).alias("value")) for m in ms])).alias("s")) \
        .select("column", "s.metric", "s.value")
    g = long.groupBy("column", "metric").agg(F.max("value").alias("max"), F.min("value").alias("min"))
    return g.select("column", "metric", (F.col("max") - F.col("min")).alias("gap"),
                    F.when(F.col("max") != 0, F.col("min") / F.col("max")).alias("ratio"))


def fairness_cube(scored: DataFrame, y: str, yhat: str, sensitive: Sequence[str], min_rows: int = 1, positive: int = 1) -> DataFrame:
    """J1 and J2 for every combination of the sensitive columns: the groups of a cube with at least ``min_rows`` rows.

    Confusion counts of the finest groups come from one aggregation of the rows; the lattice is walked
    by level on that table. A group can only be large enough if all groups that it lies in are, so each level starts from the
    supported groups of the level before. ``columns`` names the grouping columns (joined by a comma, empty for all rows);
    a column outside them is null, as is a null level inside. Rates: selected, accuracy, tpr, fpr; ``gap``: selection rate less that of all rows."""
    names = [f"g{i}" for i in range(len(sensitive))]
    p = F.col("__p") == positive
    t = F.col("__y") == positive
    cells = scored.select(F.col(y).cast("double").alias("__y"), F.col(yhat).cast("double").alias("__p"), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(sensitive, names, strict=True)])
    sums = {"n": F.lit(1), "sel": p.cast("long"), "pos": t.cast("long"), "tp": (t & p).cast("long"), "fp": (~t & p).cast("long"), "right": (F.col("__y") == F.col("__p")).cast("long")}
    finest = stored(cells.where("__y is not null and __p is not null").groupBy(*names).agg(*[F.sum(c).cast("long").alias(k) for k, c in sums.items()]), "fairness-cells").frame
    adds = [F.sum(k).alias(k) for k in sums]
    whole = finest.groupBy().agg(*adds).where(F.col("n") >= min_rows)
    level = whole.select(F.lit(0).alias("mask"), *[F.lit(None).cast("string").alias(g) for g in names], *sums)
    out = level
    for size in range(1, len(names) + 1):
        masks = [m for m in range(1 << len(names)) if bin(m).count("1") == size]
        views = [F.struct(F.lit(m).alias("mask"), F.lit(m & (m - 1)).alias("parent"), *[(F.col(g) if m >> i & 1 else F.lit(None).cast("string")).alias(g) for i, g in enumerate(names)]) for m in masks]
        spread = finest.select(F.explode(F.array(*views)).alias("v"), *sums).select("v.*", *sums)
        # a parent without the last of the columns (the lowest bit) must be supported
        up = level.select(F.col("mask").alias("parent"), *[F.col(g).alias(f"__{g}") for g in names])
        same = F.col("s.parent") == F.col("u.parent")
        for i, g in enumerate(names):
            same = same & F.when(F.col("s.parent").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"s.{g}")).eqNullSafe(F.col(f"u.__{g}"))
        grown = spread.alias("s").join(up.alias("u"), same, "left_semi").groupBy("mask", *names).agg(*adds).where(F.col("n") >= min_rows)
        level = stored(grown, "fairness-level").frame
        out = out.unionByName(level)
    total = whole.select((F.col("sel") / F.col("n")).alias("__all"))
    ratio = lambda a, b: F.when(b != 0, a / b)
    neg = F.col("n") - F.col("pos")
    chosen = F.array_join(F.filter(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(sensitive)]), lambda c: c.isNotNull()), ",")
    return out.crossJoin(F.broadcast(total)).select(  # one row
        chosen.alias("columns"), *[F.col(g).alias(c) for g, c in zip(names, sensitive, strict=True)], "n", (F.col("sel") / F.col("n")).alias("selection_rate"), (F.col("right") / F.col("n")).alias("accuracy"),
        ratio(F.col("tp"), F.col("pos")).alias("tpr"), ratio(F.col("fp"), neg).alias("fpr"), (F.col("sel") / F.col("n") - F.col("__all")).alias("gap"))


def score_validation(model, validation: DataFrame, label_col: str = "Predictions",
                     keep: Sequence[str] | None = None) -> DataFrame:
    """The validation rows with the chosen model's label appended."""
    scored = model.transform(validation)
    cols = list(keep or validation.columns)
    pred = "prediction_label" if "prediction_label" in scored.columns else "prediction"
    return scored.select(*cols, F.col(pred).alias(label_col))


def evaluate_predictions(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """H1-H7 for two columns of a finished prediction table."""
    return classification_metrics(df, y, yhat)
