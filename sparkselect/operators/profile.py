"""Profiling tables (D1-D18): every section of a data profile as a DataFrame.

Plan shape: one wide aggregation for the moment statistics, one grouped
count per (column, value) that feeds distinct counts, quantiles, MAD,
histograms, extremes and ranks. Quantiles are exact without holding a
column in one task (see ``functions.ranking``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from sparkselect.functions.pairs import pair_correlations, pair_sums
from sparkselect.functions.ranking import (average_ranks, double_rest, exact_quantiles, range_slice, running_totals, top_k_per_group,
                                           value_counts_long)
from sparkselect.session import materialize, stored


def _counts(df: DataFrame, cols: list[str], counts: DataFrame | None) -> DataFrame:
    """(column, value, cnt), computed once and materialised for the several passes that read it."""
    return counts if counts is not None else materialize(value_counts_long(df, cols))

# Quantiles of the profile and alert thresholds.
PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]
HIGH_CARDINALITY = 50
ZEROS_SHARE = 0.1
SKEW_LIMIT = 20.0
IMBALANCE_LIMIT = 0.5
HIGH_CORRELATION = 0.9
#: Up to so many columns the statistics of D2 are one wide aggregate.
WIDE_COLUMNS = 32


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BooleanType))]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))]


def _long(row_df: DataFrame, columns: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """One-row wide aggregate with names ``{column}__{stat}`` -> one row per column."""
    return row_df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}__{s}`").alias(s) for s in stats]) for c in columns
    ])).alias("r")).select("r.*")


# ------------------------------------------------------------------ D1
def profile_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and share, duplicate rows and share, columns per kind."""
    cols = df.columns
    miss = sum((F.sum(F.col(f"`{c}`").isNull().cast("long")) for c in cols), F.lit(0))
    base = df.agg(F.count("*").alias("rows"), miss.alias("missing_cells"))
    dup = df.groupBy(*cols).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))
    out = base.withColumn("__k", F.lit(1)).join(dup.withColumn("__k", F.lit(1)), "__k").drop("__k")
    n_cols = len(cols)
    return out.select(
        F.col("rows").cast("bigint"), F.lit(n_cols).cast("bigint").alias("columns"),
        F.col("missing_cells").cast("bigint"),
        F.try_divide(F.col("missing_cells"), F.col("rows") * n_cols).alias("missing_share"),
        F.col("duplicate_rows").cast("bigint"),
        F.try_divide(F.col("duplicate_rows"), F.col("rows")).alias("duplicate_share"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(categorical_columns(df))).cast("bigint").alias("categorical_columns"),
        F.lit(len(datetime_columns(df))).cast("bigint").alias("datetime_columns"))


# ------------------------------------------------------------------ D2
def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None,
                    counts: DataFrame | None = None, with_mad: bool = True) -> DataFrame:
    """Count, missing, distinct, zeros, negatives, min, max, mean, sum, std, variance,
    cv, skewness (population), kurtosis (population, excess) and MAD
    (median absolute deviation from the median), one row per column."""
    cols = list(columns or numeric_columns(df))
    def stats_of(x: Column, name) -> list[Column]:
        return [F.count(x).alias(name("count")), F.sum(x.isNull().cast("long")).alias(name("missing")),
                F.sum((x == 0).cast("long")).alias(name("zeros")), F.sum((x < 0).cast("long")).alias(name("negatives")),
                F.min(x).alias(name("min")), F.max(x).alias(name("max")), F.avg(x).alias(name("mean")),
                F.sum(x).alias(name("sum")), F.stddev_samp(x).alias(name("std")),
                F.var_samp(x).alias(name("variance")), F.skewness(x).alias(name("skewness")),
                F.kurtosis(x).alias(name("kurtosis"))]

    stats = ["count", "missing", "zeros", "negatives", "min", "max", "mean", "sum", "std", "variance",
             "skewness", "kurtosis"]
    if len(cols) <= WIDE_COLUMNS:
        aggs = [a for c in cols for a in stats_of(F.col(f"`{c}`").cast("double"), lambda s, c=c: f"{c}__{s}")]
        wide = _long(df.agg(*aggs), cols, stats)
    else:  # the same sums, grouped by column, where an expression per column and sum is too much to plan
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])).alias("s")).select("s.*")
        names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
        wide = names.join(rows.groupBy("column").agg(*stats_of(F.col("x"), str)), "column", "left")
    vc = _counts(df, cols, counts)
    distinct = vc.groupBy("column").agg(F.count("*").alias("distinct"))
    if with_mad:
        wide = wide.join(median_abs_deviation(vc), "column", "left")
    else:
        wide = wide.withColumn("mad", F.lit(None).cast("double"))
    return wide.join(distinct, "column", "left").select(
        "column", F.col("count").cast("bigint"), F.col("missing").cast("bigint"),
        F.coalesce(F.col("distinct"), F.lit(0)).cast("bigint").alias("distinct"),
        F.col("zeros").cast("bigint"), F.col("negatives").cast("bigint"), "min", "max", "mean", "sum", "std",
        "variance", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).alias("cv"),
        "skewness", "kurtosis", "mad")


def median_abs_deviation(counts: DataFrame) -> DataFrame:
    """(column, mad) from a (column, value, cnt) table: exact, two quantile passes over distinct values."""
    med = exact_quantiles(None, [], [0.5], counts=counts).select("column", F.col("value").alias("__med"))
    dev = materialize(counts.join(F.broadcast(med), "column").groupBy(
        "column", F.abs(F.col("value") - F.col("__med")).alias("value")).agg(F.sum("cnt").alias("cnt")))
    return exact_quantiles(None, [], [0.5], counts=dev).select("column", F.col("value").alias("mad"))


# ------------------------------------------------------------------ D3
def profile_quantiles(df: DataFrame, columns: Sequence[str] | None = None, probs: Sequence[float] = PROBS,
                      counts: DataFrame | None = None, approx: bool = False,
                      accuracy: int = 10000) -> DataFrame:
    """D3: interpolated quantiles (5/25/50/75/95%), range and IQR per column.

    ``approx=True`` uses ``percentile_approx`` (one aggregation, bounded sketch
    per column) instead of the exact sliced method."""
    cols = list(columns or numeric_columns(df))
    if approx:
        names = [f"p{int(round(p * 100)):02d}" for p in probs]
        row = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), list(probs), accuracy).alias(f"{c}__q")
                       for c in cols], *[F.min(F.col(f"`{c}`")).alias(f"{c}__lo") for c in cols],
                     *[F.max(F.col(f"`{c}`")).alias(f"{c}__hi") for c in cols])
        out = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                      *[F.col(f"`{c}__q`")[i].alias(n) for i, n in enumerate(names)],
                                                      (F.col(f"`{c}__hi`") - F.col(f"`{c}__lo`")).cast("double").alias("range"))
                                             for c in cols])).alias("s")).select("s.*")
        return out.withColumn("iqr", F.col("p75") - F.col("p25")) if "p75" in names and "p25" in names else out
    vc = _counts(df, cols, counts)
    q = exact_quantiles(None, [], probs, counts=vc)
    names = {p: f"p{int(round(p * 100)):02d}" for p in probs}
    wide = q.groupBy("column").agg(*[F.max(F.when(F.abs(F.col("prob") - p) < 1e-12, F.col("value"))).alias(n)
                                     for p, n in names.items()])
    rng = vc.groupBy("column").agg((F.max("value") - F.min("value")).alias("range"))
    out = wide.join(rng, "column")
    if 0.25 in names and 0.75 in names:
        out = out.withColumn("iqr", F.col("p75") - F.col("p25"))
    return out


# ------------------------------------------------------------------ D4
def profile_histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10,
                      counts: DataFrame | None = None) -> DataFrame:
    """Equal-width bins between min and max; the last bin includes the max.
    Every bin is listed (count 0 when empty)."""
    cols = list(columns or numeric_columns(df))
    vc = _counts(df, cols, counts)
    rng = vc.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1,
                       F.lit(bins))).otherwise(F.lit(1))
    hist = vc.join(F.broadcast(rng), "column").groupBy("column", b.cast("bigint").alias("bin")).agg(
        F.sum("cnt").alias("count"))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins)))) \
        .withColumn("bin", F.col("bin").cast("bigint"))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(hist, ["column", "bin"], "left").select(
        "column", "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("low"),
        (F.col("lo") + F.col("bin") * width).alias("high"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


# ------------------------------------------------------------------ D5 / D6
def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value as text, cnt) over non-null values."""
    return value_counts_long(df, columns, value_type="string")


def profile_categorical(df: DataFrame, columns: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    """The ``top`` most frequent levels per column (ties by level), with share of non-null rows."""
    cols = list(columns or categorical_columns(df))
    lc = level_counts(df, cols)
    tot = lc.groupBy("column").agg(F.sum("cnt").alias("__n"))
    best = top_k_per_group(lc, ["column"], [F.col("cnt").desc(), F.col("value").asc()], top)
    return best.join(F.broadcast(tot), "column").select(
        "column", F.col("value").alias("level"), F.col("cnt").cast("bigint").alias("count"),
        (F.col("cnt") / F.col("__n")).alias("share"), "rank")


def profile_distinct(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct values, values seen once, and whether the column is unique (exact).

    ``approx=True``: HyperLogLog distinct counts in one aggregation (seen_once is
    then null and is_unique compares the estimate with the non-null count)."""
    cols = list(columns or df.columns)
    if approx:
        row = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"{c}__d") for c in cols],
                     *[F.count(F.col(f"`{c}`")).alias(f"{c}__n") for c in cols])
        return row.select(F.explode(F.array(*[F.struct(
            F.lit(c).alias("column"), F.col(f"`{c}__d`").cast("bigint").alias("distinct"),
            F.lit(None).cast("bigint").alias("seen_once"),
            (F.col(f"`{c}__d`") >= F.col(f"`{c}__n`")).cast("bigint").alias("is_unique")) for c in cols])).alias("s")) \
            .select("s.*")
    lc = level_counts(df, cols)
    out = lc.groupBy("column").agg(F.count("*").cast("bigint").alias("distinct"),
                                   F.sum((F.col("cnt") == 1).cast("long")).cast("bigint").alias("seen_once"),
                                   F.sum("cnt").alias("__n"))
    return out.select("column", "distinct", "seen_once",
                      (F.col("distinct") == F.col("__n")).cast("bigint").alias("is_unique"))


# ------------------------------------------------------------------ D7
def missing_per_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """D7, first part: (column, missing, share)."""
    cols = list(columns or df.columns)
    row = df.agg(F.count("*").alias("__n"), *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"{c}__missing") for c in cols])
    return row.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}__missing`"), F.lit(0)).cast("bigint").alias("missing"),
        F.try_divide(F.col(f"`{c}__missing`"), F.col("__n")).alias("share")) for c in cols])).alias("r")).select("r.*")


def profile_missing(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(per column missing count and share, pairs of columns with missing values:
    rows missing both and correlation of the missing flags), one pass for all pairs."""
    cols = list(columns or df.columns)
    n, _, _, both = pair_sums(df, [F.col(f"`{c}`").isNull().cast("double") for c in cols])
    rows = float(n.max(initial=0.0))
    share = np.diag(both) / rows if rows else np.zeros(len(cols))
    out = []
    for i, j in combinations(range(len(cols)), 2):
        if both[i, i] > 0 and both[j, j] > 0:
            spread = math.sqrt((share[i] - share[i] ** 2) * (share[j] - share[j] ** 2))
            out.append((cols[i], cols[j], int(both[i, j]), float((both[i, j] / rows - share[i] * share[j]) / spread) if spread else None))
    pair = df.sparkSession.createDataFrame(out, "column_a string, column_b string, both_missing bigint, corr double")
    return missing_per_column(df, cols), pair


# ------------------------------------------------------------------ D8
def profile_duplicates(df: DataFrame, columns: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    """The most repeated value combinations (count > 1), ties by the values."""
    cols = list(columns or df.columns)
    dup = df.groupBy(*cols).agg(F.count("*").cast("bigint").alias("count")).where("count > 1")
    return dup.orderBy(F.col("count").desc(), *[F.col(c).asc() for c in cols]).limit(top)


# ------------------------------------------------------------------ D9 / D10
def profile_pearson(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson r for every pair of numeric columns, from one pass of pair sums."""
    cols = list(columns or numeric_columns(df))
    r = pair_correlations(df, cols)
    rows = [(cols[i], cols[j], None if np.isnan(r[i, j]) else float(r[i, j])) for i, j in combinations(range(len(cols)), 2)]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, r double")


#: Rank tables of all columns together are broadcast up to so many rows (two numbers each).
RANK_BROADCAST_ROWS = 1_000_000


def _with_looked_up(df: DataFrame, columns: Sequence[str], table: DataFrame, value: str, suffix: str) -> DataFrame:
    """Add ``{c}{suffix}`` = ``table.value`` of (column, value) for each column.

    ``table`` has one row per column and distinct value; the columns' parts are broadcast
    only if all of them together are known to be small, else joined by a shuffle on the
    value (AQE splits a hot value on the row side).
    """
    small = table.count() <= RANK_BROADCAST_ROWS
    out = df
    for c in columns:
        part = table.where(F.col("column") == c).select(F.col("value").alias("__rv"), F.col("rest").alias("__rr"), F.col(value).alias(f"{c}{suffix}"))
        same = (F.col(f"`{c}`").cast("double") == F.col("__rv")) & (double_rest(df, c) == F.col("__rr"))
        out = out.join(F.broadcast(part) if small else part, same, "left").drop("__rv", "__rr")
    return out


def with_average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``{c}__rank`` (average rank among non-null values) for each column."""
    ranks = materialize(average_ranks(materialize(value_counts_long(df, columns))))
    return _with_looked_up(df, columns, ranks, "avg_rank", "__rank")


def profile_spearman(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Spearman rho = Pearson r of average ranks, for every pair."""
    cols = list(columns or numeric_columns(df))
    ranked = with_average_ranks(df.select(*cols), cols)
    r = profile_pearson(ranked, [f"{c}__rank" for c in cols])
    return r.select(F.regexp_replace("column_a", "__rank$", "").alias("column_a"),
                    F.regexp_replace("column_b", "__rank$", "").alias("column_b"), F.col("r").alias("rho"))


# ------------------------------------------------------------------ D11
#: Cells of a slice, which one task holds, and slices at most.
KENDALL_CELLS = 100_000
KENDALL_SLICES = 2_000


def _inversions(rank: np.ndarray, n: np.ndarray) -> int:
    """Sum of n_i n_j over all i < j with rank_i > rank_j, for ranks 0 to len - 1: bit by bit from
    the highest, those that share the higher bits and differ in it, in their order."""
    found = 0
    for bit in range((len(rank) - 1).bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1 == 1
        start = np.flatnonzero(np.append(True, np.diff(rank >> (bit + 1)) != 0))
        ones = np.cumsum(np.where(one, n, 0))
        before = (ones - np.where(one, n, 0))[start]
        above = ones - np.repeat(before, np.diff(np.append(start, len(rank))))
        found += int((n[~one] * above[~one]).sum())
        at = np.argsort(rank >> bit, kind="stable")
        rank, n = rank[at], n[at]
    return found


def _discordant(lead: tuple[str, ...]):
    """Discordant pairs of a group's cells, whose order is ``lead``; cells equal in it must not be discordant."""
    def count(cells: pa.Table) -> pa.Table:
        col = {c: cells.column(c).to_numpy() for c in ("pair", "ia", "ib", "n", *lead)}
        rank = np.empty(len(cells), np.int64)
        rank[np.lexsort((col["ia"], col["ib"]))] = np.arange(len(cells))
        order = np.lexsort((rank, *[col[c] for c in reversed(lead)]))
        return pa.table({"pair": col["pair"][:1], "d": [float(_inversions(rank[order], col["n"][order]))]})

    return count


def profile_kendall(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Tau-b for every pair of numeric columns, exact for any number of distinct values.

    Values become dense level numbers and rows become counted (level, level) cells. A pair of
    cells is discordant if it stands the other way round in the order by the second column. The
    cells are cut into slices of the one order and into stripes of the other, of equal sizes
    whatever values are frequent: discordant pairs lie in one slice (counted there), in one
    stripe but two slices (counted there by slice numbers), or in neither (from the counts of
    the grid of slices and stripes). The concordant pairs are those left without ties.
    """
    cols = list(columns or numeric_columns(df))
    pairs = list(combinations(cols, 2))
    base = df.select(*cols)
    levels = materialize(running_totals(value_counts_long(base, cols).select("column", "value", "rest"), ["value", "rest"],
                                        {"level": F.lit(1).cast("bigint")}, ["column"]))
    indexed = _with_looked_up(base, cols, levels, "level", "__level")
    cells = stored(indexed.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col(f"`{a}__level`").alias("ia"), F.col(f"`{b}__level`").alias("ib"))
        for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*").where("ia is not null and ib is not null")
        .groupBy("pair", "ia", "ib").agg(F.count("*").alias("n")), "kendall-cells").frame
    slices = min(KENDALL_SLICES, -(-cells.count() // KENDALL_CELLS))
    cut = lambda *order: range_slice(cells, [F.col(c) for c in ("pair", *order)], slices, 0)
    slice_, stripe = (c if c is not None else F.lit(0) for c in (cut("ia", "ib"), cut("ib", "ia")))
    placed = stored(cells.withColumn("slice", slice_).withColumn("stripe", stripe), "kendall-slices").frame
    d = placed.groupBy("pair", "slice").applyInArrow(_discordant(("ia", "ib")), "pair int, d double")
    d = d.unionByName(placed.groupBy("pair", "stripe").applyInArrow(_discordant(("slice",)), "pair int, d double"))
    met = materialize(placed.groupBy("pair", "slice", "stripe").agg(F.sum("n").cast("double").alias("n")))
    grid = met.select("pair", "slice").distinct().join(met.select("pair", "stripe").distinct(), "pair") \
        .join(met, ["pair", "slice", "stripe"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    earlier = Window.partitionBy("pair", "stripe").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("pair", "slice").orderBy(F.col("stripe").desc()).rowsBetween(Window.unboundedPreceding, -1)
    far = grid.withColumn("before", F.sum("n").over(earlier)).withColumn("above", F.coalesce(F.sum("before").over(later), F.lit(0.0)))
    d = d.unionByName(far.select("pair", (F.col("n") * F.col("above")).alias("d"))).groupBy("pair").agg(F.sum("d").alias("d"))

    def ties(*keys: str) -> DataFrame:
        t = cells.groupBy("pair", *keys).agg(F.sum("n").cast("double").alias("t"))
        return t.groupBy("pair").agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("n" + "".join(keys)))

    m = d.join(ties(), "pair").join(ties("ia"), "pair").join(ties("ib"), "pair").join(ties("ia", "ib"), "pair")
    den = F.sqrt((F.col("n") - F.col("nia")) * (F.col("n") - F.col("nib")))
    net = F.col("n") - F.col("nia") - F.col("nib") + F.col("niaib") - 2 * F.col("d")
    name = lambda side: F.element_at(F.array(*[F.lit(p[side]) for p in pairs]), F.col("pair") + 1)
    return m.select(name(0).alias("column_a"), name(1).alias("column_b"), F.when(den > 0, net / den).alias("tau_b"),
                    F.lit(1).cast("bigint").alias("exact"))


def kendall_tau_b(df: DataFrame, a: str, b: str) -> DataFrame:
    """D11 for one pair."""
    return profile_kendall(df, [a, b])


# ------------------------------------------------------------------ D12
def profile_cramers_v(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cramer's V (no bias correction) for every pair of categorical columns.

    chi2 = n (sum n_ij^2 / (r_i c_j) - 1) needs only the non-empty cells. All pairs
    come from one pass: rows are stacked per pair, counted per cell, and the cell
    table (materialised, small) gives the margins.
    """
    cols = list(columns or categorical_columns(df))
    pairs = list(combinations(cols, 2))
    keys = ["column_a", "column_b"]
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                 F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b"))
        for a, b in pairs])).alias("s")).select("s.*").where("a is not null and b is not null")
    cells = materialize(stacked.groupBy(*keys, "a", "b").agg(F.count("*").cast("double").alias("nij")))
    ri = cells.groupBy(*keys, "a").agg(F.sum("nij").alias("ri"))
    cj = cells.groupBy(*keys, "b").agg(F.sum("nij").alias("cj"))
    s = cells.join(ri, [*keys, "a"]).join(cj, [*keys, "b"]).groupBy(*keys).agg(
        F.sum(F.col("nij") * F.col("nij") / (F.col("ri") * F.col("cj"))).alias("s"),
        F.sum("nij").alias("n"), F.countDistinct("a").alias("r"), F.countDistinct("b").alias("c"))
    k = F.least(F.col("r"), F.col("c")) - 1
    chi2 = F.col("n") * (F.col("s") - 1)
    return s.select(*keys, F.when(k > 0, F.sqrt(F.greatest(chi2, F.lit(0.0)) / F.col("n") / k)).alias("cramers_v"))


# ------------------------------------------------------------------ D13
def profile_extremes(df: DataFrame, columns: Sequence[str] | None = None, n: int = 5,
                     counts: DataFrame | None = None) -> DataFrame:
    """The n smallest and n largest distinct values per column, with counts. ``value`` is
    a double; for integers beyond 2^53, value + ``rest`` is the exact one."""
    cols = list(columns or numeric_columns(df))
    vc = _counts(df, cols, counts)
    low = top_k_per_group(vc, ["column"], [F.col("value").asc(), F.col("rest").asc()], n)
    high = top_k_per_group(vc, ["column"], [F.col("value").desc(), F.col("rest").desc()], n)
    return low.select("column", F.lit("min").alias("side"), "rank", "value", "rest", F.col("cnt").cast("bigint").alias("count")) \
        .unionByName(high.select("column", F.lit("max").alias("side"), "rank", "value", "rest",
                                 F.col("cnt").cast("bigint").alias("count")))


# ------------------------------------------------------------------ D14
def profile_alerts(df: DataFrame, numeric: Sequence[str] | None = None,
                   categorical: Sequence[str] | None = None) -> DataFrame:
    """(column, alert) for constant, unique, high_cardinality, missing, zeros,
    skewed, imbalanced and high_correlation."""
    num = list(numeric if numeric is not None else numeric_columns(df))
    cat = list(categorical if categorical is not None else categorical_columns(df))
    cols = num + cat
    n = df.count()
    dist = profile_distinct(df, cols).select("column", "distinct", "is_unique")
    miss = missing_per_column(df, cols).select("column", "missing")
    base = dist.join(miss, "column", "right").fillna(0, ["distinct", "is_unique"])
    alerts = [base.where("distinct = 1").select("column", F.lit("constant").alias("alert")),
              base.where("is_unique = 1").select("column", F.lit("unique").alias("alert")),
              base.where("missing > 0").select("column", F.lit("missing").alias("alert"))]
    if cat:
        alerts.append(base.where(F.col("column").isin(cat) & (F.col("distinct") > HIGH_CARDINALITY))
                      .select("column", F.lit("high_cardinality").alias("alert")))
        lc = level_counts(df, cat)
        tot = lc.groupBy("column").agg(F.sum("cnt").alias("__n"), F.count("*").alias("__k"))
        ent = lc.join(F.broadcast(tot), "column").groupBy("column", "__k").agg(
            (-F.sum(F.col("cnt") / F.col("__n") * F.log(F.col("cnt") / F.col("__n")))).alias("h"))
        alerts.append(ent.where((F.col("__k") > 1) & (1 - F.col("h") / F.log(F.col("__k")) > IMBALANCE_LIMIT))
                      .select("column", F.lit("imbalanced").alias("alert")))
    if num:
        st = profile_numeric(df, num, with_mad=False).select("column", "zeros", "skewness")
        alerts.append(st.where(F.col("zeros") > ZEROS_SHARE * n).select("column", F.lit("zeros").alias("alert")))
        alerts.append(st.where(F.abs("skewness") > SKEW_LIMIT).select("column", F.lit("skewed").alias("alert")))
        if len(num) > 1:
            pr = profile_pearson(df, num).where(F.abs("r") > HIGH_CORRELATION)
            hc = pr.select(F.col("column_a").alias("column")).unionByName(pr.select(F.col("column_b").alias("column")))
            alerts.append(hc.distinct().select("column", F.lit("high_correlation").alias("alert")))
    out = alerts[0]
    for a in alerts[1:]:
        out = out.unionByName(a)
    return out


# ------------------------------------------------------------------ D15
def profile_interactions(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Scatter as 2-D equal-width bins (non-empty cells)."""
    sub = df.select(F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y")) \
        .where("x is not null and y is not null")
    x0, x1, y0, y1 = sub.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()

    def bin_of(v, lo, hi):
        if lo is None or not hi > lo:
            return F.lit(1).cast("bigint")
        return F.least(F.floor((F.col(v) - F.lit(lo)) / F.lit(hi - lo) * bins) + 1, F.lit(bins)).cast("bigint")

    return sub.groupBy(
        F.lit(x).alias("column_x"), F.lit(y).alias("column_y"),
        bin_of("x", x0, x1).alias("bin_x"), bin_of("y", y0, y1).alias("bin_y")
    ).agg(F.count("*").cast("bigint").alias("count"))


# ------------------------------------------------------------------ D16
def profile_sample(df: DataFrame, key: str | Sequence[str], n: int = 10) -> DataFrame:
    """First and last n rows by key (two distributed top-k reads)."""
    keys = [key] if isinstance(key, str) else list(key)
    first = df.orderBy(*[F.col(k).asc() for k in keys]).limit(n).withColumn("position", F.lit("first"))
    last = df.orderBy(*[F.col(k).desc() for k in keys]).limit(n).withColumn("position", F.lit("last"))
    return first.unionByName(last)


# ------------------------------------------------------------------ D17
def profile_text(df: DataFrame, columns: Sequence[str] | None = None, word_pattern: str = "[ \n]+") -> DataFrame:
    """Length (characters) and word count statistics of whole texts."""
    cols = list(columns or categorical_columns(df))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("t"))
                                         for c in cols])).alias("s")).select("s.*").where("t is not null")
    long = long.select("column", F.length("t").alias("len"), F.size(F.split("t", word_pattern)).alias("words"))
    return long.groupBy("column").agg(
        F.min("len").cast("bigint").alias("min_length"), F.avg("len").alias("mean_length"),
        F.max("len").cast("bigint").alias("max_length"), F.min("words").cast("bigint").alias("min_words"),
        F.avg("words").alias("mean_words"), F.max("words").cast("bigint").alias("max_words"),
        F.sum("words").cast("bigint").alias("total_words"))


# ------------------------------------------------------------------ D18
def profile_datetime(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(min, max and span in days; rows per month)."""
    c = F.col(f"`{column}`")
    summ = df.agg(F.min(c).alias("min"), F.max(c).alias("max")).select(
        F.lit(column).alias("column"), F.date_format("min", "yyyy-MM-dd HH:mm:ss").alias("min"),
        F.date_format("max", "yyyy-MM-dd HH:mm:ss").alias("max"),
        # difference of wall-clock values: independent of the session time zone
        (F.timestamp_diff("MICROSECOND", F.col("min").cast("timestamp_ntz"), F.col("max").cast("timestamp_ntz"))
         / 86400e6).alias("span_days"))
    per = df.where(c.isNotNull()).groupBy(F.date_format(F.date_trunc("month", c), "yyyy-MM").alias("month")) \
        .agg(F.count("*").cast("bigint").alias("rows"))
    return summ, per


def profile(df: DataFrame, key: str | None = None, interactions: Sequence[tuple[str, str]] = ()) -> dict[str, DataFrame]:
    """All sections D1-D18 as DataFrames (A6 writes them); D15 for the column pairs asked for."""
    num, cat, dates = numeric_columns(df), categorical_columns(df), datetime_columns(df)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    vc = materialize(value_counts_long(df, num)) if num else None
    missing, pairs = profile_missing(df)
    out = {"overview": profile_overview(df), "distinct": profile_distinct(df), "missing": missing, "missing_pairs": pairs,
           "duplicates": profile_duplicates(df), "alerts": profile_alerts(df, num, cat)}
    if num:
        out.update(numeric=profile_numeric(df, num, vc), quantiles=profile_quantiles(df, num, counts=vc),
                   histogram=profile_histogram(df, num, counts=vc), extremes=profile_extremes(df, num, counts=vc))
        if len(num) > 1:
            out.update(pearson=profile_pearson(df, num), spearman=profile_spearman(df, num), kendall=profile_kendall(df, num))
    if cat:
        out["categorical"] = profile_categorical(df, cat)
        if len(cat) > 1:
            out["cramers_v"] = profile_cramers_v(df, cat)
    if text:
        out["text"] = profile_text(df, text)
    for c in dates:
        out[f"datetime_{c}"], out[f"datetime_months_{c}"] = profile_datetime(df, c)
    for x, y in interactions:
        out[f"interactions_{x}_{y}"] = profile_interactions(df, x, y)
    if key:
        out["sample"] = profile_sample(df, key)
    return out
