"""Exact ranks, running totals and quantiles without a single-task window.

``row_number() over (order by ...)`` with no ``partition by`` moves every row
into one task, and a ``partition by`` on a column with two values moves half
of them. The helpers here keep the exact result but spread the work:

1. cut the (group, order) key range into slices at points taken from a
   small deterministic sample, so every slice holds a contiguous run of the
   order and about rows/slices rows (the order is made total by a key, so a
   hot value is still split);
2. number / sum rows inside each slice with a window partitioned by slice;
3. add the totals of all earlier slices of the same group, taken from a table
   of at most ``slices x groups`` rows that is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sparkselect.session import materialize

_SLICE = "__slice"
#: at or below this many rows one slice is used: a window over a proven-small table
#: (the session setting sparkselect.singleSliceRows overrides it, e.g. 0 to always slice)
SINGLE_SLICE_ROWS = 1_000_000


def _single_slice_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("sparkselect.singleSliceRows", str(SINGLE_SLICE_ROWS)))


def _cols(xs) -> list:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _slices(df: DataFrame, slices: int | None) -> int:
    if slices:
        return int(slices)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def _sort_key(row):
    return tuple((v is not None, v) for v in row)


def range_slice(df: DataFrame, keys: list, slices: int, single_rows: int | None = None) -> Column | None:
    """A deterministic range-slice number (0 .. slices-1) of each row's key, or None
    when one slice is enough (at most ``SINGLE_SLICE_ROWS`` rows, counted).

    Cut points come from a hash-chosen sample of about 64 rows per slice
    (bounded, independent of the table size), so every evaluation of the
    plan, including a recomputation after a lost executor, puts a row in the
    same slice. Slice lookup is a binary tree of struct comparisons.
    """
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    key = F.struct(*named)
    if slices <= 1:
        return None
    types = [f.dataType for f in df.select(*named).schema.fields]
    n = df.count()
    if n <= (_single_slice_rows(df) if single_rows is None else single_rows):
        return None
    every = max(1, n // (64 * slices))
    pick = F.abs(F.xxhash64(*named)) % every == 0 if every > 1 else F.lit(True)
    sample = sorted({tuple(r) for r in df.select(*named).where(pick).collect()}, key=_sort_key)
    if len(sample) < 2:
        return None  # the sample's keys are one: rows that equal each other in every column
    m = min(slices, len(sample)) - 1
    cuts = [sample[(i + 1) * len(sample) // (m + 1)] for i in range(m)]
    cuts = [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]
    lits = [F.struct(*[(F.lit(v).cast(t) if v is not None else F.lit(None).cast(t)).alias(f"k{i}")
                       for i, (v, t) in enumerate(zip(c, types))]) for c in cuts]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < lits[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    l, r = left.alias("__l"), right.alias("__r")
    cond = None
    for k in keys:
        one = F.col(f"__l.`{k}`").eqNullSafe(F.col(f"__r.`{k}`"))
        cond = one if cond is None else cond & one
    return l.join(r, cond).select("__l.*", *[F.col(f"__r.`{c}`") for c in right.columns if c not in keys])


def running_totals(df: DataFrame, order_by: Sequence, sums: dict[str, Column | str],
                   partition_by: Sequence[str] = (), slices: int | None = None,
                   inclusive: bool = True) -> DataFrame:
    """Add running sums ``sum(expr) over (partition by P order by O rows unbounded preceding)``.

    ``order_by`` should give a total order inside each partition (end it with a
    key); rows that tie in it are ordered by a hash of all their columns. Items
    are ascending column expressions (use ``-x`` for a descending number).
    With ``inclusive=False`` the current row is left out (sums of earlier rows).
    """
    parts = list(partition_by)
    order = _cols(order_by)
    names = {k: (F.col(v) if isinstance(v, str) else v) for k, v in sums.items()}
    base = df
    # rows equal in the stated order follow each other by a hash of all their columns, at every size
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    order = [*order, F.xxhash64(*plain)]
    for k, v in names.items():
        base = base.withColumn(f"__v_{k}", v)
    # an explicit slice count always slices (tests); otherwise small inputs use one slice
    sl = range_slice(base, [*_cols(parts), *order], _slices(df, slices), 0 if slices else None)
    if sl is None:
        # proven small (<= SINGLE_SLICE_ROWS rows): the plain window is the cheaper plan
        frame = Window.partitionBy(*parts).orderBy(*order)
        frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        out = base
        for k in names:
            out = out.withColumn(k, F.coalesce(F.sum(f"__v_{k}").over(frame), F.lit(0)))
        return out.drop(*[f"__v_{k}" for k in names])
    ranged = base.withColumn(_SLICE, sl)
    frame = Window.partitionBy(_SLICE, *parts).orderBy(*order)
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = ranged
    for k in names:
        local = local.withColumn(f"__l_{k}", F.coalesce(F.sum(f"__v_{k}").over(frame), F.lit(0)))
    totals = ranged.groupBy(_SLICE, *parts).agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in names])
    before = Window.partitionBy(*parts).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_SLICE, *parts, *[
        F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in names])
    # one row per slice and group that meet: broadcast only where there are no groups
    if not parts:
        offsets = F.broadcast(offsets)
    out = local.join(offsets, [_SLICE, *parts], "inner") if not parts else _join_null_safe(local, offsets, [_SLICE, *parts])
    for k in names:
        out = out.withColumn(k, F.col(f"__l_{k}") + F.col(f"__o_{k}"))
    drop = [_SLICE] + [f"__{p}_{k}" for k in names for p in ("v", "l", "o")]
    return out.drop(*drop)


def row_number_exact(df: DataFrame, order_by: Sequence, partition_by: Sequence[str] = (),
                     name: str = "rn", slices: int | None = None) -> DataFrame:
    """Exact 1-based ``row_number()``; ``order_by`` must be total within a partition."""
    out = running_totals(df, order_by, {name: F.lit(1).cast("bigint")}, partition_by, slices)
    return out


def double_rest(df: DataFrame, column: str) -> Column:
    """What an integer lacks as a double (0 up to 2^53): value and rest together are exact."""
    if isinstance(df.schema[column].dataType, LongType):
        x = F.col(f"`{column}`")
        return (x.cast("decimal(38,0)") - x.cast("double").cast("decimal(38,0)")).cast("bigint")
    return F.lit(0).cast("bigint")


def value_counts_long(df: DataFrame, columns: Sequence[str], value_type: str = "double") -> DataFrame:
    """(column, value, cnt) over non-null values; combined map-side before the shuffle.

    With ``double`` values there is a column ``rest`` as well, so that integers beyond 2^53
    that share a double are told apart and ordered."""
    both = value_type == "double"
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(value_type).alias("value"),
                 *([double_rest(df, c).alias("rest")] if both else [])) for c in columns
    ])).alias("s")).select("s.*").where(F.col("value").isNotNull())
    return stacked.groupBy(*stacked.columns).agg(F.count("*").alias("cnt"))


def value_order(counts: DataFrame, value: str = "value") -> list[str]:
    """The columns that order the values of a count table."""
    return [value, "rest"] if "rest" in counts.columns else [value]


def average_ranks(counts: DataFrame, partition_by: Sequence[str] = ("column",),
                  value: str = "value", cnt: str = "cnt") -> DataFrame:
    """From (group, value, cnt): average rank of each value (ties share the mean rank)."""
    cum = running_totals(counts, value_order(counts, value), {"__cum": cnt}, list(partition_by))
    return cum.withColumn("avg_rank", F.col("__cum") - F.col(cnt) + (F.col(cnt) + 1) / 2.0).drop("__cum")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    method: str = "cont", counts: DataFrame | None = None) -> DataFrame:
    """Exact quantiles as (column, prob, value).

    ``cont``: linear interpolation at position (n-1)p (DuckDB quantile_cont,
    pandas default); ``disc``: the value at 0-based position max(ceil(n p) - 1, 0)
    (DuckDB quantile_disc). Work is one grouped count per distinct value,
    a sliced running total over the distinct values and one broadcast range
    join against the few wanted positions; no task ever holds a whole column.
    """
    # read by several passes (slices, totals, windows): written once
    vc = counts if counts is not None else materialize(value_counts_long(df, columns))
    cum = running_totals(vc, value_order(vc), {"__hi": "cnt"}, ["column"])
    cum = cum.withColumn("__lo", F.col("__hi") - F.col("cnt"))
    n = vc.groupBy("column").agg(F.sum("cnt").alias("n"))
    # columns x probs rows: tiny, broadcast below
    want = n.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    if method == "disc":
        # 0-based position ceil(n p) - 1, at least 0 (DuckDB quantile_disc)
        want = want.withColumn("h", F.greatest(F.ceil(F.col("n") * F.col("prob")) - 1, F.lit(0)).cast("double"))
    else:
        want = want.withColumn("h", (F.col("n") - 1) * F.col("prob"))
    want = want.withColumn("pos_lo", F.floor("h")).withColumn("pos_hi", F.ceil("h"))
    pos = want.select(F.col("column").alias("__pc"), "prob", "h", "pos_lo", F.explode(F.array(
        F.struct(F.lit("lo").alias("side"), F.col("pos_lo").alias("pos")),
        F.struct(F.lit("hi").alias("side"), F.col("pos_hi").alias("pos")))).alias("p")
    ).select("__pc", "prob", "h", "pos_lo", "p.side", "p.pos")
    hit = cum.join(F.broadcast(pos), (F.col("column") == F.col("__pc"))
                   & (F.col("pos") >= F.col("__lo")) & (F.col("pos") < F.col("__hi")), "inner") \
        .select("column", "prob", "h", "pos_lo", "side", "value")
    wide = hit.groupBy("column", "prob", "h", "pos_lo").agg(
        F.max(F.when(F.col("side") == "lo", F.col("value"))).alias("v_lo"),
        F.max(F.when(F.col("side") == "hi", F.col("value"))).alias("v_hi"))
    if method == "disc":
        val = F.col("v_lo")
    else:
        val = F.col("v_lo") + (F.col("h") - F.col("pos_lo")) * (F.col("v_hi") - F.col("v_lo"))
    return wide.select("column", "prob", val.alias("value"))


def top_k_per_group(df: DataFrame, group_by: Sequence[str], order_by: Sequence, k: int,
                    name: str = "rank", salt_col: Column | None = None, salts: int | None = None) -> DataFrame:
    """Exact top-k rows per group with rank 1..k.

    A group may hold a third of all rows, so rows are first cut to the top k
    inside (group, salt) pieces (salts default to the shuffle partition count,
    so a piece is about group size / partitions); the global top k is contained
    in the union of those, which has at most salts x k rows per group.
    """
    order = _cols(order_by)
    n_salts = salts or max(16, _slices(df, None))
    salt = salt_col if salt_col is not None else F.abs(F.xxhash64(*[F.col(c) for c in df.columns])) % n_salts
    pre = df.withColumn("__salt", salt)
    w1 = Window.partitionBy(*group_by, "__salt").orderBy(*order)
    pre = pre.withColumn("__r", F.row_number().over(w1)).where(F.col("__r") <= k).drop("__r", "__salt")
    w2 = Window.partitionBy(*group_by).orderBy(*order)
    return pre.withColumn(name, F.row_number().over(w2).cast("bigint")).where(F.col(name) <= k)
