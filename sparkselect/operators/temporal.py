"""Point-in-time features for training rows: as-of join, interval and range join.

As-of join: times of a key are sorted together with the other side's, and the last value is carried
forward. Equal (key, time) pairs are reduced to one row on both sides first, and keys with more than
``slice_rows`` pairs are cut into slices of time, each with a window of its own; the last value of every slice is
carried to the next ones by a window over the slices. No key is sorted whole in one task.

Interval join: rows of a key of few rows meet each other directly, once shuffled by the key. Where a key's pairs are many
for its rows, or no keys are given, every interval gets a level by its length and lies in a few buckets of that level's
width; on each higher level in use it lies in at most two. Two intervals meet on the higher of their levels, and a pair
comes from the first bucket that they share, so that no pair is made twice and none is dropped afterwards.

Range join with ``totals``: only counts and sums over the ranges that hold a point are asked for. A range adds its values
where it starts and takes them back where it ends, and a running total over these places, cut into slices, gives the sums
at every point: work grows with points and ranges, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sparkselect.functions.ranking import running_totals
from sparkselect.session import stored

SLICE_ROWS = 1_000_000
#: Hot keys' cut points are broadcast up to so many rows.
BROADCAST_ROWS = 100_000
#: Widths of neighbouring levels differ by this factor; an interval spans at most FACTOR + 1 buckets of its own level.
FACTOR = 8
#: A key is joined directly while its pairs are at most PAIRS_A_ROW times its rows and those at most DIRECT_ROWS.
PAIRS_A_ROW = 32
DIRECT_ROWS = 10_000


def _number(c: Column, kind: str) -> Column:
    return F.unix_micros(c.cast("timestamp")).cast("double") if kind.startswith("timestamp") or kind == "date" else c.cast("double")


def as_of_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], times: tuple[str, str], values: Sequence[str], tie: str | None = None,
               within: float | None = None, prefix: str = "", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each row of ``left`` with ``values`` of the last row of ``right`` that has the same key and a time at or before its own.

    ``on`` pairs key columns, ``times`` names both time columns. Of rows of ``right`` with the same key and time the one
    with the largest ``tie`` counts (None: the largest values). ``within``: matches older than that (seconds for
    timestamps) are none. Null keys or times match nothing; every row of ``left`` stays, with nulls if
    nothing matches. Added columns: the values and right time, named with ``prefix``."""
    kind = dict(left.dtypes)[times[0]]
    keys = [f"__k{i}" for i in range(len(on))]
    l_keys, r_keys = ([F.col(f"`{pair[side]}`").alias(k) for pair, k in zip(on, keys, strict=True)] for side in (0, 1))
    known = lambda cols, t: F.col(f"`{t}`").isNotNull() & ~F.exists(F.array(*[F.col(f"`{c}`").isNull() for c in cols]), lambda x: x) if cols else F.col(f"`{t}`").isNotNull()
    right_names = [p[1] for p in on]
    value = F.struct(F.col(f"`{times[1]}`").alias("__rt"), *[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)])
    r = right.where(known(right_names, times[1])).select(*r_keys, F.col(f"`{times[1]}`").cast(kind).alias("__t"), value.alias("__v"), (F.col(f"`{tie}`") if tie else F.struct(*[F.col(f"`{v}`") for v in values])).alias("__o"))
    r = r.groupBy(*keys, "__t").agg(F.max_by("__v", "__o").alias("__v"))
    asked = left.where(known([p[0] for p in on], times[0])).select(*l_keys, F.col(f"`{times[0]}`").alias("__t")).distinct()
    # one row per (key, time): asked or a value or both, values at the same time count
    line = r.withColumn("__asked", F.lit(False)).unionByName(asked.withColumn("__asked", F.lit(True)), allowMissingColumns=True)
    line = stored(line.groupBy(*keys, "__t").agg(F.max("__v").alias("__v"), F.max("__asked").alias("__asked")), "as-of-times").frame
    cut = _sliced(line, keys, slice_rows, kind)
    before = Window.partitionBy(*keys, "__slice").orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("__last", F.last("__v", ignorenulls=True).over(before))
    ends = cut.where(F.col("__v").isNotNull()).groupBy(*keys, "__slice").agg(F.max_by("__v", "__t").alias("__end"))
    slices = cut.groupBy(*keys, "__slice").agg(F.max("__asked").alias("__any")).join(ends, [*keys, "__slice"], "left") if keys else cut.groupBy("__slice").agg(F.max("__asked").alias("__any")).join(ends, "__slice", "left")
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("__carry", F.last("__end", ignorenulls=True).over(earlier)).select(*keys, "__slice", "__carry")
    found = own.where("__asked").join(carried, [*keys, "__slice"]).select(*keys, "__t", F.coalesce("__last", "__carry").alias("__m"))
    joined = left.withColumns({k: F.col(f"`{pair[0]}`") for k, pair in zip(keys, on, strict=True)}).withColumn("__t", F.col(f"`{times[0]}`")).join(found, [*keys, "__t"], "left")
    match = F.col("__m")
    if within is not None:
        span = F.lit(float(within) * (1e6 if kind.startswith("timestamp") else 1.0))
        match = F.when(_number(F.col("__t"), kind) - _number(F.col("__m.__rt"), kind) <= span, F.col("__m"))
    out = joined.withColumn("__m", match)
    return out.select(*[F.col(f"`{c}`") for c in left.columns], F.col("__m.__rt").alias(f"{prefix}{times[1]}"), *[F.col(f"__m.v{i}").alias(f"{prefix}{v}") for i, v in enumerate(values)])


def _sliced(line: DataFrame, keys: list[str], slice_rows: int, kind: str) -> DataFrame:
    """``line`` with a slice number that grows with the time of a key; keys of at most ``slice_rows`` rows have one."""
    hot = stored(line.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > slice_rows), "as-of-hot").frame
    most = hot.agg(F.max("__n")).first()[0]
    if most is None:
        return line.withColumn("__slice", F.lit(0))
    pieces = min(10_000, -(-most // slice_rows) + 1)
    few = hot.count() <= BROADCAST_ROWS
    small = F.broadcast(hot.drop("__n")) if few else hot.drop("__n")
    number = _number(F.col("__t"), kind)
    chosen = line.join(small, keys, "left_semi") if keys else line
    cuts = chosen.groupBy(*keys).agg(F.percentile_approx(number, [i / pieces for i in range(1, pieces)], 100 * pieces).alias("__cuts"))
    cuts = stored(cuts, "as-of-cuts").frame
    placed = line.join(F.broadcast(cuts) if few else cuts, keys, "left") if keys else line.crossJoin(F.broadcast(cuts))  # without keys: the one row of cuts
    return placed.withColumn("__slice", F.coalesce(F.size(F.filter("__cuts", lambda c: c < number)), F.lit(0))).drop("__cuts")


def _level_width(a: DataFrame, b: DataFrame) -> float:
    """Width of level 0: a tenth of all positive lengths are shorter."""
    length = (F.col("__hi") - F.col("__lo")).alias("len")
    w = a.select(length).union(b.select(length)).where("len > 0").agg(F.percentile_approx("len", 0.1, 1000)).first()[0]
    return float(w) if w else 1.0


def _bucketed(df: DataFrame, width: float, levels: list[int]) -> DataFrame:
    """A row per (level, bucket) that an interval takes part in; ``__first`` is its first bucket there."""
    level_of = F.col("__level")
    w = lambda l: F.lit(width) * F.pow(F.lit(float(FACTOR)), l.cast("double"))
    used = F.filter(F.array(*[F.lit(x) for x in levels]), lambda l: l >= level_of)
    rows = df.withColumn("__l", F.explode(used))
    first, last = (F.floor(F.col(c) / w(F.col("__l"))).cast("long") for c in ("__lo", "__in"))
    return rows.withColumn("__first", first).withColumn("__b", F.explode(F.sequence(first, last)))


def _spans(df: DataFrame, span: tuple[str, str], keys: Sequence[str], suffix: str, *more: Column) -> DataFrame:
    """Rows with numbered ``keys``, the finite ends ``__lo`` and ``__hi`` of spans that are not empty, the row itself and ``more``."""
    kinds = dict(df.dtypes)
    lo, hi = (_number(F.col(f"`{c}`"), kinds[c]) for c in span)
    rows = df.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], lo.alias("__lo"), hi.alias("__hi"),
                     F.struct(*[F.col(f"`{c}`").alias(f"{c}{suffix}") for c in df.columns]).alias("__row"), *more)
    rows = rows.where(F.col("__lo") <= F.col("__hi") if span[0] == span[1] else F.col("__lo") < F.col("__hi"))
    return rows.where(~F.isnan("__lo") & ~F.isnan("__hi") & (F.abs("__lo") < float("inf")) & (F.abs("__hi") < float("inf")))


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: Sequence[tuple[str, str]] = (), suffixes: tuple[str, str] = ("_l", "_r")) -> DataFrame:
    """All pairs of rows whose intervals [start, end) overlap, with equal keys ``on`` if given.

    A span whose two columns are the same name is a point: it overlaps the intervals with start <= point < end.
    Empty intervals (end <= start) and nulls overlap nothing. Columns get the suffixes."""
    a, b = (_spans(df, span, [pair[side] for pair in on], suffixes[side]) for side, (df, span) in enumerate(((left, left_span), (right, right_span))))
    points = left_span[0] == left_span[1], right_span[0] == right_span[1]
    keys = [f"__k{i}" for i in range(len(on))]
    if not keys or any(dict(a.dtypes)[k] != dict(b.dtypes)[k] for k in keys):
        return _bucket_join(a, b, points, keys)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = a.select(*keys, one.alias("__a"), none.alias("__b")).unionByName(b.select(*keys, none.alias("__a"), one.alias("__b"))).dropna(subset=keys)
    n, pairs = F.col("__a") + F.col("__b"), F.col("__a") * F.col("__b")
    counts = rows.groupBy(*keys).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    busy = stored(counts.where((pairs > PAIRS_A_ROW * n) | (n > DIRECT_ROWS)).where(pairs > 0).select(*keys), "interval-keys").frame
    found = busy.count()
    if not found:
        return _direct_join(a, b, points, keys)
    small = F.broadcast(busy) if found <= BROADCAST_ROWS else busy
    direct = _direct_join(a.join(small, keys, "left_anti"), b.join(small, keys, "left_anti"), points, keys)
    return direct.unionByName(_bucket_join(a.join(small, keys, "left_semi"), b.join(small, keys, "left_semi"), points, keys))


def _overlap(points: tuple[bool, bool]) -> Column:
    if points[0]:
        return (F.col("b.__lo") <= F.col("a.__lo")) & (F.col("a.__lo") < F.col("b.__hi"))
    if points[1]:
        return (F.col("a.__lo") <= F.col("b.__lo")) & (F.col("b.__lo") < F.col("a.__hi"))
    return (F.col("a.__lo") < F.col("b.__hi")) & (F.col("b.__lo") < F.col("a.__hi"))


def _direct_join(a: DataFrame, b: DataFrame, points: tuple[bool, bool], keys: list[str]) -> DataFrame:
    meet = _overlap(points)
    for k in keys:
        meet = meet & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.alias("a").join(b.alias("b"), meet).select("a.__row.*", "b.__row.*")


def _bucket_join(a: DataFrame, b: DataFrame, points: tuple[bool, bool], keys: list[str]) -> DataFrame:
    width = _level_width(a, b)

    def levelled(df: DataFrame, point: bool) -> DataFrame:
        length = F.col("__hi") - F.col("__lo")
        level = F.greatest(F.lit(0.0), F.ceil(F.log(F.greatest(length / F.lit(width), F.lit(1.0))) / F.log(F.lit(float(FACTOR)))) - 1)
        # an end outside belongs to the bucket before it only if it is that bucket's border: a bucket more does no harm
        return df.withColumn("__level", F.lit(0) if point else level.cast("int")).withColumn("__in", F.col("__hi"))

    a, b = levelled(a, points[0]), levelled(b, points[1])
    levels = sorted({r[0] for r in a.select("__level").distinct().union(b.select("__level").distinct()).distinct().collect()})
    la, lb = _bucketed(a, width, levels).alias("a"), _bucketed(b, width, levels).alias("b")
    meet = (F.col("a.__l") == F.col("b.__l")) & (F.col("a.__b") == F.col("b.__b"))
    for k in keys:
        meet = meet & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    once = (F.col("a.__l") == F.greatest("a.__level", "b.__level")) & (F.col("a.__b") == F.greatest("a.__first", "b.__first"))
    return la.join(lb, meet & once & _overlap(points)).select("a.__row.*", "b.__row.*")


def range_join(points: DataFrame, ranges: DataFrame, point: str, span: tuple[str, str], on: Sequence[tuple[str, str]] = (), suffixes: tuple[str, str] = ("_l", "_r"),
               totals: Mapping[str, Column] | None = None) -> DataFrame:
    """Every point with every range [start, end) that holds it.

    With ``totals`` (name to a whole-number expression over ``ranges``) instead every point that a range holds, once, with
    the sums over all of its ranges (nulls left out, null if there are only nulls; ``F.lit(1)`` counts them); no pair is made."""
    if totals is None:
        return interval_join(points, ranges, (point, point), span, on, suffixes)
    values = ranges.select(*[v.alias(name) for name, v in totals.items()])
    broken = [f.name for f in values.schema.fields if not isinstance(f.dataType, IntegralType)]
    if broken:
        raise ValueError(f"totals of whole numbers only, as sums are taken back at the ends of ranges: {broken}")
    keys, n = [f"__k{i}" for i in range(len(on))], range(len(totals))
    a = _spans(points, (point, point), [pair[0] for pair in on], suffixes[0])
    b = _spans(ranges, span, [pair[1] for pair in on], "", *[v.cast("long").alias(f"__v{i}") for i, v in enumerate(totals.values())])

    def changes(at: str, sign: int) -> DataFrame:
        one = F.lit(sign).cast("long")
        return b.select(*keys, F.col(at).alias("__at"), F.lit(False).alias("__asked"), one.alias("__n"), *[c for i in n for c in (
            (one * F.coalesce(f"__v{i}", F.lit(0))).alias(f"__s{i}"), F.when(F.col(f"__v{i}").isNotNull(), one).otherwise(0).alias(f"__n{i}"))])

    sums = ["__n", *[f"__{c}{i}" for i in n for c in "sn"]]
    asked = a.select(*keys, F.col("__lo").alias("__at"), F.lit(True).alias("__asked"), *[F.lit(0).cast("long").alias(c) for c in sums]).distinct()
    line = changes("__lo", 1).unionByName(changes("__hi", -1)).unionByName(asked).dropna(subset=keys or ["__at"])
    line = stored(line.groupBy(*keys, "__at").agg(F.max("__asked").alias("__asked"), *[F.sum(c).alias(c) for c in sums]), "range-totals").frame
    held = running_totals(line, [*keys, "__at"], {f"{c}_to": c for c in sums}, keys).where("__asked AND __n_to > 0")
    held = held.select(*keys, F.col("__at").alias("__lo"), *[F.when(F.col(f"__n{i}_to") > 0, F.col(f"__s{i}_to")).alias(f"__t{i}") for i in n])
    return a.join(held, [*keys, "__lo"]).select("__row.*", *[F.col(f"__t{i}").alias(name) for i, name in enumerate(totals)])
