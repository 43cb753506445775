"""As-of, interval and range joins and the fairness cube against plain loops."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparkselect.operators.fairness import fairness_cube
from sparkselect.operators.temporal import as_of_join, interval_join, range_join


@pytest.mark.parametrize("slice_rows", [5, 10**6])
def test_as_of_equals_a_scan(spark, slice_rows):
    rnd = random.Random(51)
    key = lambda: rnd.choice(["a", "a", "a", "b", None])
    time = lambda: rnd.choice([None, *range(60)])
    left = [(i, key(), time(), 7) for i in range(200)] + [(300, "a", 30, 7)] * 3 + [(400, "only left", 5, 7)]
    right = [(i, key(), time(), rnd.choice([None, 1.5, 2.5, float(i)])) for i in range(80)]
    a = spark.createDataFrame(left, "id long, k string, t long, value int")
    b = spark.createDataFrame(right, "rid long, k string, t long, value double")
    for within in (None, 4):
        got = as_of_join(a, b, [("k", "k")], ("t", "t"), ["value", "rid"], tie="rid", within=within, prefix="r_", slice_rows=slice_rows)
        assert got.columns == ["id", "k", "t", "value", "r_t", "r_value", "r_rid"]
        want = []
        for i, k, t, v in left:
            best = max(((rt, rid, rv) for rid, rk, rt, rv in right if k is not None and rk == k and t is not None and rt is not None and rt <= t), default=None, key=lambda x: x[:2])
            if best and within is not None and t - best[0] > within:
                best = None
            want.append((i, k, t, v, *((best[0], best[2], best[1]) if best else (None, None, None))))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_as_of_without_keys_on_timestamps_and_empty_sides(spark):
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    a = spark.createDataFrame([(i, day(i)) for i in range(40)], "id long, at timestamp")
    b = spark.createDataFrame([(day(10), "x"), (day(20), "y"), (day(20), "z")], "since timestamp, name string")
    got = as_of_join(a, b, [], ("at", "since"), ["name"], within=5 * 86400, slice_rows=7).orderBy("id").collect()
    assert [r.name for r in got] == [None] * 10 + ["x"] * 6 + [None] * 4 + ["z"] * 6 + [None] * 14
    assert as_of_join(a.where("id < 0"), b, [], ("at", "since"), ["name"]).collect() == []
    assert {r.name for r in as_of_join(a, b.where("name is null"), [], ("at", "since"), ["name"]).collect()} == {None}


def test_interval_join_equals_all_pairs(spark):
    rnd = random.Random(52)

    def some(n):
        out = []
        for i in range(n):
            s = rnd.choice([None, *[rnd.uniform(-50, 50) for _ in range(8)], 0.0])
            size = rnd.choice([0.0, -1.0, 0.5, 1.0, 3.0, 8.0, 64.0, 500.0, 1e-6])
            out.append((i, rnd.choice(["a", "a", "b", None]), s, None if s is None or rnd.random() < 0.05 else s + size))
        return out + [(n, "a", float("nan"), 1.0), (n + 1, "a", 0.0, 8.0), (n + 2, "a", 8.0, 16.0)]

    left, right = some(150), some(120)
    a, b = (spark.createDataFrame(r, "id long, k string, s double, e double") for r in (left, right))
    ok = lambda s, e: s is not None and e is not None and s == s and s < e
    pairs = [(x, y) for x, y in itertools.product(left, right) if ok(*x[2:]) and ok(*y[2:]) and x[2] < y[3] and y[2] < x[3]]
    got = interval_join(a, b, ("s", "e"), ("s", "e"))
    assert got.columns == ["id_l", "k_l", "s_l", "e_l", "id_r", "k_r", "s_r", "e_r"]
    assert sorted((r.id_l, r.id_r) for r in got.collect()) == sorted((x[0], y[0]) for x, y in pairs)
    keyed = interval_join(a, b, ("s", "e"), ("s", "e"), [("k", "k")]).collect()
    assert sorted((r.id_l, r.id_r) for r in keyed) == sorted((x[0], y[0]) for x, y in pairs if x[1] is not None and x[1] == y[1])
    inside = range_join(a, b, "s", ("s", "e")).collect()
    assert sorted((r.id_l, r.id_r) for r in inside) == sorted((x[0], y[0]) for x, y in itertools.product(left, right) if x[2] is not None and x[2] == x[2] and ok(*y[2:]) and y[2] <= x[2] < y[3])
    assert interval_join(a.where("id < 0"), b, ("s", "e"), ("s", "e")).collect() == []


@pytest.mark.parametrize("always_slice", [False, True])
def test_range_totals_equal_sums_over_pairs(spark, always_slice):
    rnd = random.Random(54)
    key = lambda: rnd.choice(["a", "a", "b", None])
    points = [(rnd.choice([None, *range(60)]), key(), rnd.choice([None, float("nan"), *[float(x) for x in range(-5, 30)]])) for _ in range(150)]
    ranges = [(rnd.choice([None, i]), key(), s, s + rnd.choice([0.0, -1.0, 1.0, 4.0, 20.0, float("inf")])) for i in range(100) for s in [float(rnd.randint(-5, 25))]]
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "n int, id long, k string, t double")
    b = spark.createDataFrame(ranges, "v long, k string, s double, e double")
    totals = {"n": F.lit(1), "sum": F.col("v") % 7}
    if always_slice:
        spark.conf.set("sparkselect.singleSliceRows", "0")
    try:
        for on in ([], [("k", "k")]):
            pairs = range_join(a, b, "t", ("s", "e"), on).groupBy("n_l", "id_l", "k_l", "t_l").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v_r") % 7).alias("sum"))
            got = range_join(a, b, "t", ("s", "e"), on, totals=totals)
            assert got.columns == pairs.columns and len(pairs.head(1)) == 1
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, pairs.collect())))
    finally:
        spark.conf.unset("sparkselect.singleSliceRows")
    assert range_join(a, b.where("v < 0"), "t", ("s", "e"), totals=totals).collect() == []
    with pytest.raises(ValueError, match="whole numbers"):
        range_join(a, b, "t", ("s", "e"), totals={"x": F.col("s")})


def test_open_orders_makes_no_pairs(spark):
    from sparkselect.plans.catalog_temporal import range_open_orders
    plan = range_open_orders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "__first" not in plan and "Generate" not in plan


def test_fairness_cube_and_its_pruning(spark):
    rnd = random.Random(53)
    rows = [(rnd.choice("xy"), rnd.choice(["p", "q", None]), rnd.choice("123"), rnd.randint(0, 1), rnd.choice([0, 1, 1, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string, c string, y int, p int")
    for least in (1, 20):
        got = {(r["columns"], r.a, r.b, r.c): r for r in fairness_cube(df, "y", "p", ["a", "b", "c"], least).collect()}
        want = {}
        for m in range(8):
            for row in rows:
                if row[4] is not None:
                    key = (",".join(n for i, n in enumerate("abc") if m >> i & 1), *[row[i] if m >> i & 1 else None for i in range(3)])
                    want.setdefault((m, key), []).append(row)
        want = {k[1]: v for k, v in want.items() if len(v) >= least}
        assert set(got) == set(want)
        overall = got["", None, None, None].selection_rate
        for key, own in want.items():
            r, pos = got[key], [x for x in own if x[3] == 1]
            assert r.n == len(own) and r.selection_rate == pytest.approx(sum(x[4] for x in own) / len(own)) and r.gap == pytest.approx(r.selection_rate - overall)
            assert r.tpr == (pytest.approx(sum(x[4] for x in pos) / len(pos)) if pos else None)
    assert fairness_cube(df.where(F.lit(False)), "y", "p", ["a"]).collect() == []


def test_keys_of_few_rows_are_joined_without_buckets(spark, monkeypatch):
    from sparkselect.operators import temporal

    rnd = random.Random(53)
    rows = [(i, rnd.choice([None, *range(12)]), s, s + rnd.choice([-1, 0, 2, 40])) for i, s in enumerate(rnd.choices(range(60), k=90))]
    df = spark.createDataFrame(rows, "id long, k int, s int, e int")
    want = sorted((x[0], y[0]) for x, y in itertools.product(rows, rows) if x[1] is not None and x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3])
    pairs = lambda: sorted(tuple(r) for r in interval_join(df, df, ("s", "e"), ("s", "e"), [("k", "k")]).select("id_l", "id_r").collect())
    with monkeypatch.context() as m:
        m.setattr(temporal, "_bucketed", None)
        assert pairs() == want
    for most in (3, 0):  # some keys, then all keys in buckets
        monkeypatch.setattr(temporal, "PAIRS_A_ROW", most)
        assert pairs() == want
