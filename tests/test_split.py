from pyspark.sql import functions as F

from sparkselect.operators import split as S
from tests.conftest import SF


def test_holdout_disjoint_and_complete(spark):
    from sparkselect.sources.io import table
    ev = table(spark, SF, "events")
    tr, te = S.holdout(ev, "event_id")
    assert tr.join(te, "event_id").count() == 0
    assert tr.count() + te.count() == ev.count()


def test_split_independent_of_partitioning(spark):
    from sparkselect.sources.io import table
    ev = table(spark, SF, "events")
    a = {r[0] for r in S.sample_fraction(ev, "event_id").select("event_id").collect()}
    b = {r[0] for r in S.sample_fraction(ev.repartition(7), "event_id").select("event_id").collect()}
    assert a == b


def test_folds_balanced(spark, t1):
    f = S.stratified_folds(t1, "y", "event_id", 10)
    sizes = f.groupBy("y", "fold").count().groupBy("y").agg(F.max("count") - F.min("count")).collect()
    assert all(r[1] <= 1 for r in sizes)


def test_tail_split_sizes(spark):
    from sparkselect.sources.io import table
    o = table(spark, SF, "orders")
    head, tail = S.tail_split(o, ["o_orderdate", "o_orderkey"], 0.8)
    n = o.count()
    assert head.count() == int(0.8 * n + 0.5) and tail.count() == n - int(0.8 * n + 0.5)
