"""Joins and components whose rows mostly share one key give what the plain forms give."""

from pyspark.sql import functions as F

from sparkselect.llm.common import HOT_ROWS, spread_join
from sparkselect.llm.graph import components


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_spread_join_equals_join(spark):  # noqa: F811
    n = 3 * HOT_ROWS
    rows = spark.range(3 * n).select(
        F.when(F.col("id") < n, 1).when(F.col("id") < 2 * n, 2).when(F.col("id") < 2 * n + 50, F.lit(None)).otherwise(F.col("id") % 97).cast("long").alias("k"), "id")
    facts = spark.createDataFrame([(1, "a"), (5, "b"), (None, "c"), (200, "d")], "k long, f string")  # 2 is hot and has no facts
    for how in ("inner", "left"):
        assert _rows(spread_join(rows, facts, "k", how).select("k", "id", "f")) == _rows(rows.join(facts, "k", how).select("k", "id", "f"))
    assert spread_join(rows.limit(0), facts, "k").count() == 0


def test_star_and_chain_are_components(spark):  # noqa: F811
    star = spark.range(1, 4 * HOT_ROWS).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(10_000, 10_300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    high = spark.range(20_000, 20_000 + 2 * HOT_ROWS).select(F.col("id").alias("a"), F.lit(90_000).cast("long").alias("b"))
    got = components(star.union(chain).union(high)).collect()
    groups = {}
    for node, comp in got:
        groups.setdefault(comp, set()).add(node)
    assert sorted(map(len, groups.values())) == [301, 2 * HOT_ROWS + 1, 4 * HOT_ROWS]
    assert all(comp in nodes for comp, nodes in groups.items())
