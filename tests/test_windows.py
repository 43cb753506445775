import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkselect.streaming.windows import WindowedMetrics, window_counts

SCHEMA = "t timestamp, g string, y int, p int"
NOON = dt.datetime(2024, 3, 1, 12)


def _row(minutes, g="a", y=1, p=1):
    return (None if minutes is None else NOON + dt.timedelta(minutes=minutes), g, y, p)


def _add(spark, run, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{run.path}/in")


def _stream(spark, run, read=lambda s: s):
    s = read(spark.readStream.schema(SCHEMA).parquet(f"{run.path}/in"))
    return window_counts(s, "t", "g", "y", "p", 600, 300, pieces=3)


def _cells(run):
    out = {}
    for r in run.counts().where("kind = 'window'").collect():
        k = (r["grp"], round(r["window_start"] / 60000 - NOON.replace(tzinfo=dt.UTC).timestamp() / 60), r["y"], r["yhat"])
        out[k] = out.get(k, 0) + r["cnt"]
    return out


def test_windows_late_rows_restart_and_failure(spark):
    run = WindowedMetrics(spark)
    # latest 17, so the watermark goes to 12: the window from 0 closes, the one from 10 stays open
    _add(spark, run, [_row(0), _row(9), _row(9, p=0), _row(17), _row(4, "b", 0, 0), _row(3, None), _row(None), _row(5, "a", None), _row(6, "a", 1, None)])
    run.drain(_stream(spark, run))
    first = {("a", 0, 1.0, 1.0): 2, ("a", 0, 1.0, 0.0): 1, ("b", 0, 0.0, 0.0): 1, (None, 0, 1.0, 1.0): 1}
    assert _cells(run) == first and run.late().count() == 0

    # a batch that fails leaves nothing behind and is taken again by a new query on the same folder
    _add(spark, run, [_row(2), _row(9, "b"), _row(11), _row(16, "a", 0, 1), _row(31, "b")])
    bad = F.when(F.col("g") == "b", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("g"))
    with pytest.raises(Exception, match="lost"):
        run.drain(_stream(spark, run, lambda s: s.withColumn("g", bad)))
    assert _cells(run) == first
    again = WindowedMetrics(spark, run.path)
    again.drain(_stream(spark, again))
    # 31 closes the window from 10 of every group, with its row of the first drain; 2 and 9 were late
    assert _cells(again) == {**first, ("a", 10, 1.0, 1.0): 2, ("a", 10, 0.0, 1.0): 1}
    assert {r["grp"]: r["late_rows"] for r in again.late().collect()} == {"a": 1, "b": 1}

    # a drain without new rows changes nothing
    again.drain(_stream(spark, again))
    got = {(r["grp"], r["window_start"] // 600_000 * 10 - int(NOON.replace(tzinfo=dt.UTC).timestamp()) // 60): r for r in again.metrics().collect()}
    assert {k: r["n"] for k, r in got.items()} == {("a", 0): 3, ("a", 10): 3, ("b", 0): 1, (None, 0): 1}
    assert got["a", 0]["accuracy"] == pytest.approx(2 / 3)
    assert sum(again.late().toPandas()["late_rows"]) == 2


def test_session_setting_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    run = WindowedMetrics(spark)
    _add(spark, run, [])
    run.drain(_stream(spark, run))
    assert spark.conf.get(name) == before and run.counts().count() == 0
