"""Metrics per event-time window of a scored stream, in keyed state with timers.

Each group keeps the confusion counts of its open windows in Spark's state store. A window
whose end the watermark has passed is written once, by a timer, and its state removed; a
row that arrives for such a window is late: it is left out and counted. So state holds open
windows only, and a restarted query goes on from the last committed batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkselect.functions.metrics import metrics_from_counts
from sparkselect.session import checkpoint_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: One row a closed window and pair of labels (``kind`` window), or a batch's late rows of a group (``kind`` late).
OUTPUT = "grp string, kind string, window_start long, y double, yhat double, cnt long"


class WindowCounts(StatefulProcessor):
    """Confusion counts of tumbling windows of ``width_ms``, by event time in milliseconds."""

    def __init__(self, width_ms: int):
        self.width = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "window_start long", "y array<double>, yhat array<double>, cnt array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        late, found = 0, {}
        for part in rows:
            begin = part["event_ms"] // self.width * self.width
            gone = begin + self.width <= mark
            late += int(gone.sum())
            part = part.assign(window_start=begin)[~gone]
            for (start, y, yhat), n in part.groupby(["window_start", "y", "yhat"]).size().items():
                cells = found.setdefault(int(start), {})
                cells[float(y), float(yhat)] = cells.get((float(y), float(yhat)), 0) + int(n)
        for start, cells in found.items():
            before = self.open.getValue((start,))
            if before is None:
                self.handle.registerTimer(start + self.width)
            else:
                for y, yhat, n in zip(*before):
                    cells[y, yhat] = cells.get((y, yhat), 0) + n
            self.open.updateValue((start,), ([y for y, _ in cells], [h for _, h in cells], list(cells.values())))
        yield _rows(key, [("late", None, None, None, late)] if late else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start = expiredTimerInfo.getExpiryTimeInMs() - self.width
        cells = self.open.getValue((start,))
        self.open.removeKey((start,))
        yield _rows(key, [("window", start, *cell) for cell in zip(*cells)])

    def close(self) -> None:
        pass


def _rows(key, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["kind", "window_start", "y", "yhat", "cnt"])
    out.insert(0, "grp", key[0])
    return out.astype({"window_start": "Int64", "y": "float64", "yhat": "float64", "cnt": "int64"})


def window_counts(scored: DataFrame, time: str, group: str, y: str, yhat: str, width: int, delay: int, pieces: int = 16) -> DataFrame:
    """The stream of ``OUTPUT`` rows of a scored stream: ``width`` seconds a window, a watermark
    ``delay`` seconds behind the latest event of the batches before.

    ``time`` is a timestamp, with or without zone (then taken as UTC). Rows whose time or labels are
    null or NaN belong to no window and take no part; a null group is a group of its own. A group's rows
    are dealt to ``pieces`` keys by hash, so that a busy group is not one task's; the counts of a window
    are the sum over its keys."""
    at = F.col(time)
    if dict(scored.dtypes)[time] == "timestamp_ntz":
        at = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at))
    label = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    marked = scored.select(at.alias("event_time"), F.col(group).cast("string").alias("grp"), label(y).alias("y"), label(yhat).alias("yhat")) \
        .withWatermark("event_time", f"{delay} seconds")
    # the time goes on as a number, so that rows behind the watermark reach the counter of late rows
    rows = marked.where("event_time IS NOT NULL AND y IS NOT NULL AND yhat IS NOT NULL") \
        .select("grp", F.floor(F.unix_micros("event_time") / 1000).cast("long").alias("event_ms"), "y", "yhat",
                F.pmod(F.xxhash64("event_time", "y", "yhat"), F.lit(pieces)).cast("int").alias("piece"))
    return rows.groupBy("grp", "piece").transformWithStateInPandas(
        WindowCounts(width * 1000), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime")


class WindowedMetrics:
    """A windowed query with a folder of its own below the shared checkpoint folder (or ``path``, to go on
    with an earlier one). ``drain`` takes all input there is; call it again when there is more."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{checkpoint_dir(spark).rstrip('/')}/windows-{uuid.uuid4().hex}"

    def drain(self, counts: DataFrame) -> None:
        before = self.spark.conf.get(_PROVIDER)
        self.spark.conf.set(_PROVIDER, _ROCKS)
        try:
            q = counts.writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/state") \
                .outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
        finally:
            self.spark.conf.set(_PROVIDER, before)

    def counts(self) -> DataFrame:
        return self.spark.read.schema(OUTPUT).parquet(f"{self.path}/out")

    def late(self) -> DataFrame:
        """(grp, late rows) of the groups that had any."""
        return self.counts().where("kind = 'late'").groupBy("grp").agg(F.sum("cnt").alias("late_rows"))

    def metrics(self) -> DataFrame:
        """H1-H7 of each group's closed windows."""
        return window_metrics(self.counts().where("kind = 'window'"))


def window_metrics(cells: DataFrame) -> DataFrame:
    """H1-H7 of (grp, window_start) from rows (grp, window_start, y, yhat, cnt); a null group stays."""
    c = cells.groupBy(F.coalesce("grp", F.lit("")).alias("g"), F.col("grp").isNull().alias("none"), "window_start", "y", "yhat").agg(F.sum("cnt").alias("cnt"))
    out = metrics_from_counts(c, ["g", "none", "window_start"])
    return out.select(F.when(~F.col("none"), F.col("g")).alias("grp"), *[k for k in out.columns if k not in ("g", "none")])
