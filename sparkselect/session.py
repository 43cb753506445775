"""Session helpers.

The library never creates a cluster session by itself: callers pass one in.
``get_session`` is for tests, benches and scripts on one machine.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                app: str = "sparkselect") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    parts = shuffle_partitions or (8 if cpus == "*" else int(cpus))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # one machine: a folder of its own is shared by all
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sparkselect-ckpt-", dir="/tmp"))
        .config("spark.driver.memory", os.environ.get("SPARKSELECT_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        # checkpoint files of materialised tables go away once nothing references them
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints.

    Uses the directory already set on the context or ``spark.checkpoint.dir``
    from the session conf. Only a local-mode session (tests, bench) may fall
    back to a fresh scratch folder; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    scratch = tempfile.mkdtemp(prefix="sparkselect-ckpt-", dir="/tmp")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def cut_lineage(df):
    """Reliable checkpoint (never a local one): survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df):
    """Write a derived table (typically an aggregate reused several times) to the
    checkpoint folder once, so later passes read it instead of rescanning and
    recomputing the source; also survives lost executors. Set
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` to have the files removed
    when the table is no longer referenced."""
    return cut_lineage(df)


class Stored:
    """A table written to the shared checkpoint folder (``one``: read as a single partition); ``drop`` deletes its files."""

    def __init__(self, frame, path: str, one: bool):
        self.frame, self.path, self.one = frame, path, one

    def drop(self) -> None:
        jvm = self.frame.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.frame.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def stored(df, what: str, one: bool = False, file_rows: int = 0) -> Stored:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back: passes read
    columns of it, and iterative fits drop it when the next state is written. The files go
    when the JVM ends, if not dropped before. ``file_rows`` bounds the rows of a file (0: not)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    df.write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/table")
    frame = spark.read.schema(df.schema).parquet(f"{path}/table")
    return Stored(frame.coalesce(1) if one else frame, path, one)


def tasks(spark) -> int:
    """Tasks to deal costly rows to: a few a core, and no fewer than shuffles have."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stored_wide(df, what: str) -> Stored:
    """``stored`` with the rows dealt to ``tasks`` files, for tables that many passes read: the rows
    of a small file, or of a shuffle that was made small, are otherwise one task's in every pass."""
    return stored(df.repartition(tasks(df.sparkSession)), what)


#: Rows of a file of a table that iterative fits read.
FILE_ROWS = 100_000


def stored_split(df, what: str) -> Stored:
    """``stored`` in files of ``FILE_ROWS`` rows, which all cores read, for iterative fits: neither are the
    columns computed again in every pass, nor is a pass one task, because the source is one file or row
    group. No shuffle; a small table keeps its partition and order, and with them sampled split points and draws."""
    return stored(df, what, file_rows=FILE_ROWS)
