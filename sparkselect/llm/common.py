"""Helpers shared by the text operators: tables, written intermediate tables,
word codes of Arrow batches, and ranks within possibly hot groups."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkselect.session import checkpoint_dir

#: Fixed value: the separators of words in every contract (space, \t \n \v \f \r).
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count, which a cluster sets with its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the shared checkpoint folder, removed when the JVM ends."""
    path = f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, what: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later
    passes read columns of it, and a lost executor costs no recomputation.
    ``batch_rows``: rows of an Arrow batch in this write, for rows of long texts or lists."""
    spark = df.sparkSession
    path = f"{shared_folder(spark, what)}/table"
    before = spark.conf.get(_BATCH_ROWS)
    if batch_rows:
        spark.conf.set(_BATCH_ROWS, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(_BATCH_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def frugal(fn):
    """``fn`` over the batches of a task, after which the memory that it freed goes back to the
    system: Python workers live on after a task, and what they hold counts against the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return run


def text_groups(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.Table]:
    """The rows in order, as tables of whole rows with about ``most`` bytes of text at most
    (one longer text is a table of its own)."""
    held, size = [], 0
    for batch in batches:
        while batch.num_rows:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            n = int(np.searchsorted(ends, most - size, "right"))
            if n == 0 and not held:
                n = 1
            if n:
                held.append(batch.slice(0, n))
                size += int(ends[n - 1])
                batch = batch.slice(n)
            if batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Words:
    """The words of one Arrow batch as integer codes.

    ``codes[starts[i]:starts[i + 1]]`` are the words of row i in order and
    ``vocab[c]`` is the word of code c. Null texts have no words.
    """

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = split.offsets.to_numpy().astype(np.int64)
        values = split.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets -= offsets[0]
        full = pc.greater(pc.binary_length(values), 0)
        before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
        encoded = values.filter(full).dictionary_encode()
        self.starts = before[offsets]
        self.codes = encoded.indices.to_numpy().astype(np.int32)
        self.vocab: pa.Array = encoded.dictionary

    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def hashes(self) -> np.ndarray:
        """xxh3 of each vocabulary word, as unsigned 64-bit values."""
        digest = xxhash.xxh3_64_intdigest
        words = self.vocab.cast(pa.large_binary()).to_pylist()
        return np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words (order matters)."""
    if len(word_hashes) < n:
        return np.empty(0, np.uint64)
    size = len(word_hashes) - n + 1
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + word_hashes[i:i + size])
    return out


#: Rows from which a key's rows are joined where they lie, and keys that may then be broadcast.
HOT_ROWS = 1000
MOST_HOT_KEYS = 200_000


def spread_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner",
                counts: DataFrame | None = None, like: DataFrame | None = None) -> DataFrame:
    """``rows.join(facts, key, how)`` (inner or left) where one key may hold most of ``rows``.

    ``facts`` has one row a key at most. Keys of at least ``HOT_ROWS`` rows meet their facts by a
    broadcast, so their rows stay spread; all others by a shuffle. The floor rises with the table, so
    that no more than ``MOST_HOT_KEYS`` keys can reach it. ``counts`` (key, c) saves the counting,
    ``like`` is a written table with as many rows of each key. Null keys join nothing.
    """
    total = (like if like is not None else rows).count()
    if total < HOT_ROWS:
        return rows.join(facts, key, how)
    floor = max(HOT_ROWS, total // MOST_HOT_KEYS + 1)
    if counts is None:
        counts = (like if like is not None else rows).groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    hot = written(counts.where((F.col("c") >= floor) & F.col(key).isNotNull()).select(key), "hot-keys")
    if hot.isEmpty():
        return rows.join(facts, key, how)
    own = hot.join(facts.join(F.broadcast(hot), key), key, how)  # a left join keeps hot keys without facts
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(facts, key, how)
    return rows.join(F.broadcast(own), key).unionByName(rest)


#: Pieces that a group is numbered in; fixed, so that ranks don't depend on the cluster.
RANK_BUCKETS = 512


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Number the rows of each key group from 0, without gaps, by (bucket, order).

    The bucket is a hash of ``order``, so that a group of any size is numbered by
    many tasks: rows are ordered within (keys, bucket), and the counts of the
    earlier buckets are added. ``df`` should be a written table, as it is read twice.
    Rows equal in ``order`` get different ranks in any order.
    """
    b, before = "_bucket", "_before"
    rows = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(RANK_BUCKETS)).cast("int"))
    counts = rows.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        before, F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    own = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order)) - 1)
    left, right = own.alias("l"), offsets.alias("r")
    same = F.col(f"l.{b}") == F.col(f"r.{b}")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, same).select(
        *[F.col(f"l.{c}") for c in df.columns], (F.col("r._before") + F.col("l._in")).cast("long").alias(name))
