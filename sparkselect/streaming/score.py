"""Structured Streaming: score arriving rows with a fitted model and keep
running metrics.

The reference scores a second table once; on a stream the same fitted
``PipelineModel`` applies to every micro-batch (row-wise transforms are
stateless), and the confusion counts behind H1-H7 are a streaming
aggregation kept in Spark's state store. Outputs go to a durable sink under
the session's checkpoint folder, never to driver memory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkselect.functions.metrics import confusion_counts, metrics_from_counts
from sparkselect.session import checkpoint_dir


#: Partitions of the running counts: a row per pair of labels, whatever the input.
STATE_PARTITIONS = 8
_PARTITIONS = "spark.sql.shuffle.partitions"


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: StructType,
                 max_files: int = 1) -> DataFrame:
    """A file stream over one driver table (``{name}.parquet`` in ``sf_dir``)."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", max_files).parquet(sf_dir))


def score_stream(model, stream: DataFrame, keep: list[str], label_col: str = "Predictions") -> DataFrame:
    """The streaming twin of J3: rows with the model's label appended."""
    scored = model.transform(stream)
    return scored.select(*keep, F.col("prediction").alias(label_col))


def _paths(spark: SparkSession, tag: str) -> tuple[str, str]:
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{tag}-{uuid.uuid4().hex[:10]}"
    return f"{base}/out", f"{base}/state"


def run_to_table(stream: DataFrame, tag: str = "scored") -> DataFrame:
    """Drain the stream (available-now trigger) into Parquet and read it back."""
    spark = stream.sparkSession
    out, ckpt = _paths(spark, tag)
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def running_metrics(scored: DataFrame, y: str, yhat: str, tag: str = "metrics") -> DataFrame:
    """Running H1-H7 over a scored stream: confusion counts are a stateful streaming
    aggregation; each micro-batch rewrites the metric table from the full counts. The counts
    lie in ``STATE_PARTITIONS`` at most, as every batch runs a task for each and reports it."""
    spark = scored.sparkSession
    out, ckpt = _paths(spark, tag)
    counts = confusion_counts(scored, y, yhat)

    def publish(batch: DataFrame, _epoch: int):
        metrics_from_counts(batch).write.mode("overwrite").parquet(out)

    before = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, str(min(STATE_PARTITIONS, int(before))))
    try:  # a stream keeps the settings that it is started with
        q = (counts.writeStream.outputMode("complete").option("checkpointLocation", ckpt)
             .foreachBatch(publish).trigger(availableNow=True).start())
    finally:
        spark.conf.set(_PARTITIONS, before)
    q.awaitTermination()
    return spark.read.parquet(out)
