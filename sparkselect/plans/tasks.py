"""Task views over the driver tables.

Each view is a lazy DataFrame over the parquet tables, so every query that
starts from one grows with the data. Text of T1 and T2 is fixed so that the
same rows come out of Spark and of DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkselect.sources.io import table

# T1 rule threshold and noise share (20 of 256 hash values flip the label).
T1_THRESHOLD = 90.0
T1_FLIP_BELOW = 20


def t1_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 binary: value, k, hour and event type against a noisy rule."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    flip = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 2), 16, 10).cast("bigint")
    rule = (F.col("value") + F.col("k") > T1_THRESHOLD)
    return e.select("event_id", "value", k.alias("k"), F.hour("ts").alias("h"), "event_type",
                    flip.alias("__flip")) \
        .withColumn("y", F.when(rule != (F.col("__flip") < T1_FLIP_BELOW), 1).otherwise(0)) \
        .drop("__flip")


def t2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 imbalanced: text statistics of labelled documents against ``quality``."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    doc = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", "lang", "source")
    words = F.split("text", "[ \n]+")
    return lab.join(doc, "doc_id", "inner").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("c"),
        F.size(words).cast("double").alias("w"),
        F.length(F.regexp_replace("text", "[A-Za-zÀ-ÿ .,\n]", "")).cast("double").alias("np"),
        F.size(F.array_distinct(words)).cast("double").alias("u"),
        "lang", "source", F.col("quality").alias("y"))


def t3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 multi-class: 64-wide vectors, label 0..9."""
    from pyspark.ml.functions import array_to_vector
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
                    F.col("label").alias("y"))


def t4_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 keyed facts: orders with their customer."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "inner").drop("c_custkey")


# Null-injection rules for T4 (same text in the oracle).
def orders_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nulls by rule: price when key % 7 = 0, priority when key % 11 = 0."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
