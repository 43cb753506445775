"""Sources and sinks (A1-A10).

Paths are any Hadoop URI. Reads are lazy, so filters and projections placed
after them reach the scan (``PushedFilters`` / ``ReadSchema`` in the plan).
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table: ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str | None = None) -> DataFrame:
    """A1: CSV with a header (types inferred unless a schema is given) or Parquet."""
    kind = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if kind == "parquet":
        r = spark.read
        return (r.schema(schema) if schema is not None else r).parquet(path)
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def read_validation(spark: SparkSession, path: str, like: DataFrame, fmt: str | None = None) -> DataFrame:
    """A2: read a second table with the training types, minus columns it lacks (e.g. the label),
    in training order. Columns are matched by name, whatever their order in a CSV header."""
    kind = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    peek = read_table(spark, path, fmt=kind) if kind == "parquet" else spark.read.option("header", True).csv(path)
    missing = [c for c in peek.columns if c not in like.columns]
    if missing:
        raise ValueError(f"validation table has columns unknown to training: {missing}")
    fields = [f for f in like.schema.fields if f.name in peek.columns]
    if kind == "parquet":
        return read_table(spark, path, schema=StructType(fields), fmt=kind)
    # a CSV schema is positional: give it in the file's order, and have the header checked against it
    by_name = {f.name: f for f in fields}
    in_file = StructType([by_name[c] for c in peek.columns])
    df = spark.read.option("header", True).option("enforceSchema", False).schema(in_file).csv(path)
    return df.select(*[f.name for f in fields])


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A3: overwrite ``path``; CSV with a header and no index column."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def preview(df: DataFrame, order_by: Sequence[str | Column], n: int = 5) -> DataFrame:
    """A4: first ``n`` rows in a stated order (a distributed top-k, not a collect)."""
    return df.orderBy(*order_by).limit(n)


def write_predictions(scored: DataFrame, path: str, label_col: str = "Predictions", fmt: str = "csv") -> None:
    """A5: the scored rows with their label column, written as a table."""
    write_table(scored, path, fmt)


def write_profile(tables: dict[str, DataFrame], out_dir: str) -> list[str]:
    """One Parquet table per profile section under ``out_dir``."""
    paths = []
    for name, df in tables.items():
        p = f"{out_dir.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(p)
        paths.append(p)
    return paths


def save_model(model, path: str) -> str:
    """Persist a fitted ``PipelineModel`` (or any MLWritable model)."""
    model.write().overwrite().save(path)
    return path


def publish_model(spark: SparkSession, model, uri: str, name: str, metric: str | None = None,
                  value: float | None = None) -> DataFrame:
    """Save under ``uri/name/v=<n>`` and append one manifest row.

    The manifest is a Parquet table at ``uri/_manifest`` with
    (name, version, path, metric, value, published_at).
    """
    manifest_path = f"{uri.rstrip('/')}/_manifest"
    try:
        prior = spark.read.parquet(manifest_path).where(F.col("name") == name)
        version = (prior.agg(F.max("version")).first()[0] or 0) + 1
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        version = 1  # no manifest yet
    path = f"{uri.rstrip('/')}/{name}/v={version}-{uuid.uuid4().hex[:8]}"
    save_model(model, path)
    row = spark.createDataFrame(
        [(name, int(version), path, metric, None if value is None else float(value),
          _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))],
        "name string, version bigint, path string, metric string, value double, published_at timestamp_ntz")
    row.write.mode("append").parquet(manifest_path)
    return row


def load_model(path: str):
    """Load a model saved by :func:`save_model`."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def load_and_score(path: str, df: DataFrame) -> DataFrame:
    """Load a saved pipeline and score ``df``."""
    return load_model(path).transform(df)


def null_if(df: DataFrame, rules: dict[str, Sequence]) -> DataFrame:
    """A10: turn listed stand-in values (e.g. zeros for "not measured") into nulls."""
    out = []
    for c in df.columns:
        if c in rules:
            vals = list(rules[c])
            out.append(F.when(F.col(c).isin(vals), F.lit(None)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
