"""Helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType

INTS = (ByteType, ShortType, IntegerType, LongType)


def finish(df: DataFrame, digits: int = 6, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round floats and widen integers so results hash the same in any engine.

    ``overrides`` gives other digit counts per column (e.g. a mean whose exact value
    ends in a 5 at the seventh decimal, where engines round a half differently)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            d = (overrides or {}).get(f.name, digits)
            out.append(F.round(F.col(f.name).cast("double"), d).alias(f.name))
        elif isinstance(f.dataType, INTS):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def p1(col: str = "probability") -> F.Column:
    """Probability of label 1 from a probability vector."""
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col))[1]
