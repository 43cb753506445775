"""Pivot partitions for exact nearest neighbours: most block pairs are never formed.

A bounded sample of base rows (``MAX_PIVOTS`` at most, by key hash) serves as pivots and
every base row joins the cell of its nearest one. A cell keeps its least and greatest
distance to the pivot and the smallest of those distances. For a query, the k-th
smallest of d(query, pivot) + d(pivot, row) over all cells bounds its k-th neighbour from
above, and the triangle inequality bounds every row of a cell from below; the query goes
to the cells whose lower bound does not exceed that limit, and to no other. All distances
enter as intervals that hold their rounding error, so no neighbour (or tie) is lost;
where squares leave the range of a double there is no bound, and the cell is always met.

The pivots with their cells' few numbers are what is collected and broadcast. Cells of
more rows than a block are dealt to several, and so are the queries of a cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StructField, StructType

from sparkselect.session import materialize

#: Pivots at most; beyond MAX_PIVOTS * CELL_ROWS base rows the cells grow and are cut into blocks.
MAX_PIVOTS = 2_048
#: Queries measured against all pivots at a time.
CHUNK = 64


def pivots_of(base: DataFrame, rows: int, cell_rows: int) -> np.ndarray:
    """One pivot for about every ``cell_rows`` rows, by key hash, without repeats."""
    want = min(MAX_PIVOTS, max(1, math.ceil(rows / cell_rows)))
    order = F.xxhash64("bk", "x")
    found = base.select("x", order.alias("o")).orderBy("o").limit(want).collect()
    return np.unique(np.array([r["x"] for r in found], float), axis=0)


def _distances(X: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): bounds of the distances of rows to pivots, rounding included."""
    with np.errstate(all="ignore"):
        xn, pn = (X * X).sum(axis=1)[:, None], (pivots * pivots).sum(axis=1)[None, :]
        d = xn + pn - 2.0 * X @ pivots.T
        err = 32 * np.finfo(float).eps * max(1, X.shape[1]) * (xn + pn)
        grow = 8 * np.finfo(float).eps
        return np.sqrt(np.maximum(d - err, 0)) * (1 - grow), np.sqrt(np.maximum(d + err, 0)) * (1 + grow)


def _pair_distances(X: np.ndarray, P: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): bounds of the distance of each row to its own pivot, rounding included."""
    with np.errstate(all="ignore"):
        d = ((X - P) ** 2).sum(axis=1)
        scale = (X * X).sum(axis=1) + (P * P).sum(axis=1)
        err = 32 * np.finfo(float).eps * max(1, X.shape[1]) * scale
        err = np.where(np.isfinite(scale) & np.isfinite(d), err, np.nan)
        grow = 8 * np.finfo(float).eps
        return np.sqrt(np.maximum(d - err, 0)) * (1 - grow), np.sqrt(np.maximum(d + err, 0)) * (1 + grow)


def _stack(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(float)


def cells_of(base: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``base`` with the cell of each row and the bounds of its distance to the pivot."""
    with np.errstate(all="ignore"):
        twice, norms = np.ascontiguousarray(-2.0 * pivots.T), (pivots * pivots).sum(axis=1)[None, :]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            X = _stack(pdf["x"])
            cell, lo, hi = np.empty(len(X), np.int32), np.empty(len(X)), np.empty(len(X))
            for s in range(0, len(X), CHUNK):
                x = X[s:s + CHUNK]
                with np.errstate(all="ignore"):
                    far = x @ twice
                    far += norms
                # a pivot that rounding takes for the nearest does as well: its bounds are its own
                at = (np.where(np.isnan(far), np.inf, far) if np.isnan(far).any() else far).argmin(axis=1)
                low, high = _pair_distances(x, pivots[at])
                cell[s:s + CHUNK], lo[s:s + CHUNK], hi[s:s + CHUNK] = at, low, high
            yield pdf.assign(cell=cell, lo=lo, hi=hi)

    fields = [StructField("cell", IntegerType()), StructField("lo", DoubleType()), StructField("hi", DoubleType())]
    return base.mapInPandas(assign, StructType(base.schema.fields + fields))


def cell_table(cells: DataFrame, nearest: int) -> pd.DataFrame:
    """cell, n, lo, hi and the ``nearest`` smallest distances of each cell (a row a pivot at most)."""
    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            part = pdf.sort_values(["cell", "hi"], na_position="last").groupby("cell")
            agg = part.agg(n=("hi", "size"), lo=("lo", lambda v: v.min(skipna=False)), hi=("hi", lambda v: v.max(skipna=False)),
                           near=("hi", lambda v: list(v.iloc[:nearest]))).reset_index()
            held = agg if held is None else pd.concat([held, agg]).groupby("cell").agg(
                n=("n", "sum"), lo=("lo", lambda v: v.min(skipna=False)), hi=("hi", lambda v: v.max(skipna=False)),
                near=("near", lambda v: sorted((d for part in v for d in part), key=lambda d: (np.isnan(d), d))[:nearest])).reset_index()
        if held is not None:
            yield held

    per_task = cells.select("cell", "lo", "hi").mapInPandas(summary, "cell int, n long, lo double, hi double, near array<double>")
    unbounded = F.max(F.col("lo").isNull() | F.col("hi").isNull() | F.isnan("lo") | F.isnan("hi"))  # SQL minima pass over these
    total = per_task.groupBy("cell").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), unbounded.alias("free"),
        F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, nearest).alias("near")).toPandas()
    total.loc[total["free"], ["lo", "hi"]] = np.nan
    return total.sort_values("cell", ignore_index=True)


def probes_of(queries: DataFrame, pivots: np.ndarray, table: pd.DataFrame, nearest: int, key_type: DataType) -> DataFrame:
    """(qk, x, cell): each query with the cells that may hold one of its ``nearest`` neighbours."""
    ids = table["cell"].to_numpy()
    points = pivots[ids]
    lo, hi = table["lo"].to_numpy(float), table["hi"].to_numpy(float)
    near = np.full((len(ids), nearest), np.inf)
    for i, row in enumerate(table["near"]):
        near[i, :len(row)] = np.array(row, float)
    near = np.where(np.isnan(near), np.inf, near)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), CHUNK):
                part = pdf.iloc[s:s + CHUNK]
                low, high = _distances(_stack(part["x"]), points)
                limit = np.empty(len(part))
                for i in range(len(part)):
                    reach = (high[i][:, None] + near).ravel()
                    limit[i] = np.partition(reach, nearest - 1)[nearest - 1] if len(reach) >= nearest else np.inf
                with np.errstate(all="ignore"):
                    least = np.maximum(low - hi[None, :], lo[None, :] - high)
                    wanted = ~(least > limit[:, None] * (1 + 1e-12))  # NaN: no bound
                q, c = np.nonzero(wanted)
                yield pd.DataFrame({"qk": part["qk"].to_numpy()[q], "x": part["x"].to_numpy()[q], "cell": ids[c].astype(np.int32)})

    return queries.select("qk", "x").mapInPandas(probe, StructType([
        StructField("qk", key_type), queries.schema["x"], StructField("cell", IntegerType())]))


def pivot_blocks(queries: DataFrame, base: DataFrame, nearest: int, block_rows: int, rows: int) -> tuple[DataFrame, DataFrame, int]:
    """(queries, base, pairs): both with ``qb`` and ``bb``; rows meet where these are equal.

    ``queries`` holds qk, x, ``base`` holds bk, x and what else is wanted of it; ``rows`` is the
    number of base rows and ``pairs`` that of the (query, base row) pairs that will be measured.
    """
    pivots = pivots_of(base, rows, max(1, block_rows // 8))
    cells = materialize(cells_of(base, pivots))
    table = cell_table(cells, nearest)
    probes = materialize(probes_of(queries, pivots, table, nearest, queries.schema["qk"].dataType))
    asked = probes.groupBy("cell").agg(F.count(F.lit(1)).alias("nq")).toPandas()  # a row a cell at most
    plan = table[["cell", "n"]].merge(asked, "inner", "cell")
    pairs = int((plan["n"].astype(object) * plan["nq"].astype(object)).sum())
    plan["subs"] = -(-plan["n"] // block_rows)
    plan["qblocks"] = -(-plan["nq"] // block_rows)
    first = plan["subs"].cumsum() - plan["subs"]
    spark = base.sparkSession
    rows_of_plan = [tuple(map(int, r)) for r in zip(plan["cell"], first, plan["subs"], plan["qblocks"], strict=True)]
    facts = F.broadcast(spark.createDataFrame(rows_of_plan, "cell int, first long, subs long, qblocks long"))
    b = cells.join(facts, "cell").withColumn("bb", (F.col("first") + F.pmod(F.xxhash64("bk", "x"), F.col("subs"))).cast("int")) \
        .withColumn("qb", F.explode(F.sequence(F.lit(0), (F.col("qblocks") - 1).cast("int")))).drop("cell", "lo", "hi", "first", "subs", "qblocks")
    q = probes.join(facts, "cell").withColumn("qb", F.pmod(F.xxhash64("qk"), F.col("qblocks")).cast("int")) \
        .withColumn("bb", F.explode(F.sequence(F.col("first").cast("int"), (F.col("first") + F.col("subs") - 1).cast("int")))) \
        .drop("cell", "first", "subs", "qblocks")
    return q, b, pairs
