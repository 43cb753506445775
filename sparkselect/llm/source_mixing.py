"""Mixing sources to target weights by fitting subset sums.

Targets: every source gets its weight's share of all words, at most MAX_EPOCHS times its own
words; what is cut off is shared again by weight among the others until no target is above.

Documents: a source whose target holds its words q times takes each document q times. The
rest of the budget is fitted on the counts of documents by exact length: each length gives its
proportional share (rounded down) and long documents fill up; then some documents of every length are
given back, and a bounded-knapsack program over these and all that are left finds the subset sum nearest
below the budget. If it misses the budget, more documents are given back, until it is met or the program
holds all documents (or twice as many of each length as the longest length has words: two fillings of a budget
that differ in more documents share a part of equal sum). So the sum is the best that any choice reaches.
Only the number of documents per (source, length) is decided so; which ones are taken follows
from a seeded hash, numbered by many tasks.

Defined results: a null text has size 0; a document of size 0 is never taken beyond the whole
repeats; a null source is a source of its own, last in order; a source without words has
target 0; ties and repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkselect.functions.ranking import row_number_exact

from .common import frugal, ranked, written

#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 17
#: Words (over the lengths' common divisor) that the knapsack program fits at first; eight times as many each time it misses.
FIT_WORDS = 1 << 15


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(t.split()) if t else 0 for t in batch.column("text").to_pylist()]
        keep = [i for i, c in enumerate(batch.schema.names) if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(n, pa.int64())], names=[*[batch.schema.names[i] for i in keep], "size"])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, row_key (a hash of the row), size (words of the whole text)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64("doc_id", "source", "text").alias("row_key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(frugal(_word_counts), "doc_id long, source string, row_key long, size long")


def targets(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): one row per source of ``rows`` (source, size)."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.coalesce("source", F.lit(""))]
    numbered = row_number_exact(sums, order, name="rn")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = written(numbered.select("source", "source_size", weight.alias("w"), (F.lit(most) * F.col("source_size")).cast("double").alias("cap")), "sources")
    level = 0.0  # a source's target is level * weight, or its cap
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while True:
        above = F.col("cap") < F.lit(level) * F.col("w")
        s = table.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("capped"), F.sum(F.when(above, 0.0).otherwise(F.col("w"))).alias("free")).first()
        new = (total - (s["capped"] or 0.0)) / s["free"] if s["free"] else level
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def _knapsack(items: list[tuple[int, int, int]], budget: int) -> list[int]:
    """Of each (length, free, index) item how many to take for the largest sum up to ``budget``."""
    reach, first = np.zeros(budget + 1, bool), np.full(budget + 1, -1, np.int32)
    reach[0] = True
    parts: list[tuple[int, int, int]] = []  # (item, documents, words)
    for i, (length, free, _) in enumerate(items):
        free, step = min(free, budget // length), 1
        while free > 0 and not reach[budget]:
            k = min(step, free)
            words = length * k
            new = np.flatnonzero(reach[:budget + 1 - words] & ~reach[words:]) + words
            reach[new] = True
            first[new] = len(parts)
            parts.append((i, k, words))
            free -= k
            step *= 2
    taken = [0] * len(items)
    s = int(np.flatnonzero(reach)[-1])
    while s:  # a sum is first reached by a part from a sum that was reached before it
        i, k, words = parts[first[s]]
        taken[i] += k
        s -= words
    return taken


def fit_counts(counts: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many documents of each length to take for a sum of ``budget``, or the nearest below it that
    any choice reaches. ``counts``: (length > 0, documents)."""
    counts = sorted(counts)
    whole = sum(length * n for length, n in counts)
    if budget <= 0 or not whole:
        return {}
    if budget >= whole:
        return dict(counts)
    unit = math.gcd(*(length for length, _ in counts))
    lengths, free, goal = [length // unit for length, _ in counts], [n for _, n in counts], budget // unit
    take = [n * budget // whole for n in free]
    left = goal - sum(map(operator.mul, lengths, take))
    for i in reversed(range(len(lengths))):
        more = min(free[i] - take[i], left // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    window, spare, most = FIT_WORDS, 1, min(max(take), 2 * lengths[-1])
    while left:
        while spare < most and sum(length * min(t, spare) for length, t in zip(lengths, take, strict=True)) < window:
            spare *= 2
        kept, given = [], 0  # short documents are given back first, so that the mix of lengths hardly changes
        for length, t in zip(lengths, take, strict=True):
            kept.append(max(0, t - spare) if given < window else t)
            given += length * (t - kept[-1])
        rest = left + given
        items = [(length, n - k, i) for i, (length, n, k) in enumerate(zip(lengths, free, kept, strict=True))]
        got = _knapsack(items, rest)
        if sum(map(operator.mul, lengths, got)) == rest or given < window and spare >= most:
            take = [k + n for k, n in zip(kept, got, strict=True)]
            break
        window *= 8
    return {length * unit: n for length, n in zip(lengths, take, strict=True)}


def _fit(hist: pd.DataFrame) -> pd.DataFrame:
    size, target = int(hist["source_size"].iloc[0]), float(hist["target"].iloc[0])
    budget = min(round(target), MAX_EPOCHS * size)
    epochs = budget // size if size else 0
    take = fit_counts([(int(a), int(b)) for a, b in zip(hist["size"], hist["n"], strict=True) if a > 0], budget - epochs * size)
    return pd.DataFrame({"source": hist["source"], "size": hist["size"], "epochs": epochs, "take": [take.get(int(a), 0) for a in hist["size"]]})


def mix(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` (doc_id, source, row_key, size) plus source_size, target and copies."""
    rows = written(rows, "sized")
    goal = written(targets(rows), "targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    hist = counts.join(goal, same(counts, goal)).select(counts["source"], "size", "n", "source_size", "target")
    fitted = hist.groupBy("source").applyInPandas(_fit, "source string, size long, epochs long, take long")
    fitted = written(hist.alias("h").join(fitted.alias("f"), F.col("h.source").eqNullSafe(F.col("f.source")) & (F.col("h.size") == F.col("f.size")))
                     .select("h.source", "h.size", "h.source_size", "h.target", "f.epochs", "f.take"), "fitted")
    drawn = written(rows.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "row_key")), "drawn")
    numbered = ranked(drawn, ["source", "size"], ["draw", "doc_id", "row_key"])
    both = numbered.alias("l").join(fitted.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")) & (F.col("l.size") == F.col("r.size")))
    copies = F.col("r.epochs") + (F.col("l.rank") < F.col("r.take")).cast("long")
    return both.select("l.doc_id", "l.source", "l.row_key", "l.size", "r.source_size", "r.target", copies.alias("copies"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; equal rows share their copies."""
    key = F.xxhash64("doc_id", "source", "text")
    total = written(mix(sized(docs), seed).groupBy("row_key").agg(F.sum("copies").alias("_total"), F.count(F.lit(1)).alias("_rows")).withColumnRenamed("row_key", "_copy_key"), "mixed-copies")
    joined = docs.withColumn("_row_key", key).join(total, F.col("_row_key") == F.col("_copy_key"))

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)

    alone = repeated(joined.where("_rows = 1").withColumn("_copies", F.col("_total")))
    if total.where("_rows > 1").isEmpty():
        return alone
    # equal rows are numbered by an id, in pieces: they may be many
    same = written(joined.where("_rows > 1").select(*docs.columns, "_row_key", "_total", "_rows").withColumn("_id", F.monotonically_increasing_id()), "mixed-equal")
    numbered = ranked(same, ["_row_key"], ["_id"], "_nth")
    return alone.union(repeated(numbered.withColumn("_copies", F.floor(F.col("_total") / F.col("_rows")) + (F.col("_nth") < F.col("_total") % F.col("_rows")).cast("long"))))


def op9_frame(docs: DataFrame) -> DataFrame:
    return mix(sized(docs)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
