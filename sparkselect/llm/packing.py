"""Vector best-fit packing of token pieces into sequences.

A sequence (bin) has three capacities: tokens, documents and attention cost (the sum of
squared piece lengths). A piece's demand is a function of its length, so the packing is
planned on the histogram of lengths, which has at most as many rows as a sequence has
tokens, however many pieces there are. Lengths are placed in descending order; each piece
goes to a bin in which it fits under every constraint: the bin that is left with the
smallest weighted residual norm ("norm", best fit), or whose residual has the greatest
weighted dot product with the demand ("dot"). Equal bins are handled together, as ranges of
sequence numbers, so that the plan has a bounded number of rows; pieces of one length are
then numbered by many tasks and look up their place in the plan.

With "norm" the second piece of a length prefers the bin that has just received the first,
so a run of pieces fills bin after bin; this is what placing them one by one does.

Defined results: a null text counts as empty, and an empty document is its end id alone;
only a document longer than a sequence is cut; repeated rows are packed each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, ranked, text_groups, written
from .tokens import encoder, vocabulary

SEQUENCE_TOKENS = 4096
END_ID = 1
#: Text that is encoded at a time.
GROUP_BYTES = 2 << 20
#: Rows that a task of texts gets at a time.
BATCH_ROWS = 1_000
VOCABULARY = "word_bpe_49k.json"
#: The plan goes to the tasks whole up to so many rows of six longs, and is joined beyond.
PLAN_ROWS = 500_000


@dataclass(frozen=True)
class Capacities:
    """What a sequence holds. The defaults for documents and attention follow from the tokens."""

    tokens: int = SEQUENCE_TOKENS
    documents: int = SEQUENCE_TOKENS
    attention: int = SEQUENCE_TOKENS * SEQUENCE_TOKENS
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)

    def demand(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], np.int64)

    def total(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)


def plan(histogram: list[tuple[int, int]], caps: Capacities | None = None, rule: str = "norm") -> tuple[np.ndarray, int]:
    """(rows, bins) for (length, count) pairs.

    A row (length, lo, hi, bin, each, offset) places the pieces of this length with ranks
    lo <= r < hi: ``each`` per bin, in bins from ``bin`` on, from token ``offset`` on.
    """
    caps = caps or Capacities()
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule {rule!r}: norm or dot")
    whole = caps.total()
    weights = np.array(caps.weights) / whole.astype(float) ** 2
    residual, first, count = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    rows, bins = [], 0
    for length, n in sorted(histogram, reverse=True):
        need = caps.demand(length)
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        lo, grown = 0, []  # grown: groups made for this length, (residual, first, count)
        while lo < n:
            open_ = np.flatnonzero((residual >= need).all(axis=1) & (count > 0))
            if len(open_):
                left = (residual[open_] - need).astype(float)
                score = (left ** 2 * weights).sum(axis=1) if rule == "norm" else -(residual[open_] * need * weights).sum(axis=1)
                g = open_[np.argmin(score)]
                room, at, many = residual[g].copy(), first[g], count[g]
            else:
                g, room, at, many = None, whole.copy(), bins, n - lo
            each = int((room // need).min()) if rule == "norm" or g is None else 1
            fill = min(many, (n - lo) // each)
            parts = []
            if fill:
                parts.append((fill, each))
            if fill < many and (n - lo) % each and fill == (n - lo) // each:
                parts.append((1, (n - lo) % each))
            used = 0
            for bins_here, k in parts:
                hi = lo + bins_here * k
                rows.append((length, lo, hi, at + used, k, caps.tokens - room[0]))
                grown.append((room - k * need, at + used, bins_here))
                lo, used = hi, used + bins_here
            if g is None:
                bins += used
            else:
                first[g] += used
                count[g] -= used
            if rule == "dot" and grown:  # its pieces may go on into these bins
                residual, first, count = _with(residual, first, count, grown)
                grown = []
        residual, first, count = _with(residual, first, count, grown)
    return np.array(rows, np.int64).reshape(-1, 6), bins


def _with(residual, first, count, grown):
    if not grown:
        return residual, first, count
    live = count > 0
    return (np.concatenate((residual[live], np.array([g[0] for g in grown]))),
            np.concatenate((first[live], np.array([g[1] for g in grown], np.int64))),
            np.concatenate((count[live], np.array([g[2] for g in grown], np.int64))))


def _pieces(path: str, end_id: int, size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        encode = encoder(path, True).encode
        for table in text_groups(batches, 1, GROUP_BYTES):
            docs, pieces, starts, lengths, crcs = [], [], [], [], []
            flat, at = encode(table.column(1))
            for i in range(len(table)):
                ids = np.concatenate((flat[at[i]:at[i + 1]], end)).astype("<u4")
                for piece, s in enumerate(range(0, len(ids), size)):
                    own = ids[s:s + size]
                    docs.append(i)
                    pieces.append(piece)
                    starts.append(s)
                    lengths.append(len(own))
                    crcs.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [table.column(0).combine_chunks().take(pa.array(docs, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, name: str = VOCABULARY, end_id: int = END_ID, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids, cut at ``size``."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(frugal(_pieces(vocabulary(name), end_id, size)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _placer(rows: np.ndarray):
    """Look up (length, rank) in the plan, whose rows are sorted by (length, lo)."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))] if len(rows) else np.zeros((1, 6), np.int64)
    lengths = np.unique(rows[:, 0])
    group_at = np.searchsorted(rows[:, 0], lengths)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for s, e in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                own = order[s:e]
                i = np.searchsorted(lengths, length[own[0]])
                end = group_at[i + 1] if i + 1 < len(lengths) else len(rows)
                at[own] = group_at[i] + np.searchsorted(rows[group_at[i]:end, 1], rank[own], "right") - 1
            got = rows[at]
            step = rank - got[:, 1]
            out = [batch.column(c) for c in batch.schema.names if c != "rank"]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(got[:, 3] + step // got[:, 4]), pa.array(got[:, 5] + step % got[:, 4] * length)], names=[*names, "sequence_id", "offset"])

    return place


def pack(items: DataFrame, caps: Capacities | None = None, rule: str = "norm") -> DataFrame:
    """``items`` (doc_id, piece, start, length, ids_crc32) plus sequence_id and offset."""
    spark = items.sparkSession
    items = written(items, "pieces", BATCH_ROWS)
    histogram = [(r["length"], r["n"]) for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()]
    rows, _ = plan(histogram, caps, rule)
    numbered = ranked(items, ["length"], ["doc_id", "piece", "ids_crc32"])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    if len(rows) <= PLAN_ROWS:
        return numbered.mapInArrow(frugal(_placer(rows)), schema)
    table = spark.createDataFrame(pa.table([pa.array(rows[:, i]) for i in range(6)], names=["p_length", "lo", "hi", "bin", "each", "at"]))
    fits = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    step = F.col("rank") - F.col("lo")
    return numbered.join(table, fits).select(*items.columns, (F.col("bin") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
                                             (F.col("at") + step % F.col("each") * F.col("length")).cast("long").alias("offset"))


def op3_frame(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs))
