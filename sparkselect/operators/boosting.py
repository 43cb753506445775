"""F7 for several classes and F8: gradient boosting on binned features.

Features are cut into bins once. A pass over the rows adds gradients, curvatures and weights
per (tree node, feature, bin); partial histograms are added by Spark, and only the smaller child of a split
is counted, as the larger is its parent less its sibling. All trees of a round, one a class, grow in the same passes.
Nodes at ``maxDepth`` are not counted. With more than ``DENSE_BINS`` bins the sums of a node and feature meet in one
group, which finds the best split there: only splits reach the driver.

``growth="leaf"`` (F8) splits the leaf with the largest gain first until ``numLeaves``. A pass counts the
children of all leaves that may still be split, so a tree takes about as many passes as it is deep, and the best-first
order is followed exactly afterwards. ``growth="depth"`` (F7) splits all nodes down to ``maxDepth``.

F8 samples rows by gradient from round 1 / stepSize on: the ``topRate`` share with the largest gradients stays,
of the others a share ``otherRate`` of all rows is picked by a hash of the row and the round and counts
(1 - topRate) / otherRate times.

``everyCut`` makes every value of a feature a cut point, however many there are. Features of more than ``COARSE_BINS``
values are counted in coarse bins first. The gain of a cut inside a bin is bounded by the bin's sums (the gain is convex in
the left sums), so the values of the few bins whose bound reaches the best gain known are then counted one by one.

Rows live in a written table, ``BLOCK_ROWS`` in a record (bins or values, label, weight, scores), in as many partitions as
keep the cores busy; the scores are written again after every round, and so is a round's sample, so lost executors lose no round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkselect.operators.estimators import CustomEstimator, CustomModel, label_classes, with_scores
from sparkselect.operators.persist import CompositePersistence
from sparkselect.operators.trees import Tree
from sparkselect.session import stored, tasks

#: Cells (row x feature) up to which the rows are numbered without gaps.
PARTITION_CELLS = 8_000_000
#: Rows, and cells, of a partition of the row table that make another partition worth its sums.
PART_ROWS, PART_CELLS = 50_000, 1_000_000
#: Most bins of a feature whose sums the driver holds; beyond, splits are found where the sums are.
DENSE_BINS = 1024
#: Rows that a task holds at a time when it sums over more bins than that.
WIDE_ROWS = 131_072
#: Rows of a record of the row table.
BLOCK_ROWS = 10_000
#: Coarse bins of a feature all of whose values are cut points, and such bins of a node and feature counted in one group.
COARSE_BINS, GROUP_BINS = 255, 16
#: Numbers of all tasks' histograms up to which they are added on the driver, not by another stage.
DRIVER_CELLS = 4_000_000
#: Numbers of all histograms that the driver holds at most.
MAX_CELLS = 100_000_000
#: Classes of gradient sizes that the sampling threshold is read from.
SIZES = 4096


def feature_cuts(rows: DataFrame, p: int, bins: int, accuracy: int = 1_000_000) -> list[np.ndarray]:
    """Cut points of each of ``p`` features (array column x): all values but the largest if there are at
    most ``bins``, else quantiles of a sketch. A value is in bin i if i cuts lie below it; NaN is in the last."""
    return _cuts(rows, p, bins, accuracy)[0]


def _cuts(rows: DataFrame, p: int, bins: int, accuracy: int) -> tuple[list[np.ndarray], dict[int, float]]:
    """``feature_cuts``, and the largest value of each feature cut at quantiles."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list = [np.empty(0)] * p
        for batch in batches:
            x = _matrix(batch.column(0), p)
            for i in range(p):
                if known[i] is not None:
                    seen = np.unique(np.append(known[i], x[:, i][~np.isnan(x[:, i])]))
                    known[i] = seen if len(seen) <= bins else None
        i = np.concatenate([np.full(1 if k is None else len(k), j) for j, k in enumerate(known)])
        v = np.concatenate([np.full(1, np.nan) if k is None else k for k in known])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(v, pa.float64())], names=["i", "v"])

    found = stored(rows.select("x").mapInArrow(values, "i long, v double").distinct(), "boosting-values")
    counts = found.frame.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.max(F.isnan("v")).alias("many")).collect()
    small = [r["i"] for r in counts if not r["many"] and r["n"] <= bins]
    few: dict[int, np.ndarray] = {}
    got = found.frame.where(F.col("i").isin(small)).toArrow()  # at most ``bins`` values a feature
    at, value = got.column("i").to_numpy(), got.column("v").to_numpy()
    few.update({i: np.sort(value[at == i]) for i in small})
    found.drop()
    wide, tops = [i for i in range(p) if i not in few], {}
    if wide:
        at = [j / bins for j in range(1, bins)]
        known = lambda i: F.when(~F.isnan(F.col("x")[i]), F.col("x")[i])
        sketch = rows.agg(*[F.percentile_approx(known(i), at, accuracy).alias(f"q{i}") for i in wide], *[F.max(known(i)).alias(f"m{i}") for i in wide]).first()
        tops = {i: sketch[f"m{i}"] for i in wide if sketch[f"q{i}"]}
        few.update({i: np.append(np.unique(sketch[f"q{i}"]), np.inf) if sketch[f"q{i}"] else np.empty(0) for i in wide})
    return [few[i][:-1] for i in range(p)], tops


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)


def _each_row(a: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    ends = np.arange(len(a) + 1, dtype=np.int32) * (a.itemsize * a.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(a))])


def _joined(column: pa.Array, kind) -> np.ndarray:
    """The numbers of all rows of such a column, one after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], kind, (ends[-1] - ends[0]) // np.dtype(kind).itemsize, ends[0])


def _record(**arrays: np.ndarray) -> pa.RecordBatch:
    """One record of the row table: the bytes of each array."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays.values()], names=list(arrays))


def _records(batches: Iterator[pa.RecordBatch], **kinds) -> Iterator[list[np.ndarray]]:
    """The arrays of each record."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in kinds.items()]


class _Growing:
    """One tree while it grows: nodes with their statistics, best splits and children."""

    def __init__(self, cut_kind=np.int32):
        self.cut_kind = cut_kind
        self.feature, self.cut, self.left, self.right = [-1], [0], [0], [0]
        self.split: list = [None]  # (gain, feature, cut, left statistics, right statistics)
        self.stats: list = [None]
        self.hist: list = [None]
        self.depth = [0]

    def arrays(self) -> tuple:
        return tuple(np.array(a, kind) for a, kind in ((self.feature, np.int32), (self.cut, self.cut_kind), (self.left, np.int32), (self.right, np.int32)))

    def expand(self, node: int) -> tuple[int, int]:
        """Give ``node`` its children; (smaller, larger) child by weight."""
        _, f, c, own, other = self.split[node]
        self.feature[node], self.cut[node] = f, c
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for stats in (own, other):
            for column, v in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.split, None), (self.stats, stats), (self.hist, None)):
                column.append(v)
            self.depth.append(self.depth[node] + 1)
        pair = (self.left[node], self.right[node])
        return pair if own[2] <= other[2] else pair[::-1]


def _route(bins: np.ndarray, tree: tuple) -> np.ndarray:
    feature, cut, left, right = tree
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return at
        at = np.where(inner, np.where(bins[rows, np.maximum(feature[at], 0)] <= cut[at], left[at], right[at]), at)


def _gradients(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature, rows x trees of a round."""
    if score.shape[1] == 1:
        p = 1 / (1 + np.exp(-score))
        target = y[:, None] == 1
    else:
        e = np.exp(score - score.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        target = y[:, None] == np.arange(score.shape[1])
    return w[:, None] * (target - p), w[:, None] * p * (1 - p)


def _unit(ids: np.ndarray, salt: int) -> np.ndarray:
    """Hash of a row id and a salt, uniform in [0, 1)."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(31))) / 2.0 ** 64


def best_split(hist: np.ndarray, n_cuts: np.ndarray, ridge: float, least: float, newton: bool):
    """Best split of a node: (gain, feature, cut, left sums, right sums) or None; ties to the first feature and cut."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist[0].sum(axis=1)
    right = total[None, :, None] - left
    over = (lambda s: s[:, 1] + ridge) if newton else (lambda s: s[:, 2])
    whole = total[0] ** 2 / (total[1] + ridge if newton else total[2])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[:, 0] ** 2 / over(left) + right[:, 0] ** 2 / over(right) - whole
    ok = (left[:, 2] >= least) & (right[:, 2] >= least) & (np.minimum(left[:, 1], right[:, 1]) > 1e-10) & (np.arange(left.shape[2]) < n_cuts[:, None])
    gain = np.where(ok, np.round(gain, 9), -np.inf)
    if not gain.size:
        return None
    at = int(np.argmax(gain))
    f, c = divmod(at, gain.shape[1])
    if not gain[f, c] > 1e-9:
        return None
    return float(gain[f, c]), f, c, left[f, :3, c], right[f, :3, c]


def _gain(left: np.ndarray, total: np.ndarray, ridge: float, newton: bool) -> np.ndarray:
    """Gain of cuts with these sums (gradient, curvature, weight; x cuts) to the left."""
    at = 1 if newton else 2
    add = ridge if newton else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        return left[0] ** 2 / (left[at] + add) + (total[0] - left[0]) ** 2 / (total[at] - left[at] + add) - total[0] ** 2 / (total[at] + add)


def _allowed(left: np.ndarray, total: np.ndarray, least: float) -> np.ndarray:
    return (left[2] >= least) & (total[2] - left[2] >= least) & (np.minimum(left[1], total[1] - left[1]) > 1e-10)


def gain_bounds(hist: np.ndarray, ridge: float, least: float, newton: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sums before each bin, features x 3 x bins; the most that a cut inside or at the end of each bin can gain), of
    histograms with gradient, curvature, weight and positive gradient. Gains are convex in the left sums, so
    they are greatest at a corner of the sums that a part of the bin can have."""
    before = np.cumsum(hist[:, :3], axis=2) - hist[:, :3]
    total = hist[0, :3].sum(axis=1)
    g0, d0, n0 = before[:, 0], before[:, 1], before[:, 2]
    up = np.maximum(hist[:, 3], 0)
    down = np.maximum(hist[:, 3] - hist[:, 0], 0)
    low, high = np.maximum(n0, least), np.minimum(n0 + hist[:, 2], total[2] - least)
    corners = []
    if newton:
        corners += [np.stack([g0 + side, d, n0]) for side in (up, -down) for d in (d0, d0 + hist[:, 1])]
    else:  # a row's gradient is no larger than its weight
        for n in (low, high, np.clip(n0 + up, low, np.maximum(low, high)), np.clip(n0 + down, low, np.maximum(low, high))):
            part = np.maximum(n - n0, 0)
            corners += [np.stack([g0 + side, d0, n]) for side in (np.minimum(up, part), -np.minimum(down, part))]
    top = np.max([np.nan_to_num(_gain(left, total, ridge, newton), nan=np.inf, posinf=np.inf) for left in corners], axis=0)
    return before, np.where((hist[:, 2] > 0) & (low <= high * (1 + 1e-9)), top * (1 + 1e-9) + 1e-8, -np.inf)


class _Coarse:
    """Coarse bins of features all of whose values are cut points: those of ``wide`` features hold several values."""

    def __init__(self, cuts: list[np.ndarray], tops: dict[int, float]):
        self.cuts = [c[c < tops[i]] if i in tops else c for i, c in enumerate(cuts)]
        self.n_cuts, self.tops = np.array([len(c) for c in self.cuts]), tops
        self.wide = np.array([i in tops for i in range(len(cuts))], bool)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(self.cuts)])


class _Rows:
    """The written row table, the trees since its scores were written, and the sample of a round."""

    def __init__(self, table, p: int, k: int, kind, coarse: _Coarse | None = None, parts: int = 1):
        self.table, self.p, self.k, self.kind, self.coarse, self.parts = table, p, k, kind, coarse, parts
        self.recent: list[tuple[int, tuple, np.ndarray]] = []  # (class, tree, leaf values)
        self.sampled = None

    def _reader(self):
        """id, bins (values if all are cut points), scores, classes and weights of each record."""
        p, k, kind, recent = self.p, self.k, self.kind, list(self.recent)

        def read(batches: Iterator[pa.RecordBatch]):
            for ids, bins, score, y, w in _records(batches, id=np.int64, bins=kind, score=np.float64, y=np.int32, w=np.float64):
                bins, score = bins.reshape(-1, p), score.reshape(-1, k).copy()
                for c, tree, value in recent:
                    score[:, c] += value[_route(bins, tree)]
                yield ids, bins, score, y, w

        return read

    def _counted(self):
        """The rows a round counts and a reader of them: bins, gradients, curvatures, weights."""
        read = self._reader()

        def whole(batches: Iterator[pa.RecordBatch]):
            for _, bins, score, y, w in read(batches):
                yield bins, *_gradients(score, y, w), w

        if self.sampled is None:
            return self.table, whole
        p, k, kind = self.p, self.k, self.kind

        def drawn(batches: Iterator[pa.RecordBatch]):
            for bins, g, h, w in _records(batches, bins=kind, g=np.float64, h=np.float64, w=np.float64):
                yield bins.reshape(-1, p), g.reshape(-1, k), h.reshape(-1, k), w

        return self.sampled, drawn

    def draw(self, sample) -> None:
        """Write the rows of a round's sample with their gradients, curvatures and weights."""
        read = self._reader()
        least, share, factor, salt, sizes = sample

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, bins, score, y, w in read(batches):
                g, h = _gradients(score, y, w)
                small = _sizes(g, sizes) < least
                keep = ~small | (_unit(ids, salt) < share)
                f = np.where(small, factor, 1.0)[keep]
                if len(f):
                    yield _record(bins=bins[keep], g=g[keep] * f[:, None], h=h[keep] * f[:, None], w=w[keep] * f)

        self.sampled = stored(self.table.frame.mapInArrow(pick, "bins binary, g binary, h binary, w binary"), "boosting-sample", one=self.table.one)

    def histograms(self, trees: dict[int, tuple], wanted: dict[int, list[int]], bins_of: int) -> dict[tuple[int, int], np.ndarray]:
        """(class, node) -> sums of gradient, curvature and weight per feature and bin, of the rows in that node;
        with the positive gradients if the bins are coarse."""
        (table, read), p, coarse = self._counted(), self.p, self.coarse
        slots, kinds = [(c, node) for c, nodes in wanted.items() for node in nodes], 3 + (coarse is not None)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(slots), p, kinds, bins_of))
            for bins, g, h, w in read(batches):
                first, code = 0, bins if coarse is None else coarse.codes(bins)
                for c, nodes in wanted.items():
                    own, rows = _members(bins, trees[c], nodes)
                    base, size = own * bins_of, len(nodes) * bins_of
                    sums = [g[rows, c], h[rows, c], w[rows]]
                    if coarse is not None:
                        sums.append(np.maximum(sums[0], 0))
                    for f in range(p):
                        cell = base + code[rows, f]
                        for s, values in enumerate(sums):
                            total[first:first + len(nodes), f, s] += np.bincount(cell, values, size).reshape(len(nodes), bins_of)
                    first += len(nodes)
            i, f = np.divmod(np.arange(len(slots) * p), p)
            ends = np.arange(len(i) + 1, dtype=np.int32) * kinds * bins_of
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(f, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel()))], names=["slot", "f", "s"])

        parts = table.frame.mapInArrow(count, "slot int, f int, s array<double>")
        out = np.zeros((len(slots), p, kinds, bins_of))
        if not table.one and self.parts * out.size > DRIVER_CELLS:
            parts = parts.groupBy("slot", "f").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
        for batch in parts.toArrow().to_batches():
            slot, f = (batch.column(c).to_numpy() for c in ("slot", "f"))
            np.add.at(out, (slot, f), batch.column("s").flatten().to_numpy(zero_copy_only=False).reshape(-1, kinds, bins_of))
        return {slot: out[i] for i, slot in enumerate(slots)}

    def refined(self, trees: dict[int, tuple], hists: dict[tuple[int, int], np.ndarray], rule: tuple) -> dict[tuple[int, int], tuple | None]:
        """(class, node) -> best split over all values, of nodes with coarse histograms; the cut is a value. The values
        of bins whose bound reaches the best gain at the bins' ends are counted one by one."""
        (table, read), p, coarse = self._counted(), self.p, self.coarse
        ridge, least, newton = rule
        slots, single = list(hists), ~coarse.wide
        found: dict[int, list] = {i: [] for i in range(len(slots))}  # (gain, feature, value, left sums) by slot
        groups: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}  # (slot, feature, group) -> bins, sums before them
        totals, asked = [], {}
        for i, slot in enumerate(slots):
            hist = hists[slot]
            total = hist[0, :3].sum(axis=1)
            totals.append(total)
            before, bound = gain_bounds(hist, *rule)
            ends = (before + hist[:, :3]).transpose(1, 0, 2)
            cut = np.arange(hist.shape[2]) < coarse.n_cuts[:, None]
            gain = np.where(cut & _allowed(ends, total, least), np.round(_gain(ends, total, ridge, newton), 9), -np.inf)
            best = max(gain.max(initial=-np.inf), 1e-9)
            for f, b in zip(*np.nonzero((gain == best) & single[:, None] & (hist[:, 2] > 0) & (gain > 1e-9))):
                found[i].append((float(gain[f, b]), int(f), float(coarse.cuts[f][b]), ends[:, f, b]))
            for f in np.flatnonzero(coarse.wide):
                open_ = np.flatnonzero(bound[f] >= best - 1e-8)
                for j in range(0, len(open_), GROUP_BINS):
                    groups[i, int(f), j // GROUP_BINS] = open_[j:j + GROUP_BINS], before[f][:, open_[j:j + GROUP_BINS]]
                if len(open_):
                    lookup = np.full(hist.shape[2], -1)
                    lookup[open_] = np.arange(len(open_)) // GROUP_BINS
                    asked.setdefault(slot[0], {}).setdefault(slot[1], []).append((i, int(f), lookup))
        if groups:
            tops = coarse.tops

            def sums(held: list) -> Iterator[pa.RecordBatch]:
                bins, g, h, w = (np.concatenate(a) for a in zip(*held))
                code, out = coarse.codes(bins), []
                for c, nodes in asked.items():
                    own, rows = _members(bins, trees[c], list(nodes))
                    for at, node in enumerate(nodes):
                        inside = rows[own == at]
                        for i, f, lookup in nodes[node]:
                            group = lookup[code[inside, f]]
                            here = inside[group >= 0]
                            group = group[group >= 0]
                            for j in np.unique(group):
                                r = here[group == j]
                                value, place = np.unique(bins[r, f], return_inverse=True)
                                s = np.stack([np.bincount(place, v[r], len(value)) for v in (g[:, c], h[:, c], w)], axis=1)
                                out.append((i, f, int(j), value.tobytes(), s.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["slot", "f", "part", "v", "s"])

            def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                held: list = []
                for record in read(batches):
                    held.append(record)
                    if sum(len(b[0]) for b in held) >= WIDE_ROWS:
                        yield from sums(held)
                        held = []
                if held:
                    yield from sums(held)

            def choose(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
                i, f, j = map(int, key)
                own, base = groups[i, f, j]
                v, s = np.frombuffer(b"".join(part["v"])), np.frombuffer(b"".join(part["s"])).reshape(-1, 3)
                value, place = np.unique(v, return_inverse=True)
                s = np.stack([np.bincount(place, s[:, m], len(value)) for m in range(3)])
                at = np.searchsorted(own, np.searchsorted(coarse.cuts[f], value, "left"))
                start = np.flatnonzero(np.diff(at, prepend=-1))
                run = np.cumsum(s, axis=1)
                left = base[:, at] + run - (run - s)[:, np.repeat(start, np.diff(np.append(start, len(at))))]
                ok = _allowed(left, totals[i], least) & (value < tops[f])
                gain = np.where(ok, np.round(_gain(left, totals[i], ridge, newton), 9), -np.inf)
                k = int(np.argmax(gain))
                best = pd.DataFrame({"slot": [i], "f": [f], "gain": [gain[k]], "v": [value[k]], "left": [left[:, k].tolist()]})
                return best if gain[k] > 1e-9 else best.iloc[:0]

            parts = table.frame.mapInArrow(count, "slot int, f int, part int, v binary, s binary")
            for r in parts.groupBy("slot", "f", "part").applyInPandas(choose, "slot int, f int, gain double, v double, left array<double>").collect():
                found[r["slot"]].append((r["gain"], r["f"], r["v"], np.array(r["left"])))
        out: dict = {}
        for i, slot in enumerate(slots):
            best = min(found[i], key=lambda x: (-x[0], x[1], x[2]), default=None)
            out[slot] = best and (best[0], best[1], best[2], best[3], totals[i] - best[3])
        return out

    def splits(self, trees: dict[int, tuple], wanted: dict[int, list[int]], bins_of: int, n_cuts: np.ndarray, rule: tuple) -> dict[tuple[int, int], tuple]:
        """(class, node) -> (sums of the node, best split), found in one group per node and feature."""
        (table, read), p = self._counted(), self.p
        slots = [(c, node) for c, nodes in wanted.items() for node in nodes]

        def sums(held: list) -> Iterator[pa.RecordBatch]:
            bins, g, h, w = (np.concatenate(a) for a in zip(*held))
            first = 0
            for c, nodes in wanted.items():
                own, rows = _members(bins, trees[c], nodes)
                base, size = own * bins_of, len(nodes) * bins_of
                for f in range(p) if len(rows) else ():
                    cell = base + bins[rows, f]
                    at = np.flatnonzero(np.bincount(cell, minlength=size))
                    s = np.stack([np.bincount(cell, values, size)[at] for values in (g[rows, c], h[rows, c], w[rows])], axis=1)
                    ends = np.searchsorted(at, np.arange(len(nodes) + 1) * bins_of)
                    some = np.flatnonzero(np.diff(ends))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(first + some, pa.int32()), pa.array(np.full(len(some), f), pa.int32()),
                         pa.array([(at[ends[i]:ends[i + 1]] - i * bins_of).astype(np.int32).tobytes() for i in some], pa.binary()),
                         pa.array([s[ends[i]:ends[i + 1]].tobytes() for i in some], pa.binary())], names=["slot", "f", "at", "s"])
                first += len(nodes)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list = []
            for record in read(batches):
                held.append(record)
                if sum(len(b[0]) for b in held) >= WIDE_ROWS:
                    yield from sums(held)
                    held = []
            if held:
                yield from sums(held)

        def choose(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            hist = np.zeros((1, 3, bins_of))
            for at, s in zip(part["at"], part["s"], strict=True):
                hist[0][:, np.frombuffer(at, np.int32)] += np.frombuffer(s, np.float64).reshape(-1, 3).T
            found = best_split(hist, n_cuts[key[1]:key[1] + 1], *rule)
            gain, _, cut, left, right = found or (None, 0, 0, np.zeros(3), np.zeros(3))
            return pd.DataFrame({"slot": [key[0]], "f": [key[1]], "gain": pd.array([gain], "Float64"), "cut": [cut], "sums": [[*hist[0].sum(axis=1), *left, *right]]})

        parts = table.frame.mapInArrow(count, "slot int, f int, at binary, s binary")
        got = parts.groupBy("slot", "f").applyInPandas(choose, "slot int, f int, gain double, cut int, sums array<double>").collect()
        out: dict = {slot: (np.zeros(3), None) for slot in slots}
        for r in sorted(got, key=lambda r: (r["slot"], r["f"])):
            slot, s = slots[r["slot"]], np.array(r["sums"]).reshape(3, 3)
            best = out[slot][1]
            if r["gain"] is not None and (best is None or r["gain"] > best[0]):
                best = (r["gain"], r["f"], r["cut"], s[1], s[2])
            out[slot] = (s[0] if r["f"] == 0 else out[slot][0], best)
        return out

    def size_counts(self, sizes: float) -> np.ndarray:
        """How many rows have each class of gradient size."""
        read = self._reader()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(SIZES, np.int64)
            for _, _, score, y, w in read(batches):
                total += np.bincount(_sizes(_gradients(score, y, w)[0], sizes), minlength=SIZES)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["size", "n"])

        out = np.zeros(SIZES, np.int64)
        for r in self.table.frame.mapInArrow(count, "size int, n long").groupBy("size").agg(F.sum("n").alias("n")).collect():
            out[r["size"]] = r["n"]
        return out

    def save(self) -> None:
        """Write the scores with the trees since the last writing added, and end the round's sample."""
        if self.sampled is not None:
            self.sampled.drop()
            self.sampled = None
        read = self._reader()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, bins, score, y, w in read(batches):
                yield _record(id=ids, bins=bins, y=y, w=w, score=score)

        old = self.table
        self.table = stored(old.frame.mapInArrow(add, old.frame.schema), "boosting-rows", one=old.one)
        old.drop()
        self.recent = []


def _members(bins: np.ndarray, tree: tuple, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``nodes`` of the rows that lie in one of them, and the rows."""
    slot = np.full(len(tree[0]), -1)
    slot[nodes] = np.arange(len(nodes))
    own = slot[_route(bins, tree)]
    rows = np.flatnonzero(own >= 0)
    return own[rows], rows


def _sizes(g: np.ndarray, most: float) -> np.ndarray:
    return np.minimum((np.abs(g).sum(axis=1) / most * SIZES).astype(np.int64), SIZES - 1)


class _Boosting(CustomEstimator):
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "deepest node; 0: no limit", TypeConverters.toInt)
    numLeaves = Param(Params._dummy(), "numLeaves", "leaves of a tree (growth by leaf)", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "shrinkage", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    minRows = Param(Params._dummy(), "minRows", "least weight of a leaf", TypeConverters.toFloat)
    ridge = Param(Params._dummy(), "ridge", "added to the curvature of a leaf", TypeConverters.toFloat)
    topRate = Param(Params._dummy(), "topRate", "share of the rows with the largest gradients that all stay", TypeConverters.toFloat)
    everyCut = Param(Params._dummy(), "everyCut", "every value is a cut point, whatever maxBins is", TypeConverters.toBoolean)
    otherRate = Param(Params._dummy(), "otherRate", "share of the other rows; 0: no sampling", TypeConverters.toFloat)

    growth, newton = "leaf", True
    _defaults: dict = {}

    def __init__(self, **kw):
        super().__init__(**kw)
        self._setDefault(**self._defaults)
        self._set(**{k: v for k, v in kw.items() if v is not None and k in self._defaults})

    def _round(self, rows: _Rows, n_cuts: np.ndarray, bins_of: int) -> list[_Growing]:
        """The trees of one round, one a class, grown in the same passes."""
        exact = rows.coarse is not None
        trees = {c: _Growing(np.float64 if exact else np.int32) for c in range(rows.k)}
        deepest, dense = self.getOrDefault(self.maxDepth) or 1 << 30, exact or bins_of <= DENSE_BINS
        rule = (self.getOrDefault(self.ridge), self.getOrDefault(self.minRows), self.newton)

        def count(wanted: dict) -> dict:
            """(class, node) -> histogram if the driver holds it, else (sums of gradient, curvature and weight, best split)."""
            arrays = {c: trees[c].arrays() for c in wanted}
            return rows.histograms(arrays, wanted, bins_of) if dense else rows.splits(arrays, wanted, bins_of, n_cuts, rule)

        def split(nodes: list[tuple[int, int]]) -> None:
            """Best splits of nodes whose histograms the driver holds."""
            if exact:
                best = rows.refined({c: trees[c].arrays() for c, _ in nodes}, {(c, n): trees[c].hist[n] for c, n in nodes}, rule)
            for c, n in nodes:
                trees[c].split[n] = best[c, n] if exact else best_split(trees[c].hist[n], n_cuts, *rule)

        got = count({c: [0] for c in trees})
        for c, t in trees.items():
            if dense:
                t.hist[0], t.stats[0] = got[c, 0], got[c, 0][0, :3].sum(axis=1)
            else:
                t.stats[0], t.split[0] = got[c, 0]
        if dense:
            split([(c, 0) for c in trees])
        while True:
            wanted, larger, grown = {}, [], False
            for c, t in trees.items():
                for node in self._chosen(t)[1]:
                    small, large = t.expand(node)
                    grown = True
                    if t.depth[small] >= deepest:  # leaves: their sums are known from the split
                        t.hist[node] = None
                        continue
                    wanted.setdefault(c, []).extend([small] if dense else [small, large])
                    larger.append((c, node, small, large))
            if not grown:
                return [trees[c] for c in range(rows.k)]
            if not wanted:
                continue
            got = count(wanted)
            for c, node, small, large in larger:
                t = trees[c]
                if dense:
                    t.hist[small], t.hist[large] = got[c, small], t.hist[node] - got[c, small]
                    t.hist[node] = None
                else:
                    t.split[small], t.split[large] = got[c, small][1], got[c, large][1]
            if dense:
                split([(c, n) for c, _, small, large in larger for n in (small, large)])

    def _chosen(self, t: _Growing) -> tuple[list[int], list[int]]:
        """The nodes that the tree splits as far as their children are known, and those to expand next:
        a node without known children may be followed by others with less gain."""
        by_leaf, deepest = self.growth == "leaf", self.getOrDefault(self.maxDepth) or 1 << 30
        left = self.getOrDefault(self.numLeaves) - 1 if by_leaf else 1 << 30
        chosen, missing, front = [], [], [0]
        while len(chosen) + len(missing) < left:
            front = [n for n in front if t.split[n] is not None and t.depth[n] < deepest]
            if not front:
                break
            node = min(front, key=lambda n: (-t.split[n][0], n)) if by_leaf else front[0]
            front.remove(node)
            if t.feature[node] < 0:
                missing.append(node)
            else:
                chosen.append(node)
                front += [t.left[node], t.right[node]]
        return chosen, missing

    def _fit(self, df: DataFrame):
        classes = label_classes(df, self.getLabelCol())
        k = 1 if len(classes) <= 2 else len(classes)
        number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(self.getLabelCol()).cast("double")) - 1
        data = df.where(F.col(self.getLabelCol()).isNotNull()).select(vector_to_array(F.col(self.getFeaturesCol()), "float64").alias("x"), number.cast("int").alias("y"), self._weight().alias("w"))
        # the source is read once; the rows keep the places they have there
        kept = stored(data.where("w > 0").select("x", "y", F.col("w").cast("double").alias("w"), F.monotonically_increasing_id().alias("id")), "boosting-input")
        try:
            return self._fit_rows(kept.frame, classes, k)
        finally:
            kept.drop()

    def _fit_rows(self, data: DataFrame, classes: list[float], k: int):
        first = data.first()
        if first is None:
            raise ValueError("no rows to fit")
        p, most_bins = len(first["x"]), self.getOrDefault(self.maxBins)
        coarse = None
        if self.getOrDefault(self.everyCut):
            coarse = _Coarse(*_cuts(data, p, COARSE_BINS, 100 * COARSE_BINS))
        cuts = coarse.cuts if coarse else feature_cuts(data, p, most_bins)
        n_cuts = np.array([len(c) for c in cuts])
        bins_of = int(n_cuts.max()) + 1
        if self.growth == "leaf" and bins_of <= DENSE_BINS and k * self.getOrDefault(self.numLeaves) * p * 3 * bins_of > MAX_CELLS:
            raise ValueError("histograms of all leaves exceed MAX_CELLS: use fewer bins or leaves")
        sums = {r["y"]: (r["w"], r["n"], r["most"]) for r in data.groupBy("y").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.max("w").alias("most")).collect()}
        prior = np.array([sums.get(i, (0.0, 0, 0.0))[0] for i in range(max(2, len(classes)))])
        prior /= prior.sum()
        init = np.log(np.maximum(prior, 1e-12)) if k > 1 else np.array([math.log(max(prior[1], 1e-12) / max(prior[0], 1e-12))])
        n, most = sum(s[1] for s in sums.values()), 2 * max(s[2] for s in sums.values())
        kind = np.float64 if coarse else np.uint32 if bins_of > 65_536 else np.uint16 if bins_of > 256 else np.uint8
        rows = _Rows(self._binned(data, None if coarse else cuts, init, n, p, kind), p, k, kind, coarse, tasks(data.sparkSession))
        table, step, nodes = [], self.getOrDefault(self.stepSize), []
        other, top = self.getOrDefault(self.otherRate), self.getOrDefault(self.topRate)
        for t in range(self.getOrDefault(self.maxIter)):
            if t:
                rows.save()
            if other > 0 and t >= 1 / step:
                above = np.cumsum(rows.size_counts(most)[::-1])[::-1]
                least = int(np.flatnonzero(above >= top * n).max(initial=0))
                rows.draw((least, other / (1 - top), (1 - top) / other, self.getSeed() * 1_000_003 + t, most))
            grown = self._round(rows, n_cuts, bins_of)
            for c, tree in enumerate(grown):
                kept, arrays, value = self._finished(tree, step * (1 if k == 1 else (k - 1) / k))
                rows.recent.append((c, arrays, value))
                nodes.append(len(kept))
                table += [[t, c, arrays[0][i], (arrays[1][i] if coarse else cuts[arrays[0][i]][arrays[1][i]]) if arrays[0][i] >= 0 else 0.0, arrays[2][i], arrays[3][i], value[i], kept[i][0], kept[i][1]] for i in range(len(kept))]
            if all(len(g.feature) == 1 for g in grown):
                break
        if rows.sampled is not None:
            rows.sampled.drop()
        rows.table.drop()
        m = self._copy_io(BoostedTreesModel())
        m.set_fitted(classes, np.array(table, float).reshape(-1, 9))
        m.init, m.width = init.tolist(), p
        return m

    def _finished(self, t: _Growing, scale: float):
        """The chosen nodes alone: ((weight, gain) per node, arrays in bin space, leaf values)."""
        chosen = set(self._chosen(t)[0])
        order, number = [], {}
        stack = [0]
        while stack:
            node = stack.pop()
            number[node] = len(order)
            order.append(node)
            if node in chosen:
                stack += [t.right[node], t.left[node]]
        ridge = self.getOrDefault(self.ridge)
        inner = [n in chosen for n in order]
        arrays = (np.array([t.feature[n] if i else -1 for n, i in zip(order, inner)], np.int32), np.array([t.cut[n] for n in order], t.cut_kind),
                  np.array([number[t.left[n]] if i else 0 for n, i in zip(order, inner)], np.int32), np.array([number[t.right[n]] if i else 0 for n, i in zip(order, inner)], np.int32))
        value = np.array([0.0 if i else scale * t.stats[n][0] / (t.stats[n][1] + ridge) if t.stats[n][1] + ridge > 0 else 0.0 for n, i in zip(order, inner)])
        return [(float(t.stats[n][2]), t.split[n][0] if i else 0.0) for n, i in zip(order, inner)], arrays, value

    def _binned(self, data: DataFrame, cuts: list[np.ndarray] | None, init: np.ndarray, n: int, p: int, kind):
        """The row table; without ``cuts`` of values in place of bins."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), p)
                bins = x if cuts is None else np.column_stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)]).astype(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), _each_row(bins), batch.column(2), batch.column(3)], names=["id", "bins", "y", "w"])

        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def record() -> pa.RecordBatch:
                t = pa.Table.from_batches(held).combine_chunks()
                ids, bins, y, w = (t.column(c).chunk(0) for c in ("id", "bins", "y", "w"))
                return _record(id=ids.to_numpy(), bins=_joined(bins, kind), y=y.to_numpy(), w=w.to_numpy(), score=np.tile(init.astype(np.float64), len(t)))

            for batch in batches:
                while batch.num_rows:
                    held.append(batch.slice(0, BLOCK_ROWS - size))
                    batch = batch.slice(held[-1].num_rows)
                    size += held[-1].num_rows
                    if size == BLOCK_ROWS:
                        yield record()
                        held, size = [], 0
            if held:
                yield record()

        parts = max(n // PART_ROWS, n * p // PART_CELLS)
        if n * p <= PARTITION_CELLS:  # numbered without gaps in the order of the partitions
            per = {r["part"]: r["n"] for r in data.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
            before = np.cumsum([0, *(per.get(i, 0) for i in range(max(per)))])
            starts = F.array(*[F.lit(int(b)) for b in before])
            data = data.withColumn("id", F.element_at(starts, F.shiftright("id", 33).cast("int") + 1) + F.col("id").bitwiseAND((1 << 33) - 1))
        rows = data.select("id", "x", "y", "w").mapInArrow(cut, "id long, bins binary, y int, w double")
        rows = rows.repartition(min(parts, tasks(rows.sparkSession)), "id") if parts > 1 else rows.coalesce(1)
        return stored(rows.sortWithinPartitions("id").mapInArrow(records, "id binary, bins binary, y binary, w binary, score binary"), "boosting-rows", one=parts <= 1)


class LeafBoostingClassifier(_Boosting):
    """F8: light gradient boosting - best-first trees of ``numLeaves`` leaves on second-order gains, rows sampled by gradient."""

    growth, newton = "leaf", True
    _defaults = {"maxIter": 100, "maxDepth": 0, "numLeaves": 31, "stepSize": 0.1, "maxBins": 255, "minRows": 20.0, "ridge": 0.0, "topRate": 0.2, "otherRate": 0.1, "everyCut": False}


class SoftmaxBoostingClassifier(_Boosting):
    """F7 for several classes: K trees a round on the softmax residuals (Friedman 2001), split by variance
    reduction to ``maxDepth``, leaf values by one Newton step times (K - 1) / K."""

    growth, newton = "depth", False
    _defaults = {"maxIter": 100, "maxDepth": 3, "numLeaves": 0, "stepSize": 0.1, "maxBins": 255, "minRows": 1.0, "ridge": 0.0, "topRate": 0.0, "otherRate": 0.0, "everyCut": False}


class BoostedTreesModel(CompositePersistence, CustomModel):
    """Fitted nodes: round, class, feature, threshold, left, right, value, weight, gain; children count from their tree's root."""

    init: list = []
    width: int = 0
    _sub_values = ("init", "width")

    def tree_arrays(self):
        """(trees, weights, base): one output per margin; the values of a tree lie in its class's output."""
        nodes, k = self.fitted(), len(self.init)
        start = np.flatnonzero(np.append(True, (np.diff(nodes[:, :2], axis=0) != 0).any(axis=1))) if len(nodes) else []
        trees = []
        for s, e in zip(start, [*start[1:], len(nodes)]):
            own = nodes[s:e]
            value = np.zeros((len(own), k))
            value[:, int(own[0, 1])] = own[:, 6]
            trees.append(Tree(own[:, 2].astype(np.int64), own[:, 3], own[:, 4].astype(np.int64), own[:, 5].astype(np.int64), value, own[:, 7]))
        return trees, [1.0] * len(trees), np.array(self.init)

    @property
    def featureImportances(self) -> DenseVector:
        """Gain of each feature over all trees, adding up to one."""
        nodes = self.fitted()
        inner = nodes[:, 2] >= 0
        gain = np.bincount(nodes[inner, 2].astype(int), nodes[inner, 8], self.width)
        return DenseVector(gain / gain.sum() if gain.sum() > 0 else gain)

    def _transform(self, df):
        trees, _, base = self.tree_arrays()

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            rows = np.stack(x.to_numpy()).astype(float)
            out = np.tile(base, (len(rows), 1))
            for tree in trees:
                out += tree.predict(rows)
            return pd.Series(list(out))

        cur = df.withColumn("__margin", margins(self._features()))
        m = F.col("__margin")
        raw = [-m[0] / 2, m[0] / 2] if len(base) == 1 else [m[i] for i in range(len(base))]
        return with_scores(cur, self, raw[:len(self.getOrDefault(self.classes))] if len(base) > 1 else raw).drop("__margin")
