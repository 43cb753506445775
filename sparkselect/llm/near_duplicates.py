"""b-bit MinHash near-duplicate groups, confirmed on whole shingle sets.

1. Each document's set of distinct 5-word shingles (64-bit hashes) gives 128 minima;
   the low 2 bits of each are packed into four longs, and bands of whole minima are
   hashed (25 of 5 at 85 percent, 32 of 4 at 80). Documents with equal sets (size and two 64-bit sums) form one class.
2. Classes that share a band are candidates. The packed signatures estimate their
   similarity by bit counts, corrected for chance collisions of 2-bit values: m of
   128 equal gives (m / 128 - 1/4) / (3/4). Band shape and the least m follow the
   percentage asked for: a pair just at it stays below that m with a probability of
   at most MISS_EQUAL, and shares no band with one of at most MISS_BANDS.
3. In every band bucket, a spanning forest of the candidate pairs is kept (at most one
   edge per member); its connected components are the candidate groups, so any candidate
   pair lies within one group.
4. In every candidate group, the pairs that the packed bits allow and that are not yet
   connected are confirmed on the whole sets; again a spanning forest is kept, and its
   components are the result. No group is expanded into its pairs.

A bucket or group of any size is dealt out: its members fall into blocks by hash, and each
pair of blocks is a work unit of its own.

Defined results: a null, empty or blank text has an empty set, linked with nothing; a
text of fewer than five words is one shingle; a null doc_id is linked like any other
but never names a component that has another id; repeated rows are copies; an empty
table gives an empty result. Texts of any length are used whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, frugal, gram_hashes, mix, partitions, spread_join, written, text_groups
from .graph import components

SHINGLE = 5
PERMUTATIONS = 128
#: Most probable miss of a pair just at the percentage: by the bands, and by the packed estimate.
MISS_BANDS, MISS_EQUAL = 1e-6, 1e-7
#: Members of a block; blocks grow with the square root of groups above BLOCK_ROWS ** 2 / 16 members.
BLOCK_ROWS = 256
#: Text that is worked on at a time: sets and their hashes take some thirty times as much.
GROUP_BYTES = 2 << 20
#: Rows that a task of texts or whole sets gets at a time; a worker and its JVM hold two such batches each.
BATCH_ROWS = 1_000
#: A link needs 100 * intersection >= MIN_PERCENT * union, unless another percentage is asked for.
MIN_PERCENT = 85
#: A table is broadcast up to so many rows of one long each, and shuffled beyond.
BROADCAST_ROWS = 2_000_000

_RNG = np.random.default_rng(20240501)
_A = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def band_shape(percent: int) -> tuple[int, int]:
    """(rows, bands): the longest bands that a pair of ``percent`` misses with MISS_BANDS at most."""
    for rows in range(PERMUTATIONS, 0, -1):
        bands = PERMUTATIONS // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISS_BANDS:
            return rows, bands
    raise ValueError(f"{PERMUTATIONS} minima do not find pairs of {percent} percent")


def least_equal(percent: int) -> int:
    """The most equal two-bit values that a pair of ``percent`` falls below with MISS_EQUAL at most."""
    q = 0.25 + 0.75 * percent / 100
    below = 0.0
    for m in range(PERMUTATIONS):
        below += math.comb(PERMUTATIONS, m) * q**m * (1 - q) ** (PERMUTATIONS - m)
        if below > MISS_EQUAL:
            return m
    return PERMUTATIONS


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the sorted distinct shingle hashes of row i are hashes[starts[i]:starts[i + 1]]."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    words = Words(pc.ascii_lower(texts))
    hashed = words.hashes()[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    grams = gram_hashes(hashed, SHINGLE)
    parts, starts = [], np.zeros(len(texts) + 1, np.int64)
    for i in range(len(texts)):
        s, e = words.starts[i], words.starts[i + 1]
        if e - s >= SHINGLE:
            own = np.unique(grams[s:e - SHINGLE + 1])
        elif e > s:
            own = gram_hashes(hashed[s:e], int(e - s)) ^ np.uint64(e - s)
        else:
            own = hashed[:0]
        parts.append(own)
        starts[i + 1] = starts[i] + len(own)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), starts


def _minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(rows, PERMUTATIONS) minima; rows with an empty set get zeros."""
    out = np.zeros((len(starts) - 1, PERMUTATIONS), np.uint64)
    full = np.flatnonzero(np.diff(starts))
    i = 0
    while i < len(full):  # blocks of rows that stay in the cache
        j = i + 1
        while j < len(full) and starts[full[j] + 1] - starts[full[i]] <= 1 << 15:
            j += 1
        rows = full[i:j]
        block = hashes[starts[rows[0]]:starts[rows[-1] + 1]]
        at, value = starts[rows] - starts[rows[0]], np.empty_like(block)
        for k in range(PERMUTATIONS):
            np.multiply(block, _A[k], out=value)
            np.add(value, _B[k], out=value)
            out[rows, k] = np.minimum.reduceat(value, at)
        i = j
    return out


def _set_sums(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)))
    two = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    return one[starts[1:]] - one[starts[:-1]], two[starts[1:]] - two[starts[:-1]]


def _class_id(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    one, two = _set_sums(hashes, starts)
    return mix(mix(one + np.diff(starts).astype(np.uint64)) ^ two).view(np.int64)


def _sketch(n_rows: int, n_bands: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, 1, GROUP_BYTES):
            hashes, starts = shingle_sets(batch.column(1))
            low = _minima(hashes, starts)
            bands = np.empty((len(low), n_bands), np.uint64)
            for b in range(n_bands):
                h = np.full(len(low), b + 1, np.uint64)
                for k in range(b * n_rows, (b + 1) * n_rows):
                    h = mix(h * np.uint64(0xD6E8FEB86659FD93) + low[:, k])
                bands[:, b] = h
            bits = (mix(low) & np.uint64(3)).reshape(len(low), 4, 32)
            packed = np.zeros((len(low), 4), np.uint64)
            for k in range(32):
                packed |= bits[:, :, k] << np.uint64(2 * k)
            lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m).view(np.int64).reshape(-1)), m.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).combine_chunks(), batch.column(2).combine_chunks(), pa.array(_class_id(hashes, starts)), pa.array(np.diff(starts)), lists(bands), lists(packed)],
                names=["doc_id", "row_key", "cls", "n", "bands", "sig"])

    return sketch


def sketches(docs: DataFrame, percent: int = MIN_PERCENT) -> DataFrame:
    """doc_id, row_key, cls (equal for equal sets), n (set size), bands, sig (packed low bits)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("row_key"))
    return rows.mapInArrow(frugal(_sketch(*band_shape(percent))), "doc_id long, row_key long, cls long, n long, bands array<long>, sig array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_groups(batches, 0, GROUP_BYTES):
        hashes, starts = shingle_sets(batch.column(0))
        grams = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(_class_id(hashes, starts)), grams], names=["cls", "grams"])


def equal_values(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of the 128 packed two-bit values of a signature equal those of each other one."""
    x = sig ^ others
    return PERMUTATIONS - np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=-1).astype(np.int64)


def estimated_similarity(equal: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity from the number of equal two-bit values."""
    return (equal / PERMUTATIONS - 0.25) / 0.75


def _in_blocks(rows: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with ``block`` and ``unit``, dealt out so that each unit (key, unit) lies in one
    partition, in order; a key of many rows has a unit for every pair of its blocks."""
    parts = partitions(rows.sparkSession)
    block = F.lit(BLOCK_ROWS) * F.sqrt(F.greatest(F.lit(1.0), F.col(size) * F.lit(16.0) / F.lit(BLOCK_ROWS * BLOCK_ROWS)))
    cut = rows.withColumn("blocks", F.ceil(F.col(size) / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    units = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least("block", o) * F.col("blocks") + F.greatest("block", o))
    out = cut.withColumn("unit", F.explode(units)).drop("blocks", size)
    part = F.pmod(F.xxhash64(key) + F.col("unit"), F.lit(parts)).cast("int")
    return out.repartitionById(parts, part).sortWithinPartitions(key, "unit")


def _units(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole units, with the rows at which each unit starts and the end."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, last: bool):
        k, u = table.column(key).to_numpy(), table.column("unit").to_numpy()
        starts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (u[1:] != u[:-1])))
        if last:
            return table, np.append(starts, len(k)), None
        return table.slice(0, starts[-1]), starts, table.slice(starts[-1])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        k, u = batch.column(key), batch.column("unit")
        if k[0] != k[-1] or u[0] != u[-1] or len(held) > 1 and (held[0].column(key)[0] != k[-1] or held[0].column("unit")[0] != u[-1]):
            whole, starts, rest = cut(pa.Table.from_batches(held), False)
            held = rest.to_batches()
            yield whole.combine_chunks(), starts
    if held:
        whole, starts, _ = cut(pa.Table.from_batches(held), True)
        yield whole.combine_chunks(), starts


def _forest(n: np.ndarray, sig: np.ndarray, block: np.ndarray, percent: int, least: int, confirmed=None) -> list[tuple[int, int]]:
    """Edges (i, j) that connect what the allowed pairs connect; ``confirmed(i, js)`` keeps the
    true links of i. With two blocks, only pairs across them."""
    comp, edges = np.arange(len(n)), []
    across = block[0] != block[-1] or (block != block[0]).any()
    for i in range(len(n) - 1):
        js = np.flatnonzero(comp[i + 1:] != comp[i]) + i + 1
        if across:
            js = js[block[js] != block[i]]
        js = js[100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])]
        js = js[equal_values(sig[i], sig[js]) >= least]
        if confirmed is not None and len(js):
            js = confirmed(i, js)
        if len(js):
            joined, at = np.unique(comp[js], return_index=True)
            edges += [(i, int(j)) for j in js[at]]
            comp[np.isin(comp, joined)] = comp[i]
    return edges


def _columns(table: pa.Table) -> tuple:
    sig = table.column("sig").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, 4)
    return table.column("cls").to_numpy(), table.column("n").to_numpy(), sig, table.column("block").to_numpy()


def _edge_batch(cls: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(cls[at[:, 0]]), pa.array(cls[at[:, 1]])], names=["a", "b"])


def _bucket_forests(percent: int):
    least = least_equal(percent)

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _units(batches, "bucket"):
            cls, n, sig, block = _columns(table)
            pairs = np.diff(starts) == 2  # most buckets: all at once
            i = starts[:-1][pairs]
            allowed = 100 * np.minimum(n[i], n[i + 1]) >= percent * np.maximum(n[i], n[i + 1])
            i = i[allowed & (equal_values(sig[i], sig[i + 1]) >= least)]
            edges = list(zip(i.tolist(), (i + 1).tolist(), strict=True))
            for u in np.flatnonzero(np.diff(starts) > 2):
                s, e = starts[u], starts[u + 1]
                edges += [(s + a, s + b) for a, b in _forest(n[s:e], sig[s:e], block[s:e], percent, least)]
            yield _edge_batch(cls, edges)

    return forests


def _group_forests(percent: int):
    least = least_equal(percent)

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _units(batches, "comp"):
            cls, n, sig, block = _columns(table)
            grams = table.column("grams").combine_chunks()
            at, flat = grams.offsets.to_numpy().astype(np.int64), grams.values.to_numpy().view(np.uint64)
            edges = []
            for s, e in zip(starts[:-1], starts[1:], strict=True):

                def confirmed(i: int, js: np.ndarray, s=s) -> np.ndarray:
                    own = flat[at[s + i]:at[s + i + 1]]
                    out = []
                    for k in range(0, len(js), 256):
                        part = js[k:k + 256]
                        size = n[s + part]
                        ends = np.cumsum(size)
                        theirs = flat[np.repeat(at[s + part] - (ends - size), size) + np.arange(ends[-1])]
                        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                        both = np.add.reduceat(hit.astype(np.int64), ends - size)
                        out.append(part[100 * both >= percent * (len(own) + size - both)])
                    return np.concatenate(out)

                edges += [(s + a, s + b) for a, b in _forest(n[s:e], sig[s:e], block[s:e], percent, least, confirmed)]
            yield _edge_batch(cls, edges)

    return forests


def _shingle_sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(cls, grams): the whole set of each class in ``ids``, from one of its documents."""
    wanted = written(classes.select("cls", "row_key").join(ids.select("cls"), "cls").select("row_key").distinct(), "near-wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select("text", F.xxhash64("doc_id", "text").alias("row_key")).join(wanted, "row_key").select("text")
    return texts.mapInArrow(frugal(_sets), "cls long, grams array<long>").dropDuplicates(["cls"])


def near_duplicates(docs: DataFrame, percent: int = MIN_PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, row_key (a hash of doc_id and
    text) and group (the same long for all documents of a component; null for an empty set)."""
    sketch = written(sketches(docs, percent), "near-sketch", BATCH_ROWS)
    classes = written(
        sketch.where("n > 0").groupBy("cls").agg(
            F.min("doc_id").alias("first_id"), F.min("row_key").alias("row_key"), F.max("n").alias("n"),
            F.first("bands").alias("bands"), F.first("sig").alias("sig")), "near-classes")
    slots = classes.select("cls", "n", "sig", F.explode("bands").alias("bucket"))
    shared = written(slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-buckets")
    few = shared.count() <= BROADCAST_ROWS  # then the slots of one class alone are never shuffled
    members = written(slots.join(F.broadcast(shared), "bucket") if few else spread_join(slots, shared, "bucket", counts=shared), "near-members")
    near = _in_blocks(members, "bucket", "c").mapInArrow(frugal(_bucket_forests(percent)), "a long, b long")
    groups = components(near)

    sizes = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("c"))
    grouped = spread_join(groups, sizes, "comp", counts=sizes).select(F.col("node").alias("cls"), "comp", "c")
    sets = _shingle_sets_of(docs, classes, grouped)
    rows = written(grouped.join(classes.select("cls", "n", "sig"), "cls").join(sets, "cls"), "near-groups", BATCH_ROWS)
    links = _in_blocks(rows, "comp", "c").mapInArrow(frugal(_group_forests(percent)), "a long, b long")
    labels = components(written(links, "near-links", BATCH_ROWS))

    named = labels.select(F.col("node").alias("cls"), "comp")
    placed = written(classes.select("cls", "first_id").join(named, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "near-placed")
    names = placed.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    of_class = written(spread_join(placed, names, "comp").select("cls", "component_id", "comp"), "near-names")
    joined = spread_join(sketch.select("doc_id", "row_key", "cls", "n"), of_class, "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"), "row_key", F.col("comp").alias("group"))


def without_copies(docs: DataFrame, percent: int = MIN_PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id (nulls last); of
    repeated rows one. Documents with an empty set all stay."""
    found = written(near_duplicates(docs, percent).select("doc_id", "row_key", "group"), "near-found")
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    keepers = found.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(mine).alias("k")).select("group", F.col("k.row_key").alias("keep"))
    gone = written(spread_join(found, keepers, "group").where("row_key <> keep").select("row_key").distinct(), "near-gone")
    twice = written(found.where(F.col("group").isNotNull()).groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_key"), "near-twice")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    keyed = docs.withColumn("_row_key", F.xxhash64("doc_id", "text"))
    stay = keyed.join(small(gone), keyed["_row_key"] == gone["row_key"], "left_anti")
    if not twice.isEmpty():
        again = small(twice)
        stay = stay.join(again, stay["_row_key"] == again["row_key"], "left_anti").union(
            stay.join(again, stay["_row_key"] == again["row_key"], "left_semi").dropDuplicates(["_row_key"]))
    return stay.select(*docs.columns)


def op8_frame(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).drop("row_key", "group")
