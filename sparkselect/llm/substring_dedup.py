"""Substring dedup by super-k-mers.

A window is 35 consecutive words of a document. Its minimiser is the smallest hash
among its 6-word grams; consecutive windows with one minimiser form a super-k-mer,
which travels as one packed string of word codes to the bucket of that minimiser. In
the bucket, windows are sorted by hash, neighbours with equal hashes are compared word
by word, and a window that occurs twice or more marks its words in every document that
holds it.

Packing: a task packs its documents in groups; for each target partition one blob holds
the distinct super-k-mers of the group (equal ones once, with all places), the words they
use, and is compressed with zstandard. So copies are counted before they are shuffled.

Hot buckets: a first pass counts the super-k-mers of the most frequent minimisers of each
task (all documents; only those above a share of the task's own, so a bounded list). The
windows of a minimiser above its share are dealt to several partitions by the hash of the
window; each of these gets the super-k-mer once. A window is counted whole where its hash
sends it; elsewhere it can only be seen less often, never more.

Defined results: a null or blank text has no words; a text of fewer than 35 words keeps
all; repeated rows (equal doc_id and text) are copies of each other, so that their windows
go; windows are judged on the input; texts of any length are used whole; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, frugal, gram_hashes, mix, partitions, text_groups, written

WINDOW, GRAM = 35, 6
#: Text of a group of documents that are packed together (a document is never cut).
GROUP_BYTES = 8 << 20
#: Super-k-mers of a bucket, about.
BUCKET_ROWS = 200_000
#: Keys of documents with repeats are broadcast up to so many rows of one long each.
BROADCAST_ROWS = 2_000_000


def _window_minima(grams: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    low, have = grams, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


class _Group:
    """Documents of one group: word codes end to end, and the super-k-mers of their windows."""

    def __init__(self, texts: pa.Array, window: int):
        self.words = Words(texts)
        starts, n = self.words.starts, len(self.words.codes)
        vocab_hash = self.words.hashes()
        hashed = vocab_hash[self.words.codes] if n else np.empty(0, np.uint64)
        gram = min(GRAM, window)
        first = np.empty(0, np.int64)
        if n >= window:
            minima = _window_minima(gram_hashes(hashed, gram), window - gram + 1)
            row_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            inside = row_of[:n - window + 1] == row_of[window - 1:]
            first = np.flatnonzero(inside)  # word positions where a window starts
        if not len(first):
            self.first, self.size, self.bucket, self.row = first, first, np.empty(0, np.uint64), first
            self.window_hash = np.empty(0, np.uint64)
            return
        value, rows = minima[first], row_of[first]
        new = np.ones(len(first), bool)
        new[1:] = (value[1:] != value[:-1]) | (first[1:] != first[:-1] + 1) | (rows[1:] != rows[:-1])
        at = np.flatnonzero(new)
        self.first = first[at]
        self.size = np.diff(np.append(at, len(first)))  # windows of each super-k-mer
        self.bucket = mix(value[at])
        self.row = rows[at]
        self.hashed = hashed

    def window_hashes(self, window: int) -> np.ndarray:
        """Polynomial hash of the window that starts at each word (0 at the end)."""
        return _polynomial(self.hashed, window)


_P = np.uint64(0x9E3779B185EBCA87)


def _polynomial(hashed: np.ndarray, window: int) -> np.ndarray:
    """Hash of each run of ``window`` values, by doubling; the same values give the same hash."""
    h, have, power = mix(hashed), 1, _P
    powers = {1: _P}
    with np.errstate(over="ignore"):
        while have < window:
            step = min(have, window - have)
            if step == have:
                h = h[:-step] * power + h[step:]
                power = power * power
                have += step
                powers[have] = power
            else:  # overlap: the last ``have`` values of the longer run
                h = mix(h[:-step]) * _P + h[step:]
                have += step
    return mix(h)


def _groups(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[pa.Table, _Group]]:
    for table in text_groups(batches, 0, GROUP_BYTES):
        yield table, _Group(table.column(0), window)


def _frequent(window: int, share: float):
    """Per task: the minimisers with at least ``share`` of its super-k-mers, and the total (bucket 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, {}
        for _, group in _groups(batches, window):
            total += len(group.bucket)
            values, n = np.unique(group.bucket, return_counts=True)
            many = n >= max(2, share * len(group.bucket))
            for v, k in zip(values[many].view(np.int64).tolist(), n[many].tolist(), strict=True):
                sums[v] = sums.get(v, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array([None, *sums], pa.int64()), pa.array([total, *sums.values()], pa.int64())], names=["bucket", "n"])

    return count


def _minimisers(texts: DataFrame, window: int, parts: int) -> tuple[DataFrame, int]:
    """Counts of the frequent minimisers (bucket, n), and the number of all super-k-mers."""
    share = 1 / (4 * parts)
    counts = texts.mapInArrow(frugal(_frequent(window, share)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = written(counts, "super-kmer-counts")
    return total, total.where("bucket is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def _hot(counts: DataFrame, all_of: int, parts: int) -> dict[int, int]:
    rows = counts.where(F.col("bucket").isNotNull() & (F.col("n") * 2 * parts > all_of)).orderBy(F.desc("n"), "bucket").limit(4 * parts).collect()
    return {r["bucket"]: min(parts, 1 + 4 * r["n"] * parts // all_of) for r in rows}


def hot_buckets(texts: DataFrame, window: int, parts: int) -> dict[int, int]:
    """Minimisers with more super-k-mers than half a partition's mean share, and into how
    many pieces their windows are dealt. At most 4 * parts entries."""
    return _hot(*_minimisers(texts, window, parts), parts)


def _pack(window: int, parts: int, hot: dict[int, int]):
    hot_keys = np.array(sorted(hot), np.int64).view(np.uint64)
    hot_keys.sort()
    pieces = np.array([hot[int(k)] for k in hot_keys.view(np.int64)], np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for table, group in _groups(batches, window):
            if not len(group.first):
                continue
            codes, vocab = group.words.codes, group.words.vocab
            keys1, keys2 = table.column(1).to_numpy(), table.column(2).to_numpy()
            order = np.lexsort((group.first, group.bucket))
            first, size, bucket, row = group.first[order], group.size[order], group.bucket[order], group.row[order]
            # (super-k-mer, target): one target, or for a hot bucket the targets of its windows
            target = (bucket % np.uint64(parts)).astype(np.int64)
            which, to = np.arange(len(first)), target
            if len(hot_keys):
                slot = np.minimum(np.searchsorted(hot_keys, bucket), len(hot_keys) - 1)
                is_hot = hot_keys[slot] == bucket
                if is_hot.any():
                    h = group.window_hashes(window)
                    w_which, w_to = [which[~is_hot]], [target[~is_hot]]
                    hs = np.flatnonzero(is_hot)
                    each = np.repeat(hs, size[hs])
                    at = np.arange(len(each)) - np.repeat(np.cumsum(size[hs]) - size[hs], size[hs])
                    piece = (h[first[each] + at] % pieces[slot[each]].astype(np.uint64)).astype(np.int64)
                    t = (target[each] + 1 + piece * 7919) % parts
                    pair = np.unique(each * parts + t)
                    w_which.append(pair // parts)
                    w_to.append(pair % parts)
                    which, to = np.concatenate(w_which), np.concatenate(w_to)
            by = np.argsort(to, kind="stable")
            which, to = which[by], to[by]
            cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            for s, e in zip(cuts, np.append(cuts[1:], len(to)), strict=True):
                yield _blob(squeeze, int(to[s]), which[s:e], first, size, row, codes, vocab, group.words.starts, keys1, keys2, window)

    return pack


def _blob(squeeze, to, which, first, size, row, codes, vocab, starts, keys1, keys2, window) -> pa.RecordBatch:
    length = size[which] + window - 1
    ends = np.cumsum(length)
    flat = np.repeat(first[which] - (ends - length), length) + np.arange(ends[-1])
    chosen = codes[flat]
    there = np.zeros(len(vocab), bool)
    there[chosen] = True
    used = np.flatnonzero(there)
    number = np.empty(len(vocab), np.uint32)
    number[used] = np.arange(len(used))
    local = number[chosen]
    # equal packed strings travel once, with all places
    raw, at = local.tobytes(), np.append(0, ends) * 4
    known, of, texts = {}, np.empty(len(which), np.int64), []
    at = at.tolist()
    for i in range(len(which)):
        k = raw[at[i]:at[i + 1]]
        j = known.setdefault(k, len(known))
        if j == len(texts):
            texts.append(k)
        of[i] = j
    words = vocab.take(pa.array(used)).cast(pa.binary())
    r = row[which]
    small = np.uint16 if len(used) <= 1 << 16 else np.uint32
    body = {
        "word_bytes": words.buffers()[2].to_pybytes(), "word_sizes": pc.binary_length(words).to_numpy().astype(np.uint32),
        "codes": np.frombuffer(b"".join(texts), np.uint32).astype(small),
        "lengths": np.array([len(t) // 4 for t in texts], np.uint32),
        "of": of.astype(np.uint32), "start": (first[which] - starts[r]).astype(np.uint32),
        "rows": np.unique(r),
    }
    body["row"] = np.searchsorted(body["rows"], r).astype(np.uint32)
    body["k1"], body["k2"] = keys1[body["rows"]], keys2[body["rows"]]
    del body["rows"]
    return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([squeeze.compress(pickle.dumps(body, protocol=5))], pa.binary())], names=["part", "blob"])


def _words(data: bytes, sizes: np.ndarray) -> pa.Array:
    ends = np.cumsum(sizes, dtype=np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(data)])


def _repeated(codes: np.ndarray, at: np.ndarray, weight: np.ndarray, hashes: np.ndarray, window: int) -> np.ndarray:
    """Which windows (starting at codes[at]) occur twice or more, weighing each by ``weight``.

    Windows are sorted by hash; each neighbour pair of equal hashes is compared word by
    word, and a run in which any differ is sorted by its words instead."""
    order = np.argsort(hashes, kind="stable")
    h, found = hashes[order], np.zeros(len(at), bool)
    same = h[1:] == h[:-1]
    odd = np.zeros(len(same), bool)
    span = np.arange(window)
    pairs = np.flatnonzero(same)
    for s in range(0, len(pairs), 1 << 14):
        p = pairs[s:s + (1 << 14)]
        odd[p] = (codes[at[order[p]][:, None] + span] != codes[at[order[p + 1]][:, None] + span]).any(axis=1)
    run = np.append(0, np.cumsum(~same))
    weights = np.bincount(run, weight[order])
    found[order] = weights[run] > 1
    for r in np.unique(run[:-1][odd]):
        own = order[run == r]
        _, which = np.unique(codes[at[own][:, None] + span], axis=0, return_inverse=True)
        found[own] = np.bincount(which.reshape(-1), weight[own])[which.reshape(-1)] > 1
    return found


def _count(window: int, parts: int):
    """Per partition: the ranges of words (k1, k2, lo, hi) covered by repeated windows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_part.setdefault(part, []).append(blob)
        for part in sorted(by_part):
            yield from ranges(by_part.pop(part))

    def ranges(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        vocabs, codes, lengths, weight, places = [], [], [], [], []
        base = 0
        unpack = zstandard.ZstdDecompressor()
        for blob in blobs:
            body = pickle.loads(unpack.decompress(blob))
            vocabs.append(_words(body["word_bytes"], body["word_sizes"]))
            codes.append(body["codes"])
            lengths.append(body["lengths"].astype(np.int64))
            weight.append(np.bincount(body["of"], minlength=len(body["lengths"])).astype(np.float64))
            places.append((body["of"].astype(np.int64) + base, body["start"].astype(np.int64), body["k1"][body["row"]], body["k2"][body["row"]]))
            base += len(body["lengths"])
        blobs.clear()
        joint = pa.concat_arrays(vocabs).dictionary_encode()
        ids, word_at = joint.indices.to_numpy().astype(np.uint32), np.cumsum([0, *map(len, vocabs)])
        codes = np.concatenate([ids[s:][c] for s, c in zip(word_at[:-1], codes, strict=True)])
        lengths, weight = np.concatenate(lengths), np.concatenate(weight)
        digest = xxhash.xxh3_64_intdigest
        hashed = np.fromiter(map(digest, joint.dictionary.to_pylist()), np.uint64, len(joint.dictionary))
        del vocabs, joint, ids
        windows = lengths - window + 1
        string_at = np.cumsum(lengths) - lengths
        first_window = np.cumsum(windows) - windows
        of = np.repeat(np.arange(len(lengths), dtype=np.int32), windows)
        step = (np.arange(len(of)) - first_window[of]).astype(np.int32)
        at = string_at[of] + step
        hashes = np.empty(len(at), np.uint64)
        for s in range(0, len(codes) - window + 1, 1 << 18):  # some at a time: the hash takes several arrays
            block = _polynomial(hashed[codes[s:s + (1 << 18) + window - 1]], window)
            lo, hi = np.searchsorted(at, (s, s + len(block)))
            hashes[lo:hi] = block[at[lo:hi] - s]
        found = _repeated(codes, at, weight[of], hashes, window)
        del hashes, at
        # runs of found windows within a string
        edge = np.flatnonzero(found & np.append(True, ~found[:-1] | (of[1:] != of[:-1])))
        stop = np.flatnonzero(found & np.append(~found[1:] | (of[1:] != of[:-1]), True))
        per = np.bincount(of[edge], minlength=len(lengths))
        run_at = np.cumsum(per) - per
        for string, start, k1, k2 in places:
            n = per[string]
            if not n.any():
                continue
            each = np.repeat(np.arange(len(string)), n)
            run = run_at[string[each]] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1[each]), pa.array(k2[each]), pa.array(start[each] + step[edge[run]]), pa.array(start[each] + step[stop[run]] + window)],
                names=["k1", "k2", "lo", "hi"])

    return count


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, lo, hi): word ranges of the documents with these keys that are covered by
    repeated windows; ranges may overlap. Keys are two hashes of (doc_id, text)."""
    parts = partitions(docs.sparkSession)
    texts = docs.select("text", *_keys())
    counts, all_of = _minimisers(texts.select("text"), window, parts)
    parts = max(parts, -(-all_of // BUCKET_ROWS))  # a bucket is held by one task: its size doesn't follow the session's setting
    hot = _hot(counts, all_of, parts)
    blobs = texts.mapInArrow(frugal(_pack(window, parts, hot)), "part int, blob binary")
    return blobs.repartitionById(parts, F.col("part")).mapInArrow(frugal(_count(window, parts)), "k1 long, k2 long, lo long, hi long")


def _keys():
    return F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(7)).alias("k2")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        lows, highs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        n_words, n_removed, kept = [], [], []
        for text, lo, hi in zip(texts, lows, highs, strict=True):
            words = (text or b"").split()
            n = len(words)
            if lo:
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, np.array(lo), 1)
                np.add.at(cover, np.array(hi), -1)
                gone = np.cumsum(cover[:-1]) > 0
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            n_words.append(n)
            n_removed.append(n - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) per document.

    Only documents with a repeated window are shuffled to their ranges, if the keys of those
    are few enough to be sent to all tasks; else all are.
    """
    schema = "doc_id long, n_words long, n_removed long, kept string"
    found = written(repeated_ranges(docs, window).distinct(), "repeated-ranges")  # equal rows have the same ranges
    ranges = found.groupBy("k1", "k2").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    rows = docs.select(F.col("doc_id").cast("long"), "text", *_keys())
    touched = written(found.select("k1").distinct(), "repeated-keys")
    if touched.count() > BROADCAST_ROWS:
        return rows.join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "lo", "hi").mapInArrow(frugal(_keep), schema)
    keys = F.broadcast(touched)
    none = F.lit(None).cast("array<long>")
    plain = rows.join(keys, "k1", "left_anti").select("doc_id", "text", none.alias("lo"), none.alias("hi")).mapInArrow(frugal(_keep), schema)
    cut = rows.join(keys, "k1", "left_semi").join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "lo", "hi").mapInArrow(frugal(_keep), schema)
    return plain.union(cut)


def op1_frame(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
