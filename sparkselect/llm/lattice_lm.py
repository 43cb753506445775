"""Subword lattice likelihood of texts.

The pieces and scores of an existing vocabulary give a first unigram distribution over
pieces (a piece's probability falls with its rank: 1 / (1 - score), as its scores are ranks);
expectation steps over all words of the training documents re-estimate it: every
segmentation of a word counts with its posterior weight, by a forward and a backward
recursion. A word is scored by the log-space forward recursion over its lattice, so by the
sum over all its segmentations, and a text by the sum over its words and one end token.
Pieces that start a word carry the mark, so the distribution over piece sequences that end
with the end token is proper, and segmentations never cross words. A character without a
piece of its own is spelled by its byte pieces.

How it runs: documents are read once, into chunks of whole documents; a chunk is stored as a
row a document (integer codes of its words with counts) and a row a distinct word, so that no
row or batch of rows grows with a chunk. Word counts are summed over all chunks, each distinct
word is scored once, and the values go back to the chunks by (chunk, code), so that no text is
shuffled and no vocabulary is broadcast. Only the vocabulary's pieces (a fixed number) reach the driver.

Defined results: a null or blank text is the end token alone; a null doc_id counts as a
training document; repeated rows count as often as they occur; other columns are ignored; an
empty table gives an empty result. Very long words and texts are scored whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, frugal, mix, text_groups, written
from .tokens import vocabulary

VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
#: Weight of the first distribution against the expected counts, in pieces.
PRIOR = 32_000.0
#: Expectation steps over the training words.
STEPS = 2
#: Text of a chunk, and documents of a batch of the write that makes chunks.
CHUNK_BYTES, BATCH_DOCS = 12 << 20, 1000
MARK = "▁"


def _load(path: str) -> tuple[list[str], np.ndarray, np.ndarray, int]:
    """Pieces, their first probabilities, which are usable, and the end token's number."""
    import sentencepiece as sp

    model = sp.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    end = model.eos_id()
    byte = np.array([model.is_byte(i) for i in range(n)])
    usable = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)])
    usable[end] = True
    score = np.array([model.get_score(i) for i in range(n)])
    first = np.where(usable, 1.0 / (1.0 + np.maximum(-score, 0.0)), 0.0)
    rare = first[usable & ~byte].min()
    first[byte & usable] = rare
    first[end] = 1.0
    return pieces, first / first.sum(), byte, end


class Lattice:
    """Segmentations of many marked words at once, as edge arrays over character positions.

    All prefixes of all pieces are kept as sorted hashes (a hash is extended by one character
    at a time), so that edges are found by following the prefixes from every position.
    """

    _STEP = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, pieces: list[str], probability: np.ndarray, byte: np.ndarray):
        with np.errstate(divide="ignore"):
            self.log = np.log(probability)
        self.bytes = np.full(256, -1, np.int64)
        known: dict[int, int] = {}
        for i, p in enumerate(pieces):
            if probability[i] <= 0:
                continue
            if byte[i]:
                self.bytes[int(p[3:5], 16)] = i
                continue
            h = np.zeros(1, np.uint64)
            for ch in p:
                h = mix(h * self._STEP + np.uint64(ord(ch)))
                known.setdefault(int(h[0]), -1)
            known[int(h[0])] = i
        self.keys = np.array(sorted(known), np.uint64)
        self.piece = np.array([known[int(k)] for k in self.keys], np.int64)
        self.shelf = np.searchsorted(self.keys, np.arange((1 << 18) + 1, dtype=np.uint64) << np.uint64(46)) if len(self.keys) else np.zeros((1 << 18) + 1, np.int64)
        self.shelf[-1] = len(self.keys)
        self.deep = int(np.diff(self.shelf).max())

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the prefixes, or -1."""
        top = (h >> np.uint64(46)).astype(np.int64)
        at, end, found = self.shelf[top], self.shelf[top + 1], np.full(len(h), -1)
        for j in range(self.deep):
            here = at + j
            hit = here < end
            hit[hit] = self.keys[here[hit]] == h[hit]
            found[hit] = here[hit]
        return found

    def edges(self, words: list[str]):
        """(start node, end node, log probability, piece or -1, spelled byte pieces by edge, first nodes, last nodes)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        last_char = np.cumsum(size)
        word = np.repeat(np.arange(len(words)), size)
        room = last_char[word] - np.arange(len(chars))  # characters from here to the word's end
        node = np.arange(len(chars)) + word  # one more node than characters in each word
        at, h, depth = np.arange(len(chars)), np.zeros(len(chars), np.uint64), 0
        starts, lengths, ids = [], [], []
        own_piece = np.zeros(len(chars), bool)
        while len(at):
            h = mix(h * self._STEP + chars[at + depth])
            depth += 1
            found = self._find(h)
            there = found >= 0
            at, h, found = at[there], h[there], found[there]
            piece = self.piece[found]
            is_piece = piece >= 0
            starts.append(at[is_piece])
            lengths.append(np.full(int(is_piece.sum()), depth))
            ids.append(piece[is_piece])
            if depth == 1:
                own_piece[at[is_piece]] = True
            more = room[at] > depth
            at, h = at[more], h[more]
        spelled_at = np.flatnonzero(~own_piece)
        spelled = [self.bytes[np.frombuffer(chr(int(c)).encode("utf-8", "surrogatepass"), np.uint8)] for c in chars[spelled_at]]
        start = np.concatenate([*starts, spelled_at])
        length = np.concatenate([*lengths, np.ones(len(spelled_at), np.int64)])
        piece = np.concatenate([*ids, np.full(len(spelled_at), -1)])
        p = np.concatenate([self.log[np.concatenate(ids)] if ids else np.empty(0), np.array([self.log[x].sum() for x in spelled], float)])
        offset = start - (last_char - size)[word[start]]
        first = last_char - size + np.arange(len(words))
        return node[start], node[start] + length, p, piece, spelled, offset, offset + length, first, first + size

    @staticmethod
    def _pass(values, source, target, p, level, descending):
        """values[t] = logsumexp(values[s] + p) over the edges into t, level by level."""
        order = np.lexsort((target, level))
        if descending:
            order = order[np.argsort(-level[order], kind="stable")]
        cuts = np.flatnonzero(np.diff(level[order], prepend=-1))
        for s, e in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            own = order[s:e]
            x, t = values[source[own]] + p[own], target[own]
            group = np.flatnonzero(np.diff(t, prepend=-1))
            top = np.maximum.reduceat(x, group)
            reached = np.where(np.isfinite(top), top, 0.0)
            total = np.add.reduceat(np.exp(x - np.repeat(reached, np.diff(np.append(group, len(x))))), group)
            with np.errstate(divide="ignore"):
                values[t[group]] = reached + np.log(total)

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each marked word, over all its segmentations."""
        s, t, p, _, _, _, to, first, last = self.edges(words)
        a = np.full(int(last[-1]) + 1, -np.inf)
        a[first] = 0.0
        self._pass(a, s, t, p, to, False)
        return a[last]

    def expected(self, words: list[str], weight: np.ndarray, sums: np.ndarray) -> None:
        """Add the expected number of uses of each piece in ``weight`` copies of each word."""
        s, t, p, piece, spelled, at, to, first, last = self.edges(words)
        n = int(last[-1]) + 1
        a, b = np.full(n, -np.inf), np.full(n, -np.inf)
        a[first], b[last] = 0.0, 0.0
        self._pass(a, s, t, p, to, False)
        self._pass(b, t, s, p, at, True)
        word = np.searchsorted(first, s, "right") - 1
        share = weight[word] * np.exp(a[s] + p + b[t] - a[last][word])
        whole = piece >= 0
        sums += np.bincount(piece[whole], share[whole], minlength=len(sums))
        for used, x in zip(spelled, share[~whole], strict=True):
            np.add.at(sums, used, x)


@lru_cache(maxsize=2)
def _first(path: str) -> tuple[list[str], np.ndarray, np.ndarray, int]:
    return _load(path)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _chunks(most: int):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's documents, with their distinct word codes and counts, and its words."""
        part = TaskContext.get().partitionId()
        for k, table in enumerate(text_groups(batches, 1, most)):
            yield from _chunk(part << 24 | k, table)

    return chunks


def _chunk(number: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
    words = Words(pc.ascii_lower(table.column(1).combine_chunks()))
    n, v = len(table), max(1, len(words.vocab))
    cell, count = np.unique(np.repeat(np.arange(n), words.counts()) * v + words.codes, return_counts=True)
    doc, code = cell // v, (cell % v).astype(np.int32)
    train = np.array([not held_out(d) for d in table.column(0).to_pylist()], bool)
    seen = np.bincount(code, np.where(train[doc], count, 0), minlength=len(words.vocab)).astype(np.int64)
    ends = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (code, count.astype(np.int32))]
    yield _rows(n, number, doc_id=table.column(0).combine_chunks(), train=pa.array(train), codes=lists[0], counts=lists[1])
    if len(words.vocab):
        yield _rows(len(words.vocab), number, code=pa.array(np.arange(len(words.vocab), dtype=np.int32)), word=words.vocab.cast(pa.string()), seen=pa.array(seen))


#: A document (``word`` null) or a distinct word of a chunk.
_CHUNK = "chunk long, doc_id long, train boolean, codes array<int>, counts array<int>, code int, word string, seen long"
_TYPES = {"doc_id": pa.int64(), "train": pa.bool_(), "codes": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()), "code": pa.int32(), "word": pa.string(), "seen": pa.int64()}


def _rows(n: int, number: int, **known: pa.Array) -> pa.RecordBatch:
    columns = [known[c] if c in known else pa.nulls(n, kind) for c, kind in _TYPES.items()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int64)), *columns], names=["chunk", *_TYPES])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], pa.RecordBatch]]:
    """Marked words, some at a time so that their edges stay in memory."""
    for batch in batches:
        for s in range(0, batch.num_rows, 10_000):
            own = batch.slice(s, 10_000)
            yield [MARK + w for w in own.column(0).to_pylist()], own


def _expect(path: str, probability: np.ndarray):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _, byte, _ = _first(path)
        lattice, sums = Lattice(pieces, probability, byte), np.zeros(len(pieces))
        for words, batch in _blocks(batches):
            lattice.expected(words, batch.column(1).to_numpy().astype(float), sums)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], names=["piece", "uses"])

    return expect


def _score(path: str, probability: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _, byte, _ = _first(path)
        lattice = Lattice(pieces, probability, byte)
        for words, batch in _blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lattice.forward(words) / math.log(10))], names=["word", "c", "value"])

    return score


def _sum_chunk(end_count: int, total: int, distinct: int, end_value: float):
    def base(c):
        return np.log10((c + 1.0) / (total + 1.0 * (distinct + 1)))

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        code = right.column("code").to_numpy()
        c, value = np.zeros(len(code)), np.zeros(len(code))
        c[code], value[code] = right.column("c").to_numpy(), right.column("value").to_numpy()
        logs = base(c)
        ids, n_docs = left.column("doc_id"), len(left)
        codes, n = (left.column(x).combine_chunks().flatten().to_numpy() for x in ("codes", "counts"))
        doc = np.repeat(np.arange(n_docs), pc.list_value_length(left.column("codes")).to_numpy())
        add = lambda x: np.bincount(doc, x, minlength=n_docs)
        out = [ids, pa.array([held_out(d) for d in ids.to_pylist()], pa.bool_()),
               pa.array(add(n).astype(np.int64) + 1), pa.array(add(n * (c[codes] > 0)).astype(np.int64) + int(end_count > 0)),
               pa.array(np.full(n_docs, total)), pa.array(add(n * logs[codes]) + base(end_count)), pa.array(add(n * value[codes]) + end_value)]
        return pa.table(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return sums


def lattice_scores(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) per document."""
    path = vocabulary(name)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    chunks = written(rows.mapInArrow(frugal(_chunks(CHUNK_BYTES)), _CHUNK), "lm-chunks", BATCH_DOCS)
    asked = chunks.where(F.col("word").isNotNull()).select("chunk", "code", "word", "seen")
    counts = written(asked.groupBy("word").agg(F.sum("seen").alias("c")), "lm-words")

    pieces, first, byte, end = _first(path)
    n_train = chunks.where("train").count()
    stats = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    total, distinct = stats["n"] + n_train, stats["v"] + int(n_train > 0)
    probability = first
    for _ in range(STEPS):
        uses = first * PRIOR
        for r in counts.where("c > 0").mapInArrow(frugal(_expect(path, probability)), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).orderBy("piece").collect():
            uses[r["piece"]] += r["uses"]
        uses[end] += n_train
        probability = uses / uses.sum()

    values = counts.mapInArrow(frugal(_score(path, probability)), "word string, c long, value double")
    replies = asked.select("chunk", "code", "word").join(values, "word").select("chunk", "code", "c", "value")
    left = chunks.where(F.col("word").isNull()).select(F.col("chunk").alias("part"), "doc_id", "codes", "counts")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return left.groupBy("part").cogroup(replies.groupBy("chunk")).applyInArrow(_sum_chunk(n_train, total, distinct, math.log10(probability[end])), schema)


def op7_frame(docs: DataFrame) -> DataFrame:
    return lattice_scores(docs)
