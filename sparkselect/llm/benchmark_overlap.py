"""Benchmark passages in documents, by one Aho-Corasick automaton.

Test items (questions and answers) are normalised to terms; a pattern is a window of ten
consecutive terms of an item, or all terms of an item that has fewer. The automaton's symbols
are terms: each distinct term of a group of texts is looked up once, a term that no pattern
holds is symbol 0, and runs of known terms shorter than the shortest pattern are passed over.
The rest is scanned once; a match is a range of terms of its document, whose code points in
the original text follow from the bytes (normalising keeps each byte's place).

The documents are read once and not shuffled. The patterns are broadcast in blocks of at most
about ``BLOCK_ROWS`` (window, item) rows, counted first: one block for any usual benchmark; for a larger one a
task scans its texts with the automaton of one block after the other, so memory stays bounded.

Defined results: a null text or item has no terms, and an item without terms no pattern. Rows of
items with the same id (null counts as the id "") are one item, each with its own windows; repeated
item rows change nothing. Every document row, repeated ones too, gives one row; a null doc_id
stays null. No items, or items without terms: no hits. No documents: no rows. Texts of any
length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, text_groups, written
from .terms import Terms, lists

WINDOW = 10
#: Rows (window, item) of one automaton, about.
BLOCK_ROWS = 500_000
#: Text of a group of documents that is scanned at a time.
GROUP_BYTES = 8 << 20

_FOUND = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def _windows(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_groups(batches, 0, GROUP_BYTES):
            terms, ids = Terms(table.column(0)), table.column(1)
            vocab = terms.vocab.to_pylist()
            for row, item in enumerate(ids.to_pylist()):
                own = [vocab[c] for c in terms.codes[terms.starts[row]:terms.starts[row + 1]]]
                found = sorted({" ".join(own[i:i + window]) for i in range(max(1, len(own) - window + 1))}) if own else []
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([item] * len(found), pa.string())], names=["window", "item"])

    return cut


def windows(items: DataFrame, window: int = WINDOW, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """(window, item): the distinct patterns of each item, terms joined by a space. Each of
    ``columns`` (a question, its answer, ...) is a text of its own."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    texts = items.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("text"), item.alias("item"))
    return texts.mapInArrow(frugal(_windows(window)), "window string, item string").distinct()


class Automaton:
    """The automaton of one block, and the items of each of its patterns."""

    def __init__(self, block: tuple[list[str], list[str]]):
        self.symbols: dict[str, int] = {}
        self.items: list[list[str]] = []
        self.sizes: list[int] = []
        self.scan = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        number: dict[str, int] = {}
        for window, item in zip(*block, strict=True):
            n = number.setdefault(window, len(number))
            if n == len(self.items):
                key = tuple(self.symbols.setdefault(t, len(self.symbols) + 1) for t in window.split(" "))
                self.scan.add_word(key, n)
                self.items.append([])
                self.sizes.append(len(key))
            self.items[n].append(item)
        self.size_of = np.array(self.sizes, np.int64)
        if number:
            self.scan.make_automaton()

    def matches(self, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
        """(first term, pattern) of every occurrence; terms are numbered through all rows."""
        none = np.empty(0, np.int64)
        if not self.sizes or not len(terms.codes):
            return none, none
        known = self.symbols.get
        symbol = np.fromiter((known(t, 0) for t in terms.vocab.to_pylist()), np.int64, len(terms.vocab))[terms.codes]
        n = len(symbol)
        row_start = np.zeros(n + 1, bool)
        row_start[terms.starts] = True
        # runs of known terms within one row
        there = symbol != 0
        begin = np.flatnonzero(there & (row_start[:n] | ~np.append(False, there[:-1])))
        end = np.flatnonzero(there & (row_start[1:] | ~np.append(there[1:], False))) + 1
        long = end - begin >= min(self.sizes)
        begin, size = begin[long], (end - begin)[long]
        if not len(begin):
            return none, none
        # the runs end to end, each after a 0, and the term that each place stands for
        stop = np.cumsum(size + 1)
        at = np.repeat(begin - (stop - size), size + 1) + np.arange(stop[-1])
        line = symbol[at]
        line[stop - size - 1] = 0
        found = np.array([x for e, p in self.scan.iter(tuple(line.tolist())) for x in (e, p)], np.int64).reshape(-1, 2)
        return at[found[:, 0]] - self.size_of[found[:, 1]] + 1, found[:, 1]


_LAST: list = [None, None]


def _automaton(block: Broadcast, only: bool) -> Automaton:
    """The automaton of a block; this worker keeps it over its tasks if there is one block only."""
    if only and _LAST[0] == block.value[0]:
        return _LAST[1]
    made = Automaton(block.value[1:])
    if only:
        _LAST[:] = [block.value[0], made]
    else:
        vars(block).pop("_value", None)
    return made


def _scan(blocks: list[Broadcast]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_groups(batches, 0, GROUP_BYTES):
            terms = Terms(table.column(0))
            n, rows = len(terms.codes), len(terms.starts) - 1
            cover, items = np.zeros(n + 1, np.int32), [set() for _ in range(rows)]
            for block in blocks:
                own = _automaton(block, len(blocks) == 1)
                first, pattern = own.matches(terms)
                np.add.at(cover, first, 1)
                np.add.at(cover, first + own.size_of[pattern] if len(first) else first, -1)
                row = np.searchsorted(terms.starts, first, "right") - 1
                for pair in np.unique(row * (len(own.sizes) + 1) + pattern).tolist():
                    items[pair // (len(own.sizes) + 1)].update(own.items[pair % (len(own.sizes) + 1)])
            hit = np.append(0, np.cumsum(np.cumsum(cover[:-1]) > 0))
            n_hit = hit[terms.starts[1:]] - hit[terms.starts[:-1]]
            spans = [[] for _ in range(rows)]
            for row in np.flatnonzero(n_hit).tolist():
                lo, hi = terms.starts[row], terms.starts[row + 1]
                edge = np.diff(np.concatenate(([0], np.diff(hit[lo:hi + 1]), [0])))
                start, end = terms.places(row)
                spans[row] = [{"start": s, "end": e} for s, e in zip(start[edge[:-1] == 1].tolist(), end[edge[1:] == -1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [table.column(1).combine_chunks(), pa.array(terms.counts(), pa.int64()), pa.array(n_hit, pa.int64()), lists([sorted(x) for x in items], pa.string()),
                 lists(spans, pa.struct([("start", pa.int64()), ("end", pa.int64())]))],
                names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return scan


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, columns: tuple[str, ...] = ("text",), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (terms inside any occurrence of a pattern),
    items (ids whose patterns occur, sorted as strings) and spans (the hit terms' ranges of code points in
    the original text, adjacent terms joined)."""
    spark = docs.sparkSession
    patterns = written(windows(items, window, columns), "benchmark-windows")
    blocks = max(1, -(-patterns.count() // block_rows))
    sent = []
    for b in range(blocks):
        part = patterns.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == b).toArrow()
        name = (patterns.inputFiles() or [""])[0]
        sent.append(spark.sparkContext.broadcast((name, part.column(0).to_pylist(), part.column(1).to_pylist())))
    return docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(frugal(_scan(sent)), _FOUND)


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a pattern of an item: ``overlaps`` by row, then a filter."""
    row = docs.select("text", F.xxhash64("doc_id", "text").alias("doc_id"))
    hit = written(overlaps(row, items, window).where("n_hit > 0").select(F.col("doc_id").alias("_row_key")).distinct(), "contaminated")
    return docs.withColumn("_row_key", F.xxhash64("doc_id", "text")).join(hit, "_row_key", "left_anti").select(*docs.columns)


def op11_frame(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = overlaps(docs, items)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: DuckDB: windows of each item joined with the documents' windows of the same length.
OP11_SQL = r"""
with low as (
  select 'd' as side, cast(doc_id as varchar) as id, row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from documents
), items as (
  select distinct coalesce(cast(item_id as varchar), '') as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from benchmark
), patterns as (
  select distinct item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as p
  from (select item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from items where len(w) > 0)
), sizes as (select distinct n from patterns
), places as (
  select r, i, n, array_to_string(w[i:i + n - 1], ' ') as p
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from low, sizes where len(w) >= n)
), found as (select places.r, places.i, places.n, patterns.item from places join patterns using (n, p)
), hits as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from found) group by r
), named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from found) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from low left join hits using (r) left join named using (r)
"""
