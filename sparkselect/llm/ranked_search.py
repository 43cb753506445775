"""Ranked lexical search: Block-Max MaxScore over an index in shards.

``build_index`` makes one row per shard (a group of whole documents): the lexicon, and a posting list
for every term, cut into blocks of 128 postings. Gaps and frequencies of a block take the
fewest bytes that hold them. Beside each block stands its front: the pairs (frequency, least document length
at that frequency or above) that no other posting of the block beats. A score grows with the
frequency and falls with the length, so the best of a front is the block's exact maximum under any corpus
statistics, and the index stays right when N and L change.

``search`` sums N, L and the query terms' document frequencies over the shards, and answers
all queries in each shard. The lists of a query are ordered by their bounds; those
whose bounds, summed from the least, stay below the query's worst kth score are not essential: they bring no new
candidates. A candidate whose score so far, with the maximum of its block in a list and the
bounds of the later lists, stays below that score is rejected before the block is unpacked.
A task carries each query's best from one shard to the next, and the best of all tasks are merged.

The index is written to the shared folder, so a lost executor costs a shard's search only.
Queries go out in blocks of at most about ``QUERY_ROWS`` (query, term) rows, counted first; an
item is never cut. No link between shards but the final merge of k rows a query and task.

Defined results: null texts have no terms; a document without terms counts nowhere and a
query without terms has no rows; every document row is a document of its own (repeated rows rank one after
the other); a null doc_id ranks last among equal scores. Distinct texts of one item_id (null is an
id too) form one query, repeated item rows change nothing. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, text_groups, written
from .terms import Terms

BLOCK = 128
#: Text of a shard (a document is never cut).
SHARD_BYTES = 8 << 20
#: Rows (query, term) of a block of queries, about.
QUERY_ROWS = 500_000
TOP = 10
#: The fixed weights of the score: per mille of a frequency, and of a document's length.
SCALE, LOW, HIGH = 1_000_000_000, 25, 75

#: Integer arrays of a shard row, as bytes.
_ARRAYS = {"length": np.int32, "df": np.int32, "list_blocks": np.int32, "first": np.int32, "count": np.uint8, "gap_bytes": np.uint8,
           "tf_bytes": np.uint8, "front_size": np.uint8, "front_tf": np.int32, "front_length": np.int32}
_INDEX = "n_docs long, n_terms long, doc_id array<long>, terms binary, " + ", ".join(f"{k} binary" for k in _ARRAYS) + ", postings binary"


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, size: np.ndarray) -> None:
    for k in range(4):
        wide = size > k
        out[at[wide] + k] = (values[wide] >> (8 * k)) & 255


def _get(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    values = data[at].astype(np.int64)
    for k in range(1, int(size.max(initial=1))):
        wide = size > k
        values[wide] |= data[at[wide] + k].astype(np.int64) << (8 * k)
    return values


def _bytes_for(most: np.ndarray) -> np.ndarray:
    return (1 + (most > 0xFF) + (most > 0xFFFF) + (most > 0xFFFFFF)).astype(np.uint8)


def _shard(texts: pa.Array, doc_ids: pa.Array) -> dict:
    terms = Terms(texts)
    n_terms = terms.counts()
    have = np.flatnonzero(n_terms)
    number = np.cumsum(n_terms > 0) - 1  # documents without terms take no place
    length = n_terms[have].astype(np.int32)
    vocab, codes = terms.vocab, terms.codes
    del terms
    key = codes.astype(np.int64)
    key *= max(1, len(have))
    key += np.repeat(number, n_terms)
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    tf = np.diff(np.append(new, len(key))).astype(np.int32)
    code = (key[new] // max(1, len(have))).astype(np.int32)
    doc = (key[new] % max(1, len(have))).astype(np.int32)
    del key, new, codes
    df = np.bincount(code, minlength=len(vocab)).astype(np.int32)
    del code
    in_list = np.arange(len(doc), dtype=np.int32) - np.repeat((np.cumsum(df) - df).astype(np.int32), df)
    start = np.flatnonzero(in_list % BLOCK == 0)  # where blocks start
    del in_list
    count = np.diff(np.append(start, len(doc))).astype(np.int32)
    gap = np.append(np.int32(0), np.diff(doc))
    gap[start] = 0
    gap_bytes, tf_bytes = (_bytes_for(np.maximum.reduceat(x, start)) if len(start) else np.empty(0, np.uint8) for x in (gap, tf))
    size = count * (gap_bytes.astype(np.int64) + tf_bytes)
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), np.uint8)
    place = np.arange(len(doc), dtype=np.int32) - np.repeat(start.astype(np.int32), count)
    for values, wide, base in ((gap, gap_bytes, at), (tf, tf_bytes, at + count * gap_bytes.astype(np.int64))):
        wide = np.repeat(wide, count)
        _put(data, np.repeat(base, count) + place * wide.astype(np.int32), values, wide)
    del gap, place, wide, values
    # fronts: by falling frequency, each length below all before it in the block; a lone posting is its own
    block = np.repeat(np.arange(len(start), dtype=np.int32), count)
    several = np.flatnonzero(np.repeat(count > 1, count))
    order = several[np.lexsort((length[doc[several]], -tf[several], block[several]))]
    own, shift = length[doc[order]].astype(np.int64), int(length.max(initial=0)) + 1
    low = np.minimum.accumulate(own + (len(start) - block[order].astype(np.int64)) * shift)
    better = np.append(True, (low[1:] < low[:-1]) | (block[order[1:]] != block[order[:-1]])) if len(order) else np.empty(0, bool)
    chosen = np.append(order[better], start[count == 1])
    chosen = chosen[np.argsort(block[chosen], kind="stable")]
    del own, low, better, order, several
    return {
        "n_docs": len(have), "n_terms": int(n_terms.sum()), "doc_id": doc_ids.take(pa.array(have)), "terms": b" ".join(vocab.cast(pa.large_binary()).to_pylist()),
        "length": length, "df": df, "list_blocks": -(-df // BLOCK), "first": doc[start], "count": count, "gap_bytes": gap_bytes, "tf_bytes": tf_bytes,
        "front_size": np.bincount(block[chosen], minlength=len(start)), "front_tf": tf[chosen], "front_length": length[doc[chosen]], "postings": data.tobytes()}


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in text_groups(batches, 0, SHARD_BYTES):
        row = _shard(table.column(0), table.column(1).combine_chunks())
        ids = pa.ListArray.from_arrays(pa.array([0, len(row["doc_id"])], pa.int32()), row["doc_id"])
        binary = [pa.array([row[k].astype(t).tobytes()], pa.binary()) for k, t in _ARRAYS.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["n_docs"]], pa.int64()), pa.array([row["n_terms"]], pa.int64()), ids, pa.array([row["terms"]], pa.binary()), *binary, pa.array([row["postings"]], pa.binary())],
            names=["n_docs", "n_terms", "doc_id", "terms", *_ARRAYS, "postings"])


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all documents, written to the shared folder: one row per shard."""
    return written(docs.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(frugal(_shards), _INDEX), "lexical-index")


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in text_groups(batches, 0, SHARD_BYTES):
        terms, ids = Terms(table.column(0)), table.column(1).combine_chunks()
        row = np.repeat(np.arange(len(ids)), terms.counts())
        pair, n = np.unique(row * max(1, len(terms.vocab)) + terms.codes, return_counts=True)
        row, code = np.divmod(pair, max(1, len(terms.vocab)))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), terms.vocab.take(pa.array(code)).cast(pa.string()), pa.array(n, pa.int64())], names=["item_id", "term", "n"])


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n): how often each item holds each of its terms."""
    texts = items.select("text", F.col("item_id").cast("long").alias("item_id")).distinct()
    return texts.mapInArrow(frugal(_query_terms), "item_id long, term string, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def _lexicon(terms: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([terms], pa.large_binary()).cast(pa.large_string()), " ").values if terms else pa.array([], pa.large_string())


def _frequencies(wanted: Broadcast):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(wanted.value, pa.large_string())
        for batch in batches:
            for terms, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lexicon = _lexicon(terms)
                there = pc.is_in(lexicon, known)
                own = np.frombuffer(df, np.int32)[there.to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([lexicon.filter(there).cast(pa.string()), pa.array(own.astype(np.int64))], names=["term", "df"])

    return count


class Shard:
    """A shard under given corpus statistics, for one set of query terms."""

    def __init__(self, row: dict, known: pa.Array, total_docs: int, total_terms: int):
        for k, t in _ARRAYS.items():
            setattr(self, k, np.frombuffer(row[k], t).astype(np.int64))
        self.data, self.doc_id = np.frombuffer(row["postings"], np.uint8), row["doc_id"]
        scale = lambda n: 8 * (LOW + (HIGH * n * total_docs) // total_terms)
        self.norm = scale(self.length)
        size = self.count * (self.gap_bytes + self.tf_bytes)
        self.at = np.cumsum(size) - size
        best = (SCALE * self.front_tf) // (1000 * self.front_tf + scale(self.front_length))
        self.block_best = np.maximum.reduceat(best, np.cumsum(self.front_size) - self.front_size) if len(best) else best
        self.list_end = np.cumsum(self.list_blocks)
        self.list_best = np.maximum.reduceat(self.block_best, self.list_end - self.list_blocks) if len(best) else best
        found = pc.index_in(known, _lexicon(row["terms"]))
        #: list of each known term, or -1
        self.list_of = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        self.unpacked = 0

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, impact) of the postings of some blocks, in order."""
        self.unpacked += len(blocks)
        count = self.count[blocks]
        ends = np.cumsum(count)
        each = np.repeat(np.arange(len(blocks)), count)
        place = np.arange(ends[-1]) - (ends - count)[each]
        g, t, at = self.gap_bytes[blocks], self.tf_bytes[blocks], self.at[blocks]
        gap = np.cumsum(_get(self.data, at[each] + place * g[each], g[each]))
        doc = gap - (gap[ends - count] - self.first[blocks])[each]
        tf = _get(self.data, (at + count * g)[each] + place * t[each], t[each])
        return doc, (SCALE * tf) // (1000 * tf + self.norm[doc])

    def best(self, lists: np.ndarray, weight: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores of all that may be among the k best; ``floor``: no score below it counts."""
        bound = weight * self.list_best[lists]
        order = np.argsort(-bound, kind="stable")
        lists, weight, bound = lists[order], weight[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)
        score = np.zeros(len(self.length), np.int64)

        def raised(scores: np.ndarray) -> int:
            return max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) >= k else floor

        i = 0
        while i < len(lists) and rest[i] >= floor:  # essential: a document only in lists from i on may still count
            e = self.list_end[lists[i]]
            doc, impact = self.postings(np.arange(e - self.list_blocks[lists[i]], e))
            score[doc] += weight[i] * impact
            i += 1
            floor = raised(score)
        doc = np.flatnonzero(score + rest[i] >= max(floor, 1))
        doc = doc[score[doc] > 0]
        for j in range(i, len(lists)):
            e = self.list_end[lists[j]]
            s = e - self.list_blocks[lists[j]]
            block = s - 1 + np.searchsorted(self.first[s:e], doc, "right")
            may = score[doc] + np.where(block >= s, weight[j] * self.block_best[np.maximum(block, s)], 0) + rest[j + 1] >= floor
            doc, block = doc[may], block[may]
            need = np.unique(block[block >= s])
            if len(need):
                there, impact = self.postings(need)
                at = np.minimum(np.searchsorted(there, doc), len(there) - 1)
                score[doc] += np.where(there[at] == doc, weight[j] * impact[at], 0)
            floor = raised(score[doc])
            doc = doc[score[doc] + rest[j + 1] >= floor]
        return doc, score[doc]


def _search(sent: Broadcast, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, terms, total_docs, total_terms = sent.value
        known = pa.array(terms, pa.large_string())
        heaps: list[list[tuple]] = [[] for _ in queries]  # (-score, no id, id), best first
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(i)[at].as_py() for i, name in enumerate(batch.schema.names) if name != "doc_id"}
                row["doc_id"] = batch.column("doc_id")[at].values
                shard = Shard(row, known, total_docs, total_terms)
                for heap, (_, term, weight) in zip(heaps, queries, strict=True):
                    lists = shard.list_of[term]
                    here = (lists >= 0) & (weight > 0)
                    if not here.any():
                        continue
                    doc, score = shard.best(lists[here], weight[here], k, -heap[-1][0] if len(heap) == k else 1)
                    ids = shard.doc_id.take(pa.array(doc)).to_pylist()
                    heap += [(-s, d is None, d or 0) for s, d in zip(score.tolist(), ids, strict=True) if s > 0]
                    heap.sort()
                    del heap[k:]
        found = [(item, -s, None if none else d) for heap, (item, _, _) in zip(heaps, queries, strict=True) for s, none, d in heap]
        item, score, doc = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(doc, pa.int64())], names=["item_id", "score", "doc_id"])

    return search


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def search(index: DataFrame, items: DataFrame, k: int = TOP, query_rows: int = QUERY_ROWS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item with a score above 0."""
    spark = index.sparkSession
    context = spark.sparkContext
    asked = written(query_terms(items), "lexical-queries")
    total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    blocks, found = max(1, -(-asked.count() // query_rows)), None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "term").toArrow()
        terms = pc.unique(own.column("term")).to_pylist()
        df = dict.fromkeys(terms, 0)
        counts = index.select("terms", "df").mapInArrow(frugal(_frequencies(context.broadcast(terms))), "term string, df long")
        df.update({r["term"]: r["df"] for r in counts.groupBy("term").agg(F.sum("df").alias("df")).collect()})
        number = {t: i for i, t in enumerate(terms)}
        weight = {t: term_weight(total[0], n) for t, n in df.items()}
        queries: dict = {}
        for item, term, n in zip(*(own.column(c).to_pylist() for c in ("item_id", "term", "n")), strict=True):
            at, w = queries.setdefault(item, ([], []))
            at.append(number[term])
            w.append(n * weight[term])
        sent = context.broadcast(([(q, np.array(at, np.int64), np.array(w, np.int64)) for q, (at, w) in queries.items()], terms, total[0], max(1, total[1])))
        best = index.mapInArrow(frugal(_search(sent, k)), "item_id long, score long, doc_id long")
        found = best if found is None else found.union(best)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_frame(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(build_index(docs), items)


#: DuckDB: every score of every pair that shares a term.
OP12_SQL = r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from documents
), q as (
  select item_id, term, count(*) as qtf
  from (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) as term
        from (select distinct item_id, text from benchmark))
  group by item_id, term
), total as (select count(*) as n_all, cast(sum(len(w)) as bigint) as l_all from d where len(w) > 0
), post as (select r, doc_id, term, len(w) as n, count(*) as tf from (select r, doc_id, w, unnest(w) as term from d) group by all
), df as (select term, count(*) as df from post group by term
), weight as (select term, cast(floor(1000 * ln((2 * n_all + 2) / (2 * df + 1))) as bigint) as w from df, total
), scored as (
  select item_id, r, doc_id, cast(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_all) // l_all))))) as bigint) as score
  from q join post using (term) join weight using (term), total group by item_id, r, doc_id
), ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 10
"""
