"""Token ids in bit-plane files: blocks of ids, transposed into planes, each compressed.

A file holds the documents of one range of doc_id, in ascending order. The ids are cut into
blocks of BLOCK ids (the last may be shorter); a block's ids are transposed into 32 bit planes
or 4 byte planes, planes of zeros alone are left out, and each other plane is compressed with
zstandard. Behind the blocks stand the chunk index (ids, bytes and crc32 of each plane), the
document index (doc_id, ids) and a footer, so that a reader can seek to any block.

    magic | planes ... | index (zstd) | index length, 8 bytes | magic

Tasks write whole files under names of their own; the manifest, which the job commits last,
names those of the tasks that succeeded, so a task that is run again leaves no trace.

Defined results: a null text counts as empty; each document ends with the end id; rows are
ordered by doc_id (nulls first), then by a hash of the text; an empty table gives no files
and an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, partitions, shared_folder, text_groups
from .tokens import encoder, vocabulary

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
END_ID = 2
#: Text that is encoded at a time.
GROUP_BYTES = 6 << 20
VOCABULARY = "byte_bpe_50k.json"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The 32 bit planes or 4 byte planes of ``ids`` (lowest first); b"" for a plane of zeros."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [p.tobytes() if p.any() else b"" for p in np.ascontiguousarray(raw.T)]
    bits = np.unpackbits(raw, axis=1, bitorder="little").T
    return [np.packbits(p, bitorder="little").tobytes() if p.any() else b"" for p in bits]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    raw = np.zeros((4, n), np.uint8)
    if kind == "byte":
        for i, p in enumerate(planes):
            if p:
                raw[i] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((32, n), np.uint8)
        for i, p in enumerate(planes):
            if p:
                bits[i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        raw = np.packbits(bits.T, axis=1, bitorder="little").T
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


class FileWriter:
    """Ids in, blocks out; holds one block."""

    def __init__(self, out, kind: str = "byte", level: int = 3):
        self.out, self.kind = out, kind
        self.squeeze = zstandard.ZstdCompressor(level=level)
        self.held, self.n_held = [], 0
        self.blocks, self.doc_ids, self.sizes = [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            flat = np.concatenate(self.held)
            whole = len(flat) // BLOCK * BLOCK
            for s in range(0, whole, BLOCK):
                self._block(flat[s:s + BLOCK])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = [(self.squeeze.compress(p), zlib.crc32(p)) if p else (b"", 0) for p in to_planes(ids, self.kind)]
        for data, _ in planes:
            self.out.write(data)
        self.blocks.append((len(ids), [len(d) for d, _ in planes], [c for _, c in planes]))

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        index = self.squeeze.compress(pickle.dumps({"kind": self.kind, "blocks": self.blocks, "doc_ids": self.doc_ids, "sizes": np.array(self.sizes, np.int64)}))
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()


class FileReader:
    """Blocks of a file by number, and its documents in order."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a plane file, or cut short")
        n = int.from_bytes(tail[:8], "little")
        file.seek(size - 16 - n)
        index = pickle.loads(zstandard.ZstdDecompressor().decompress(file.read(n)))
        self.kind, self.blocks, self.doc_ids, self.sizes = index["kind"], index["blocks"], index["doc_ids"], index["sizes"]
        lengths = [sum(b[1]) for b in self.blocks]
        self.at = (np.cumsum([0, *lengths]) + len(MAGIC)).tolist()

    def block(self, i: int) -> np.ndarray:
        n, sizes, crcs = self.blocks[i]
        self.file.seek(self.at[i])
        unpack, planes = zstandard.ZstdDecompressor(), []
        for size, crc in zip(sizes, crcs, strict=True):
            p = unpack.decompress(self.file.read(size)) if size else b""
            if size and zlib.crc32(p) != crc:
                raise ValueError(f"block {i} is damaged")
            planes.append(p)
        return from_planes(planes, n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids), one block at a time."""
        held, nxt, start = np.empty(0, np.uint32), 0, 0
        for doc_id, size in zip(self.doc_ids, self.sizes.tolist(), strict=True):
            parts = [held]
            have = len(held)
            while have < size:
                parts.append(self.block(nxt))
                have += len(parts[-1])
                nxt += 1
            flat = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, start, flat[:size]
            held, start = flat[size:], start + size


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")


def _write(folder: str, path: str, end_id: int, kind: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, end = TaskContext.get().partitionId(), np.array([end_id], np.uint32)
        name, writer = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.idp", None
        encode = encoder(path, False).encode
        for table in text_groups(batches, 1, GROUP_BYTES):
            flat, at = encode(table.column(1))
            for i, doc_id in enumerate(table.column(0).to_pylist()):
                if writer is None:
                    system, where = _open(name)
                    writer = FileWriter(system.open_output_stream(where), kind)
                writer.add(doc_id, np.concatenate((flat[at[i]:at[i + 1]], end)))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([name]), pa.array([len(writer.sizes)]), pa.array([int(sum(writer.sizes))])], names=["part", "file", "n_docs", "n_ids"])

    return write


def write_token_files(docs: DataFrame, folder: str, name: str = VOCABULARY, end_id: int = END_ID, kind: str = "byte") -> None:
    """Encode every text and write the files and their manifest to the shared ``folder``."""
    if kind not in ("bit", "byte"):
        raise ValueError(f"kind {kind!r}: bit or byte")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    manifest = ordered.mapInArrow(frugal(_write(folder, vocabulary(name), end_id, kind)), "part int, file string, n_docs long, n_ids long")
    manifest.write.parquet(f"{folder}/manifest")


def _read(digest: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, where = _open(file)
                with system.open_input_file(where) as f:
                    rows = []
                    for doc_id, start, ids in FileReader(f).documents():
                        ids = np.ascontiguousarray(ids, "<u4")
                        rows.append((doc_id, before + start, len(ids), zlib.crc32(ids.tobytes()), None if digest else ids.astype(np.int64)))
                        if len(rows) >= 2000:
                            yield _rows(rows, digest)
                            rows = []
                    if rows:
                        yield _rows(rows, digest)

    return read


def _rows(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if not digest:
        arrays.append(pa.array(list(cols[4]), pa.list_(pa.int64())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def read_token_files(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, unless ``digest``, ids of every document of the files.

    The manifest has one row per file, of which there are as many as the writing job had partitions.
    """
    files = sorted((r["part"], r["file"], r["n_ids"]) for r in spark.read.schema("part int, file string, n_docs long, n_ids long").parquet(f"{folder}/manifest").collect())
    starts = np.cumsum([0, *[f[2] for f in files]]).tolist()
    rows = [(i, f[1], starts[i]) for i, f in enumerate(files)]
    table = spark.createDataFrame(rows, "i int, file string, before long").repartitionById(max(1, len(rows)), F.col("i")).select("file", "before")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest else ", ids array<long>")
    return table.mapInArrow(frugal(_read(digest)), schema)


def op4_frame(docs: DataFrame) -> DataFrame:
    folder = shared_folder(docs.sparkSession, "token-files")
    write_token_files(docs, folder)
    return read_token_files(docs.sparkSession, folder, digest=True)
