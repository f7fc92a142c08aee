"""Token ids in files of fixed-width bit packing.

A vocabulary of V ids takes ``bits = (V - 1).bit_length()`` bits an id.  A
shard file is

    magic "FLTB1\\0" | u16 bits | u32 ids a block
    blocks: each ceil(ids * bits / 8) bytes, ids in little-endian bit order
    u64 x (blocks + 1): byte offsets of the blocks
    i64 x docs: ids | u8 x docs: id is null | i64 x docs: number of tokens
    u64 docs | u64 ids | u64 byte offset of the block offsets

so that a reader can fetch any block, or any document, alone and unpack it with
numpy.  Shards hold ascending ids (null ids first; equal ids by text hash), a
range of ids each, and are written straight to the shared folder.  Every
attempt of a task writes a file of its own name; the manifest, a table that
Spark commits, names those that count, so lost executors leave only orphans.

Defined cases: a null text is empty and holds only the end id; equal rows are
stored once each; an empty table gives no shards.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, scratch, small_batches, text_or_empty
from factloom.llm.encode import append_id, encoder
from factloom.llm.textbytes import column_bytes

MAGIC = b"FLTB1\0"
HEAD = struct.Struct("<6sHI")
TAIL = struct.Struct("<QQQ")


@dataclass(frozen=True)
class TokenStore:
    tokenizer: str
    end_id: int = 2
    vocabulary: int = 49408
    block: int = 1 << 16

    @property
    def bits(self) -> int:
        return max(1, (self.vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_ids(raw: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class ShardWriter:
    """Writes ids block by block; holds at most a block, the counts and the offsets."""

    def __init__(self, file, bits: int, block: int):
        self.file, self.bits, self.block = file, bits, block
        self.rest, self.offsets, self.counts, self.names, self.total = np.zeros(0, np.uint32), [HEAD.size], [], [], 0
        file.write(HEAD.pack(MAGIC, bits, block))

    def _put(self, ids: np.ndarray) -> None:
        raw = pack_ids(ids, self.bits)
        self.file.write(raw)
        self.offsets.append(self.offsets[-1] + len(raw))

    def add(self, names: list, counts: np.ndarray, ids: np.ndarray) -> None:
        self.names += names
        self.counts.append(counts)
        self.total += len(ids)
        self.rest = np.concatenate((self.rest, ids))
        whole = len(self.rest) // self.block * self.block
        for k in range(0, whole, self.block):
            self._put(self.rest[k : k + self.block])
        self.rest = self.rest[whole:].copy()

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        f = self.file
        f.write(np.array(self.offsets, "<u8").tobytes())
        f.write(np.array([0 if x is None else x for x in self.names], "<i8").tobytes())
        f.write(np.array([x is None for x in self.names], np.uint8).tobytes())
        f.write((np.concatenate(self.counts) if self.counts else np.zeros(0)).astype("<i8").tobytes())
        f.write(TAIL.pack(len(self.names), self.total, self.offsets[-1]))
        f.close()


class ShardReader:
    """Random access to a shard: ``ids(a, b)`` reads only the blocks that it needs."""

    def __init__(self, file):
        self.file = file
        magic, self.bits, self.block = HEAD.unpack(self._at(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        size = file.size() if callable(getattr(file, "size", None)) else file.seek(0, io.SEEK_END)
        self.docs, self.total, index = TAIL.unpack(self._at(size - TAIL.size, TAIL.size))
        blocks = -(-self.total // self.block)
        raw = self._at(index, size - TAIL.size - index)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1).astype(np.int64)
        at = 8 * (blocks + 1)
        self.names = np.frombuffer(raw, "<i8", self.docs, at)
        self.null = np.frombuffer(raw, np.uint8, self.docs, at + 8 * self.docs).astype(bool)
        self.starts = np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<i8", self.docs, at + 9 * self.docs))))

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(int(offset))
        return self.file.read(int(size))

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        raw = self._at(self.offsets[first], self.offsets[last + 1] - self.offsets[first])
        out = []
        for k in range(first, last + 1):
            n = min(self.block, self.total - k * self.block)
            lo = int(self.offsets[k] - self.offsets[first])
            out.append(unpack_ids(raw[lo : lo + int(self.offsets[k + 1] - self.offsets[k])], n, self.bits))
        return np.concatenate(out)[a - first * self.block : b - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def _writer(p: TokenStore, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, path = encoder(p.tokenizer), None, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                task = TaskContext.get()
                fs, root = pafs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                path = f"shard-{task.partitionId():06d}-{uuid.uuid4().hex}.fltb"
                out = ShardWriter(fs.open_output_stream(f"{root}/{path}", compression=None), p.bits, p.block)
            data, offsets = column_bytes(batch.column("text"))
            ids, ends = append_id(*enc.encode(data, offsets), p.end_id)
            out.add(batch.column("doc_id").to_pylist(), np.diff(ends), ids)
        if out is not None:
            out.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int64()), "path": [f"{folder}/{path}"], "docs": pa.array([len(out.names)], pa.int64()), "tokens": pa.array([out.total], pa.int64())})

    return run


def write_tokens(docs: DataFrame, params: TokenStore, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards and return the manifest: shard, path, docs, tokens, start (ids in earlier shards)."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    # the range of an id may not depend on its text's size; ties of an id are spread by the text's hash
    ordered = src.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    manifest = cut(ordered.mapInArrow(_writer(params, scratch(spark, "tokens")), "shard long, path string, docs long, tokens long"), "manifest")
    # one row a shard, so one task can sum them up
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = pafs.FileSystem.from_uri(row["path"])
            with fs.open_input_file(path) as f:
                shard = ShardReader(f)
                at = 0
                while at < shard.docs:
                    to = int(np.searchsorted(shard.starts, shard.starts[at] + (1 << 20), "right")) - 1
                    to = min(max(to, at + 1), shard.docs)
                    lo = int(shard.starts[at])
                    raw = shard.ids(lo, int(shard.starts[to])).astype("<u4")
                    parts = [raw[shard.starts[k] - lo : shard.starts[k + 1] - lo].tobytes() for k in range(at, to)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(shard.names[at:to], mask=shard.null[at:to]),
                        "start": pa.array(row["start"] + shard.starts[at:to]),
                        "n_tokens": pa.array(np.diff(shard.starts[at : to + 1])),
                        "ids": pa.array(parts, pa.binary()),
                    })
                    at = to


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) from the files of a manifest."""
    shards = max(1, manifest.count())
    spread = manifest.select("path", "start").repartition(shards)
    return spread.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary")


def crc32(raw: bytes) -> int:
    return zlib.crc32(raw)
