"""Media columns in a content-addressed chunk store.

A payload (bytes, zero-padded to a positive multiple of 64) becomes a WAV file
of 8-bit mono samples.  A rolling gear hash over 32 bytes cuts the file into
chunks; a chunk's name is its SHA-256.  A groupBy on the names picks one owner
for each chunk, joins tell every document which of its chunks others own, and
a second pass appends the owned chunks, compressed, to pack files in the
shared folder.  Each document's ordered chunk list, with pack, offset and
size, is a table.  Reading joins nothing but that list: it fetches the
ranges, checks every chunk's digest and the file's, and takes the samples out.

Pack files carry the attempt's own name; only those that the committed chunk
table names count, so a lost executor leaves orphans and no wrong bytes.
What is broadcast are the chunks that their document doesn't own, if their
counted rows fit a bound; beyond it the join shuffles.  Chunks that very many
rows use are few, and are broadcast to these rows instead of shuffling them.

Defined cases: a null text is empty, and an empty payload is 64 zeros; equal
rows share all chunks and are read back one by one; null ids stay null;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, digest, heavy_keys, join_split, scratch, small_batches, text_or_empty
from factloom.llm.textbytes import column_bytes, seeded

UNIT = 64
HEADER = 44


@dataclass(frozen=True)
class MediaStore:
    """Chunks have ``least`` to ``most`` bytes; a cut falls on one of ``1 << bits`` positions."""

    least: int = 512
    most: int = 16384
    bits: int = 11
    rate: int = 8000
    #: One task's pack file takes so many compressed bytes before the next is begun.
    pack_bytes: int = 256 << 20
    broadcast_bytes: int = 48 << 20


_GEAR = (seeded(256, 17) >> np.uint64(32)).astype(np.uint32)


def cut_points(data: np.ndarray, p: MediaStore) -> list[int]:
    """Ends of the chunks of ``data``.

    The gear hash of a position, sum of table[byte] << age, needs only the last
    32 bytes in 32 bits, and is built for all positions at once by doubling.
    """
    n = len(data)
    ends: list[int] = []
    last = 0
    block = 4 << 20
    for lo in range(0, n, block):  # whole payloads, however long, a block at a time
        begin = max(0, lo - 31)
        h = _GEAR[data[begin : lo + block]]
        for shift in (1, 2, 4, 8, 16):
            older = h[:-shift] << np.uint32(shift)
            h = h.copy()
            h[shift:] += older
        spots = np.flatnonzero((h[lo - begin :] >> np.uint32(32 - p.bits)) == 0) + lo + 1
        for at in spots.tolist():
            while at - last > p.most:
                last += p.most
                ends.append(last)
            if at - last >= p.least:
                ends.append(at)
                last = at
    while n - last > p.most:
        last += p.most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def wav(payload: bytes, rate: int) -> bytes:
    """8-bit unsigned mono samples in a RIFF container."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload


def samples(media: bytes) -> bytes:
    tag, _, kind, _, _, coding, channels, _, _, _, bits, _, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:HEADER])
    if (tag, kind, coding, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8) or len(media) != HEADER + n:
        raise ValueError("not an 8-bit mono WAV file")
    return media[HEADER:]


def features(payload: bytes) -> str:
    """Mean level, mean square and zero crossings about the middle (per mille), all integers, and the peak."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    n = len(x)
    return f"mean={int(x.sum()) * 1000 // n};square={int((x * x).sum()) // n};cross={crossings * 1000 // n};peak={int(np.abs(x).max())}"


def _media(batch: pa.RecordBatch, p: MediaStore) -> Iterator[tuple[int, int, bytes]]:
    data, offsets = column_bytes(batch.column("text"))
    for k in range(batch.num_rows):
        raw = data[offsets[k] : offsets[k + 1]].tobytes()
        yield k, len(raw), wav(raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), p.rate)


def _pieces(media: bytes, p: MediaStore) -> Iterator[tuple[int, int]]:
    at = 0
    for end in cut_points(np.frombuffer(media, np.uint8), p):
        yield at, end
        at = end


def _namer(p: MediaStore):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes, total = [], [0], []
            for _, n, media in _media(batch, p):
                names = [hashlib.sha256(media[a:b]).digest() for a, b in _pieces(media, p)]
                lists += names
                sizes.append(sizes[-1] + len(names))
                total.append(n)
            chunks = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(lists, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("text_id"), pa.array(total, pa.int64()), chunks], ["text_id", "n_bytes", "chunks"])

    return run


def _packer(p: MediaStore, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        squeeze = zstandard.ZstdCompressor(level=3)
        out, path, at = None, "", 0
        for batch in batches:
            others = batch.column("others").to_pylist()
            rows: list[tuple] = []
            for k, _, media in _media(batch, p):
                skip = set(others[k] or ())
                for n, (a, b) in enumerate(_pieces(media, p)):
                    if n in skip:
                        continue
                    if out is None or at >= p.pack_bytes:
                        if out is not None:
                            out.close()
                        fs.create_dir(root, recursive=True)
                        path, at = f"pack-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zst", 0
                        out = fs.open_output_stream(f"{root}/{path}", compression=None)
                    raw = squeeze.compress(media[a:b])
                    out.write(raw)
                    rows.append((hashlib.sha256(media[a:b]).digest(), f"{folder}/{path}", at, len(raw)))
                    at += len(raw)
            name, pack, offset, size = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(pack, pa.string()), pa.array(offset, pa.int64()), pa.array(size, pa.int64())], ["chunk", "pack", "offset", "size"])
        if out is not None:
            out.close()

    return run


def store(docs: DataFrame, params: MediaStore | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the payloads; one row for each row of ``docs``: doc_id, n_bytes, and ``chunks``, the ordered list.

    Only texts that differ are cut and packed.
    """
    p = params or MediaStore()
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_id", digest(F.col("text")))
    lists = cut(src.select("text_id", "text").mapInArrow(_namer(p), "text_id binary, n_bytes long, chunks array<binary>"), "lists")
    members = cut(src.select("doc_id", "text_id"), "members")
    texts = cut(lists.groupBy("text_id").agg(F.first("n_bytes").alias("n_bytes"), F.first("chunks").alias("chunks")), "texts")
    rows = texts.select("text_id", F.posexplode("chunks").alias("n", "chunk"))
    shared = cut(rows.groupBy("chunk").agg(F.min(F.struct("text_id", "n")).alias("owner"), F.count("*").alias("uses")).where("uses > 1"), "shared")
    often = cut(heavy_keys(shared, ["chunk"], "uses", rows.count()), "often")
    # where a chunk is another's, or a text another row's, it is not packed again
    mine = members.groupBy("text_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    other = join_split(rows, shared.select("chunk", "owner"), ["chunk"], often).where((F.col("owner.text_id") != F.col("text_id")) | (F.col("owner.n") != F.col("n")))
    other = other.groupBy("text_id").agg(F.collect_list("n").alias("others"))
    known = cut(mine.join(other, "text_id", "full").select(F.col("text_id").alias("known_id"), "others", "first", F.col("rows").isNotNull().alias("copied")), "known")
    size = known.agg(F.count("*").alias("n"), F.sum(F.greatest(F.size("others"), F.lit(0))).alias("m")).first()
    small = F.broadcast(known) if 64 * size["n"] + 8 * (size["m"] or 0) <= p.broadcast_bytes else known
    whole = src.join(small, F.col("text_id") == F.col("known_id"), "left")
    # of copies, the rows with the smallest id pack; equal rows with that id may each, and one location is kept
    whole = whole.where(F.coalesce(~F.col("copied"), F.lit(True)) | F.col("doc_id").eqNullSafe(F.col("first")))
    packed = cut(whole.select("text", "others").mapInArrow(_packer(p, scratch(spark, "packs")), "chunk binary, pack string, offset long, size long"), "packed")
    places = packed.groupBy("chunk").agg(F.min(F.struct("pack", "offset", "size")).alias("place"))
    found = join_split(rows, cut(places, "places"), ["chunk"], often).groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("n", "chunk", "place"))).alias("chunks"))
    table = cut(found.join(texts.select("text_id", "n_bytes"), "text_id"), "chunk-lists")
    return members.join(table, "text_id").select("doc_id", "text_id", "n_bytes", "chunks")


def _reader(p: MediaStore):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: OrderedDict = OrderedDict()
        expand = zstandard.ZstdDecompressor()

        def ranges(pack: str, offset: int, size: int) -> bytes:
            if pack not in files:
                fs, path = pafs.FileSystem.from_uri(pack)
                files[pack] = fs.open_input_file(path)
                if len(files) > 16:
                    files.popitem(last=False)[1].close()
            files.move_to_end(pack)
            files[pack].seek(offset)
            return files[pack].read(size)

        def chunk_bytes(chunks: list[dict]) -> bytes:
            """Runs of chunks that lie behind one another are fetched at once."""
            parts, k = [], 0
            while k < len(chunks):
                first = chunks[k]["place"]
                to, end = k, first["offset"]
                while to < len(chunks) and chunks[to]["place"]["pack"] == first["pack"] and chunks[to]["place"]["offset"] == end and end - first["offset"] < 8 << 20:
                    end += chunks[to]["place"]["size"]
                    to += 1
                raw = ranges(first["pack"], first["offset"], end - first["offset"])
                at = 0
                for c in chunks[k:to]:
                    piece = expand.decompress(raw[at : at + c["place"]["size"]])
                    at += c["place"]["size"]
                    if hashlib.sha256(piece).digest() != c["chunk"]:
                        raise ValueError("a stored chunk differs from its digest")
                    parts.append(piece)
                k = to
            return b"".join(parts)

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                out = []
                for n, chunks in zip(part.column("n_bytes").to_pylist(), part.column("chunks").to_pylist(), strict=True):
                    media = chunk_bytes(chunks)
                    payload = samples(media)
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), features(payload), len(chunks)))
                    if n > len(payload):
                        raise ValueError("a stored payload is too short")
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return run


def read_back(stored: DataFrame, params: MediaStore | None = None) -> DataFrame:
    """Rebuild every row's media from its chunks, verify it and describe it."""
    p = params or MediaStore()
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
    # a list is far smaller than its media, so the number of tasks is set here; neighbours in a pack stay together
    tasks = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = stored.select("doc_id", "n_bytes", "chunks", F.col("chunks")[0]["place"].alias("place"))
    spread = near.repartitionByRange(tasks, "place.pack", "place.offset", "doc_id")
    return spread.select("doc_id", "n_bytes", "chunks").mapInArrow(_reader(p), schema)
