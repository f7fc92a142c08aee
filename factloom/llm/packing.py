"""Cost-balanced packing of tokenised documents into sequences.

A sequence's estimated cost is ``linear * tokens + quadratic * sum(piece**2)``:
attention runs within pieces.  Each task streams its documents into bins of a
bounded number of tokens.  A bin of T tokens is given T // length sequences and
powers of two for the rest, so that nothing is padded; full-length cuts of long
documents take whole sequences, and the remaining pieces, longest first, go to
the sequence of the lowest cost that still has room for them.  A piece that
fits nowhere is cut at the widest room left.

No row is shuffled, and a task holds one bin and one document's ids.

Defined cases: a null text is empty and becomes the single end id; null ids
stay null; equal rows are packed once each; tasks without rows give none.
Input must be deterministic by partition (a file scan, or a cut table) for a
retried task to repeat its sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import small_batches, text_or_empty
from factloom.llm.encode import append_id, encoder
from factloom.llm.textbytes import column_bytes, trim

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, sequence_cost double"


@dataclass(frozen=True)
class Packing:
    tokenizer: str
    end_id: int = 1
    length: int = 2048
    linear: float = 1.0
    quadratic: float = 1.0 / 2048
    bin_tokens: int = 2048 * 1024


def room(tokens: int, length: int) -> np.ndarray:
    """Sequence lengths that hold exactly ``tokens``: full ones and powers of two."""
    whole, rest = divmod(tokens, length)
    powers = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return np.array([length] * whole + powers, np.int64)


def assign(sizes: np.ndarray, p: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Pieces (document, start, length, sequence, offset) as rows, and the sequences' costs."""
    left = room(int(sizes.sum()), p.length)
    full, cost, used = left.copy(), np.zeros(len(left)), 0
    out: list[tuple[int, int, int, int, int]] = []

    def price(n: int) -> float:
        return p.linear * n + p.quadratic * n * n

    def put(doc: int, start: int, n: int, seq: int) -> None:
        out.append((doc, start, n, seq, int(full[seq] - left[seq])))
        left[seq] -= n
        cost[seq] = cost[seq] + price(n) if left[seq] else np.inf
        total[seq] += price(n)

    total = np.zeros(len(left))
    for doc in np.flatnonzero(sizes >= p.length).tolist():
        for start in range(0, int(sizes[doc]) - p.length + 1, p.length):
            put(doc, start, p.length, used)
            used += 1
    rest = sizes % p.length
    for doc in np.argsort(-rest, kind="stable").tolist():
        n, start = int(rest[doc]), int(sizes[doc] - rest[doc])
        while n:
            fits = np.where(left >= n, cost, np.inf)
            seq = int(fits.argmin())
            if fits[seq] == np.inf:
                seq = int(left.argmax())
            take = min(n, int(left[seq]))
            put(doc, start, take, seq)
            n, start = n - take, start + take
    return np.array(out, np.int64).reshape(-1, 5), total


def _packer(p: Packing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(p.tokenizer)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 33
        names: list = []
        parts: list[np.ndarray] = []
        sizes: list[int] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            if not sizes:
                return
            size = np.array(sizes, np.int64)
            pieces, cost = assign(size, p)
            widths = room(int(size.sum()), p.length)
            ids = np.concatenate(parts)
            begin = np.concatenate(([0], np.cumsum(size)[:-1]))
            ident = pa.concat_arrays(names)
            for k in range(0, len(pieces), 4096):
                doc, start, n, seq, offset = pieces[k : k + 4096].T
                ends = np.cumsum(n)
                flat = ids[np.repeat(begin[doc] + start - (ends - n), n) + np.arange(ends[-1])]
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.concatenate(([0], ends)) * 4).astype(np.int32)), pa.py_buffer(flat.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([ident.take(pa.array(doc)), pa.array(start), pa.array(n), raw, pa.array(size[doc]), pa.array(sequence + seq), pa.array(offset), pa.array(widths[seq]), pa.array(cost[seq])], names=[x.split()[0] for x in SCHEMA.split(", ")])
            sequence += len(widths)
            names.clear(), parts.clear(), sizes.clear()
            held = 0

        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            at = 0
            while at < batch.num_rows:  # a bin's worth of text at a time
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + p.bin_tokens, "right")) - 1)
                to = min(to, batch.num_rows)
                ids, ends = append_id(*enc.encode(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]), p.end_id)
                names.append(batch.column("doc_id").slice(at, to - at))
                parts.append(ids)
                sizes += np.diff(ends).tolist()
                held += len(ids)
                at = to
                if held >= p.bin_tokens:
                    yield from flush()
        yield from flush()
        trim()

    return run


def pack(docs: DataFrame, params: Packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece; ``ids`` are its token ids, little-endian unsigned 32-bit."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return src.mapInArrow(_packer(params), SCHEMA)
