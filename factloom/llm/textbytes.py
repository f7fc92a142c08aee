"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Everything here runs in numpy over one buffer that holds many texts, so that
no Python object is made for a word or a shingle.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that one vectorised step works on, unless a single text is longer.
CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C55 | 1
_P_INV = pow(_P, -1, 1 << 64)


def trim() -> None:
    """Give freed memory back to the system, where the C library can: workers live on after a task."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash (xor-shift-multiply), on a copy."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0xD1342543DE82EF95 % (1 << 64)))


_BYTE = seeded(256, 1)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, U), "i": np.ones(1, U)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base = np.full(max(n, 2 * len(have), 1 << 16), _P if which == "p" else _P_INV, U)
        base[0] = 1
        have = _powers[which] = np.cumprod(base, dtype=U)
    return have


class Rolling:
    """Hashes of any byte ranges of one buffer, by prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _BYTE):
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        values = table[data]
        values *= _power("p", n + 1)[:n]
        np.cumsum(values, out=self.sums[1:])
        self.inverse = _power("i", n + 1)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        h += (ends - starts).astype(U) * U(0x94D049BB133111EB)
        return mix(h)

    def windows(self, width: int) -> np.ndarray:
        """The hash of each range of ``width`` bytes, by its start."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, U)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each text's offsets in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK, most: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``size`` bytes, ``most`` texts at most, as ranges of their indexes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), at + most, n)
        yield at, to
        at = to


def runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], member, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the index of its text.

    A word is a run of ASCII letters or digits or any non-ASCII characters.
    Lower-casing is the caller's.
    """
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    is_word = _WORD[data]
    found, owners = [], []
    for a, b in chunks(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        # a word must not run over the end of its text: cut at each text's first byte
        starts, ends = runs(is_word[lo:hi])
        cuts = offsets[a + 1 : b] - lo
        inside = cuts[(cuts > 0) & (cuts < hi - lo)]
        inside = np.unique(inside[is_word[lo:hi][inside] & is_word[lo:hi][inside - 1]]) if len(inside) else inside
        if len(inside):
            starts, ends = np.sort(np.concatenate((starts, inside))), np.sort(np.concatenate((ends, inside)))
        found.append(Rolling(data[lo:hi]).ranges(starts, ends))
        owners.append(np.searchsorted(offsets, starts + lo, "right") - 1)
    return np.concatenate(found), np.concatenate(owners)


def shingles(hashes: np.ndarray, owner: np.ndarray, texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of ``size`` words and its text; a shorter text is one run."""
    counts = np.bincount(owner, minlength=texts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    n = len(hashes)
    total = np.zeros(n, U)
    salt = seeded(size, 7)
    place = np.arange(n) - first[owner] if n else np.zeros(0, np.int64)
    left = counts[owner] - place if n else place
    for k in range(size):
        reach = left > k
        total[reach] += hashes[np.flatnonzero(reach) + k] * salt[k]
    keep = (left >= size) | (place == 0)
    return mix(total[keep]), owner[keep]
