"""Removal of repeated byte strings by column-wise sorting of many strings' suffixes.

A byte goes if a string of ``length`` (400) bytes covers it that also starts
anywhere else.  Inserting one symbol of every whole document each round would
take as many rounds as the longest document has bytes, each over the whole
transform.  So the collection is first brought into short strings:

1. Each window of ``length`` bytes names the smallest hash among its grams of
   ``gram`` bytes (its anchor); equal windows have equal anchors at equal
   places.  Neighbouring windows with one anchor form a block, a string of
   less than 2 * length bytes, and each window lies in exactly one block.
2. Blocks whose anchor's hash occurs once are done.  Equal blocks count as
   one string that occurs several times; all its windows repeat.
3. Where an anchor has several strings and one of them occurs once, the
   strings, aligned at the anchor, are a collection: one symbol of each is
   inserted every round, from the last column to the first.  The symbols in
   the order of the suffixes are the transform's segment of that round; its
   stable order by symbol is the next order (the transform's own mapping), and
   the common prefix of two neighbours is one more than the least between the
   two in the last round.  A window repeats if its suffix has ``length`` bytes
   in common with a neighbour.
4. Collections over ``hot`` strings are split until none is left, so that a
   task never holds more.  The starts of windows, counted from the anchor, lie
   in a range; all windows of a range hold the same bytes in the middle.  Half
   the range has a longer middle, and strings that differ there part.  Strings
   that are equal wherever the range reaches, if more than ``hot``, repeat in
   the whole range; one of them stays for the others.

The arrays of a collection stay in memory, some thousand strings a step; the
external files of the sequential method are Spark's own tables and shuffles.
No join meets all rows of a frequent key in one task: keys with many rows, of
which there can only be few, are broadcast.

Defined cases: a null text is empty; equal rows are different places, so a row
of 400 bytes or more with an equal row is removed as a whole; null ids stay
null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import HEAVY_SHARE, cut, heavy_keys, join_split, maybe_broadcast, small_batches, text_or_empty
from factloom.llm.textbytes import U, Rolling, chunks, column_bytes, trim

PAD = 256
_LOW = U((1 << 24) - 1)


@dataclass(frozen=True)
class SuffixDedup:
    length: int = 400
    gram: int = 200
    #: Larger collections are split.
    hot: int = 20_000
    #: Keys with more than one row in so many are broadcast, not shuffled to.
    heavy_share: int = HEAVY_SHARE
    #: Strings that a step sorts at once, unless one collection has more.
    step: int = 8_000
    chunk: int = 1 << 20
    broadcast_bytes: int = 48 << 20


def least_positions(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the position of the smallest, the first of equal ones."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.int64)
    key = (hashes & ~_LOW) | np.arange(n, dtype=U)
    full = np.full(-(-n // width) * width, ~U(0))
    full[:n] = key
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & _LOW).astype(np.int64)


def blocks(data: np.ndarray, offsets: np.ndarray, p: SuffixDedup) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text, start, bytes, anchor less start, anchor's hash, digest as two numbers) of the blocks of all texts."""
    spans: list[tuple[int, int, np.ndarray]] = []  # first text, first byte, ends of the texts in reach
    for a, b in chunks(offsets, p.chunk):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b - a > 1 or hi - lo <= 2 * p.chunk:
            spans.append((a, lo, offsets[a + 1 : b + 1]))
        else:  # one long text: windows of a part at a time
            for at in range(lo, max(lo + 1, hi - p.length + 1), p.chunk):
                spans.append((a, at, np.array([min(hi, at + p.chunk + p.length - 1)])))
    for first, lo, ends in spans:
        part = data[lo : int(ends[-1])]
        if len(part) < p.length:
            continue
        hashes = Rolling(part).windows(p.gram)
        at = least_positions(hashes, p.length - p.gram + 1)
        bounds = np.concatenate(([lo], ends)) - lo
        start = np.arange(len(at))
        owner = np.searchsorted(bounds, start, "right") - 1
        valid = start + p.length <= bounds[owner + 1]
        begin = valid.copy()
        begin[1:] &= ~(valid[:-1] & (at[1:] == at[:-1]) & (owner[1:] == owner[:-1]))
        s = np.flatnonzero(begin)
        if not len(s):
            continue
        stop = np.flatnonzero(valid & np.append(begin[1:] | ~valid[1:], True))
        size = stop - s + p.length
        view = memoryview(part)
        names = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(s.tolist(), (s + size).tolist(), strict=True)]), "<i8").reshape(-1, 2)
        own = owner[s]
        yield own + first, s - bounds[own] + (lo - offsets[own + first] if len(ends) == 1 else 0), size, at[s] - s, hashes[at[s]].view(np.int64), names[:, 0], names[:, 1]


def repeats(matrix: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For each string (row of symbols, ``PAD`` outside) the columns at which a string of ``length`` symbols starts that another of its group has there.

    ``group`` is ascending.  Symbols are inserted column by column, the last
    first; ``order`` holds the strings by group and by suffix, ``transform``
    the symbols before these suffixes, ``common`` the common prefix of each
    suffix with the one before.
    """
    n, width = matrix.shape
    found = np.zeros((n, width - length + 1), bool)
    order = np.arange(n)
    common = np.zeros(n, np.int32)
    for column in range(width - 1, -1, -1):
        transform = matrix[order, column].astype(np.int64)
        key = group[order] * (PAD + 1) + transform
        move = np.argsort(key, kind="stable")
        key = key[move]
        same = np.zeros(n, bool)
        same[1:] = (key[1:] == key[:-1]) & (transform[move][1:] != PAD)
        new = np.zeros(n, np.int32)
        at = np.flatnonzero(same)
        if len(at):
            low, high = move[at - 1] + 1, move[at]
            reach = high - low + 1
            table, span = common, 1
            least = np.empty(len(at), np.int32)
            while True:  # the least of a range from two ranges of a power of two
                pick = (reach >= span) & (reach < 2 * span)
                least[pick] = np.minimum(table[low[pick]], table[high[pick] - span + 1])
                if 2 * span > reach.max():
                    break
                table = np.minimum(table[: len(table) - span], table[span:])
                span *= 2
            new[at] = least + 1
        order, common = order[move], new
        if column <= width - length:
            hit = np.flatnonzero(common >= length)
            found[order[hit], column] = True
            found[order[hit - 1], column] = True
    return found


def _blocker(p: SuffixDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for part in blocks(data, offsets, p):
                row, start, size, off, h, t1, t2 = (np.asarray(x, np.int64) for x in part)
                cols = (k1[row], k2[row], (start << 20) | (size << 10) | off, h, t1, t2)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["k1", "k2", "place", "h", "t1", "t2"])
        trim()

    return run


def _fetcher(p: SuffixDedup):
    """The strings' bytes, from (text, k1, k2, wanted: places, h, t1, t2, n, kinds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k1, k2, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "wanted")), strict=True):
                raw = text.encode()
                for w in wanted:
                    start, size = w["place"] >> 20, w["place"] >> 10 & 1023
                    rows.append((k1, k2, w["place"], w["h"], w["t1"], w["t2"], w["n"], w["kinds"], raw[start : start + size]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.int64()] * 8 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["k1", "k2", "place", "h", "t1", "t2", "n", "kinds", "bytes"])

    return run


def _columns(p: SuffixDedup, rows: list[dict]) -> Iterator[dict]:
    """The repeated windows of the strings that occur once, as ranges of starts in their text."""
    before = p.length - p.gram
    matrix = np.full((len(rows), before + p.length), PAD, np.uint16)
    for k, r in enumerate(rows):
        col = before - (r["place"] & 1023)
        matrix[k, col : col + len(r["bytes"])] = np.frombuffer(r["bytes"], np.uint8)
    numbers = {}
    group = np.array([numbers.setdefault((r["h"], r["core"]), len(numbers)) for r in rows])
    found = repeats(matrix, group, p.length)
    for k in np.flatnonzero(found.any(1)).tolist():
        r = rows[k]
        if r["n"] > 1:
            continue
        shift = (r["place"] >> 20) + (r["place"] & 1023) - before
        edge = np.flatnonzero(np.diff(np.concatenate(([0], found[k].view(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            yield {"k1": r["k1"], "k2": r["k2"], "start": a + shift, "end": b - 1 + shift + p.length}


_RANGE = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _sorter(p: SuffixDedup):
    """Collections arrive one after the other (sorted by anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if len(held) >= p.step and (held[-1]["h"], held[-1]["core"]) != (r["h"], r["core"]):
                    yield pa.RecordBatch.from_pylist(list(_columns(p, held)), _RANGE)
                    held = []
                held.append(r)
        if held:
            yield pa.RecordBatch.from_pylist(list(_columns(p, held)), _RANGE)

    return run


_PART = "k1 long, k2 long, place long, n long, bytes binary, low int, high int, h long, core long"


def _reach(p: SuffixDedup, place: int, size: int, low: int, high: int) -> tuple[int, int]:
    """The starts, counted from the anchor, of a string's windows in a range (none if the first is above the second)."""
    off = place & 1023
    return max(low, -off), min(high, size - off - p.length)


def _trimmer(p: SuffixDedup):
    """Adds the digest of all bytes that windows of the row's range cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for place, raw, low, high in zip(*(batch.column(c).to_pylist() for c in ("place", "bytes", "low", "high")), strict=True):
                a, b = _reach(p, place, len(raw), low, high)
                off = place & 1023
                names.append(xxhash.xxh3_128_digest(raw[off + a : off + b + p.length]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], [*batch.schema.names, "trim"])

    return run


def _halver(p: SuffixDedup):
    """Each string once for each half of its range in which it has windows, with the hash of the bytes that all of them hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                out = []
                for r in batch.slice(lo, 4096).to_pylist():
                    middle, off = (r["low"] + r["high"]) // 2, r["place"] & 1023
                    for low, high in ((r["low"], middle), (middle + 1, r["high"])) if r["low"] < r["high"] else ():
                        a, b = _reach(p, r["place"], len(r["bytes"]), low, high)
                        if a <= b:
                            core = xxhash.xxh3_64_intdigest(r["bytes"][off + high : off + low + p.length], seed=(high + p.length) * 1024 + low + p.length) >> 1
                            out.append(r | {"low": low, "high": high, "core": core})
                yield pa.RecordBatch.from_pylist(out, batch.schema)

    return run


def split_collections(rows: DataFrame, p: SuffixDedup) -> tuple[DataFrame, list[DataFrame]]:
    """Strings in collections (h, core) of at most ``hot``, and spans found on the way.

    ``rows``: the strings of larger ones, as ``_PART`` names their columns.
    What is broadcast are collections and equal strings of more than ``hot`` rows each.
    """
    key, ready, spans = ["h", "core", "low", "high"], [], []
    while True:
        large = F.broadcast(rows.groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") > p.hot).select(*key))
        ready.append(rows.join(large, key, "left_anti"))
        rows = cut(rows.join(large, key, "left_semi").select(*rows.columns).mapInArrow(_trimmer(p), f"{_PART}, trim binary"), "large")
        if rows.isEmpty():
            break
        equal = F.broadcast(cut(rows.groupBy(*key, "trim").agg(F.count("*").alias("c")).where(F.col("c") > p.hot).select(*key, "trim"), "equal"))
        same = rows.join(equal, [*key, "trim"], "left_semi")
        off, start = F.col("place").bitwiseAND(F.lit(1023)), F.shiftright("place", 20)
        first, last = F.greatest("low", -off), F.least(F.col("high"), F.length("bytes") - off - p.length)
        spans.append(same.where("n = 1").select("k1", "k2", (start + off + first).alias("start"), (start + off + last + p.length).alias("end")))
        one = same.groupBy(*key, "trim").agg(F.min(F.struct("k1", "k2", "place", "bytes")).alias("r")).select("r.*", F.lit(2).cast("long").alias("n"), *key)
        rest = rows.join(equal, [*key, "trim"], "left_anti").unionByName(one, allowMissingColumns=True)
        rows = cut(rest.select("k1", "k2", "place", "n", "bytes", "low", "high", "h", "core").mapInArrow(_halver(p), _PART), "halves")
    found = ready[0]
    for more in ready[1:]:
        found = found.unionByName(more)
    return found, spans


def repeated_spans(docs: DataFrame, p: SuffixDedup) -> DataFrame:
    """(k1, k2, spans): for each text (by its digest in two numbers) the maximal spans that go; ``docs``: text, k1, k2."""
    found = cut(docs.select("text", "k1", "k2").mapInArrow(_blocker(p), "k1 long, k2 long, place long, h long, t1 long, t2 long"), "blocks")
    twice = cut(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "anchors")
    total = found.count()

    def weighed(rows: DataFrame, keys: DataFrame, on: list[str], weight: str) -> DataFrame:
        return join_split(rows, keys, on, heavy_keys(keys, on, weight, total, share=p.heavy_share))

    some = cut(weighed(found, twice, ["h"], "c").drop("c"), "candidates")
    strings = some.groupBy("h", "t1", "t2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("rep"))
    strings = cut(strings, "strings")
    groups = cut(strings.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("h", "kinds"), "groups")
    wanted = cut(weighed(strings, groups, ["h"], "kinds").select("h", "kinds", "t1", "t2", "n", "rep.*"), "wanted")
    spans = weighed(some, strings.where("n > 1").select("h", "t1", "t2", "n"), ["h", "t1", "t2"], "n")
    start, size = F.shiftright("place", 20), F.shiftright("place", 10).bitwiseAND(F.lit(1023))
    spans = spans.select("k1", "k2", start.alias("start"), (start + size).alias("end"))
    count = wanted.count()
    if count:
        by_text = wanted.groupBy(F.col("k1").alias("q1"), F.col("k2").alias("q2")).agg(F.collect_list(F.struct("place", "h", "t1", "t2", "n", "kinds")).alias("wanted"))
        keyed = docs.select("text", "k1", "k2")
        joined = keyed.join(maybe_broadcast(by_text, count, 112, p.broadcast_bytes), (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2")))
        strings_ = joined.select("k1", "k2", "text", "wanted").mapInArrow(_fetcher(p), "k1 long, k2 long, place long, h long, t1 long, t2 long, n long, kinds long, bytes binary")
        # copies of a text give the same strings; one of each is enough, and a string that occurs once comes once
        strings_ = cut(strings_.dropDuplicates(["h", "t1", "t2"]).withColumns({"low": F.lit(p.gram - p.length), "high": F.lit(0), "core": F.lit(0).cast("long")}), "contexts")
        columns = ["k1", "k2", "place", "n", "bytes", "low", "high", "h", "core"]
        collections = strings_.where(F.col("kinds") <= p.hot).select(*columns)
        hot = strings_.where(F.col("kinds") > p.hot).select(*columns)
        if not hot.isEmpty():
            parts, ranges = split_collections(hot, p)
            collections = collections.unionByName(parts)
            for more in ranges:
                spans = spans.unionByName(more)
        order = ["h", "core"]
        spans = spans.unionByName(collections.repartition(*order).sortWithinPartitions(*order).mapInArrow(_sorter(p), "k1 long, k2 long, start long, end long"))
    listed = spans.distinct().groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return listed.mapInArrow(_merger, "k1 long, k2 long, spans array<struct<start:long,end:long>>")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and adjacent spans, in order, become one."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            out = []
            for spans in part.column("spans").to_pylist():
                merged: list[dict] = []
                for s in spans:
                    if merged and s["start"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                    else:
                        merged.append(s)
                out.append(merged)
            yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), pa.array(out, _SPANS)], ["k1", "k2", "spans"])


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column_bytes(batch.column("text"))
        spans = [x or [] for x in batch.column("spans").to_pylist()]
        kept = []
        for k, gone in enumerate(spans):
            raw, parts, at = data[offsets[k] : offsets[k + 1]].tobytes(), [], 0
            for s in gone:
                parts.append(raw[at : s["start"]])
                at = s["end"]
            kept.append(b"".join([*parts, raw[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def dedup(docs: DataFrame, params: SuffixDedup | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed, maximal, in bytes) and kept (the bytes left) for every row."""
    p = params or SuffixDedup()
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # a text is named by 120 bits of its digest, as two numbers
    name = F.sha2(F.col("text").cast("binary"), 256)
    src = src.withColumns({"k1": F.conv(F.substring(name, 1, 15), 16, 10).cast("long"), "k2": F.conv(F.substring(name, 16, 15), 16, 10).cast("long")})
    spans = cut(repeated_spans(src, p), "spans")
    keys = spans.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), "spans")
    size = keys.agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("m")).first()
    keys = F.broadcast(keys) if 48 * size["n"] + 24 * (size["m"] or 0) <= p.broadcast_bytes else keys
    joined = src.join(keys, (F.col("k1") == F.col("q1")) & (F.col("k2") == F.col("q2")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(_remover, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
