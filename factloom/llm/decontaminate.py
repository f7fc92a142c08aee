"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Fixed masks pick token positions behind each start and ignore the others, so
a substituted word at an ignored place leaves the seed as it is.  Seeds of the
benchmark's and of the documents' tokens are joined; every hit names a
diagonal (document position less item position).  Around the hits the overlap
on the diagonal is verified: one point for each equal token, one off for each
substituted one, and the best stretch must reach ``points`` (or ``share`` of a
short item).  Items shorter than the shortest mask are found only whole, by one
hash of all their tokens.

Every mask starts with two adjacent tokens, so documents first pass a bitmap
of the benchmark's token pairs, 2**20 bits whatever the benchmark's size; it
drops only starts that cannot hit.

Defined cases: null texts and items are empty; documents and items
without a token leak nothing; equal rows are found together; null ids are kept.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, maybe_broadcast, text_or_empty

BITS = 20


@dataclass(frozen=True)
class Decontaminate:
    #: 1: the token counts; 0: it is ignored.
    masks: tuple[str, ...] = ("111111", "1101111", "1110111", "11011011", "110010111", "1100011011")
    points: int = 12
    share: float = 0.6
    broadcast_bytes: int = 32 << 20


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _seed(words: Column, i: Column, mask: str) -> Column:
    picked = [F.get(words, i + k) for k, m in enumerate(mask) if m == "1"]
    return F.xxhash64(F.lit(mask), *picked)


def _pair(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1))


def _starts(words: Column, least: int) -> Column:
    none = F.array().cast("array<int>")
    return F.when(F.size(words) >= least, F.sequence(F.lit(0), F.greatest(F.size(words) - least, F.lit(0)))).otherwise(none)


def _seeds(words: Column, starts: Column, masks: tuple[str, ...]) -> Column:
    """array<struct<at, seed>> of all masks that fit at the starts."""

    def by(mask: str, some: Column) -> Column:
        fit = F.filter(some, lambda i: i + F.lit(len(mask)) <= F.size(words))
        return F.transform(fit, lambda i: F.struct(i.alias("at"), _seed(words, i, mask).alias("seed")))

    # the starts are bound to a variable, so that they are found once and not for each mask
    return F.flatten(F.transform(F.array(starts), lambda some: F.concat(*(by(m, some) for m in masks))))


def benchmark_seeds(items: DataFrame, p: Decontaminate) -> DataFrame:
    """seed, item, item_at; ``items``: item, words."""
    words, least = F.col("words"), min(map(len, p.masks))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.coalesce(*(F.when(F.size(words) == n, _seed(words, F.lit(0), "1" * n)) for n in range(1, least))).alias("seed")))
    found = items.where(F.size(words) > 0).select("item", F.explode(F.when(F.size(words) < least, whole).otherwise(_seeds(words, _starts(words, least), p.masks))).alias("s"))
    return found.select(F.col("s.seed").alias("seed"), "item", F.col("s.at").alias("item_at")).distinct()


def pair_bitmap(items: DataFrame) -> Column:
    """A literal of the pairs' bits: 2**14 longs, however many items there are."""
    pairs = items.select(F.explode(F.transform(_starts(F.col("words"), 2), lambda i: _pair(F.col("words"), i))).alias("h"))
    bit = F.pmod("h", F.lit(1 << BITS))
    rows = pairs.groupBy(F.shiftright(bit, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {1 << BITS}) % 64 as int))")).alias("bits")).collect()
    words = [0] * (1 << (BITS - 6))
    for r in rows:
        words[r["w"]] = r["bits"]
    return F.lit(words).cast("array<bigint>")


def leaks(docs: DataFrame, benchmark: DataFrame, params: Decontaminate | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item that it leaks: doc_id, key, item_id, points, tokens (the item's)."""
    p = params or Decontaminate()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    items = cut(benchmark.select(F.col(item_col).alias("item"), tokens(text_or_empty(item_text_col)).alias("words")), "items")
    seeds = cut(benchmark_seeds(items, p), "seeds")
    bitmap, least = pair_bitmap(items), min(map(len, p.masks))
    words = F.col("words")
    lengths = sorted(r["n"] for r in items.where(F.size(words).between(1, least - 1)).select(F.size(words).alias("n")).distinct().collect())

    def passes(i: Column) -> Column:
        def is_set(bit: Column) -> Column:
            return F.get(bitmap, F.shiftright(bit, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))) != 0

        return F.exists(F.array(F.pmod(_pair(words, i), F.lit(1 << BITS))), is_set)

    split = src.select("doc_id", "key", tokens(F.col("text")).alias("words"))
    starts = F.filter(_starts(words, least), passes)
    found = split.select("doc_id", "key", F.explode(_seeds(words, starts, p.masks)).alias("s"))
    if lengths:
        at = F.concat(*(_seeds(words, _starts(words, n), ("1" * n,)) for n in lengths))
        found = found.unionByName(split.select("doc_id", "key", F.explode(at).alias("s")))
    small = maybe_broadcast(seeds, seeds.count(), 48, p.broadcast_bytes)
    hits = found.select("doc_id", "key", "s.at", "s.seed").join(small, "seed")
    diagonals = cut(hits.select("doc_id", "key", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct(), "diagonals")
    wide = diagonals.select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), "item", "diagonal")
    wide = maybe_broadcast(wide, diagonals.count(), 48, p.broadcast_bytes)
    whole = src.join(wide, (F.col("key") == F.col("hit_key")) & F.col("doc_id").eqNullSafe(F.col("hit_id")))
    there = whole.select("doc_id", "key", "item", "diagonal", tokens(F.col("text")).alias("words")).join(items.select("item", F.col("words").alias("asked")), "item")
    lo = F.greatest(F.lit(0), -F.col("diagonal"))
    hi = F.least(F.size("asked"), F.size("words") - F.col("diagonal"))
    pairs = F.arrays_zip(F.slice("asked", lo + 1, hi - lo).alias("x"), F.slice("words", lo + F.col("diagonal") + 1, hi - lo).alias("y"))
    step = lambda acc, w: F.struct(F.greatest(acc["now"] + F.when(w["x"] == w["y"], 1).otherwise(-1), F.lit(0)).alias("now"), F.greatest(acc["best"], acc["now"] + F.when(w["x"] == w["y"], 1).otherwise(-1)).alias("best"))
    points = F.aggregate(pairs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), step, lambda acc: acc["best"])
    verified = there.select("doc_id", "key", "item", F.size("asked").alias("tokens"), points.alias("points"))
    needed = F.least(F.lit(p.points), F.ceil(F.col("tokens") * p.share))
    good = verified.where(F.col("points") >= needed).groupBy("doc_id", "key", "item", "tokens").agg(F.max("points").alias("points"))
    return good.select("doc_id", "key", F.col("item").alias("item_id"), F.col("points").cast("long").alias("points"), F.col("tokens").cast("long").alias("tokens"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, params: Decontaminate | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that leak an item, all columns kept."""
    p = params or Decontaminate()
    found = cut(leaks(docs, benchmark, p, id_col, text_col).select(F.col("doc_id").alias("__fl_id"), F.col("key").alias("__fl_key")).distinct(), "leaks")
    small = maybe_broadcast(found, found.count(), 32, p.broadcast_bytes)
    key = F.xxhash64(F.col(id_col).cast("long"), text_or_empty(text_col))
    return docs.join(small, (key == F.col("__fl_key")) & F.col(id_col).cast("long").eqNullSafe(F.col("__fl_id")), "left_anti")
