"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.scratch import ARROW_ROWS, cut, scratch

__all__ = ["cut", "digest", "heavy_keys", "join_split", "maybe_broadcast", "scratch", "small_batches", "text_or_empty"]

#: Rows in one Arrow batch of whole texts; the default of 10,000 long texts would not fit a worker.
TEXT_BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size to ``TEXT_BATCH_ROWS`` unless it is lower already."""
    now = int(spark.conf.get(ARROW_ROWS, "10000"))
    if now <= 0 or now > TEXT_BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(TEXT_BATCH_ROWS))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def digest(text: Column) -> Column:
    """The first 16 bytes of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int, limit_bytes: int) -> DataFrame:
    """Broadcast ``df`` only if its counted rows fit ``limit_bytes``; else let the join shuffle."""
    return F.broadcast(df) if rows * row_bytes <= limit_bytes else df


#: A key with more rows than this, or than one in ``HEAVY_SHARE`` of all, is heavy.
HEAVY_ROWS, HEAVY_SHARE = 1_000_000, 2000


def heavy_keys(counts: DataFrame, on: list[str], weight: str, total: int, rows: int = HEAVY_ROWS, share: int = HEAVY_SHARE) -> DataFrame:
    """The keys whose ``weight``, their number of rows, is heavy: ``share`` of them at most, or one for each ``rows`` of all ``total`` rows."""
    return counts.where(F.col(weight) > max(1, min(rows, total // share))).select(*on)


def join_split(rows: DataFrame, keys: DataFrame, on: list[str], heavy: DataFrame) -> DataFrame:
    """``rows`` joined with ``keys``, one row a key: heavy keys are broadcast, so that their rows stay where they are; the others are shuffled to."""
    heavy = F.broadcast(heavy)
    light = rows.join(heavy, on, "left_anti").join(keys, on)
    return light.unionByName(rows.join(F.broadcast(keys.join(heavy, on, "left_semi")), on))
