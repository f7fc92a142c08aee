"""An extension: the operators on streams.  New sources become facts once; windows count late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions.identifiers import strip_shebang
from factloom.operators.text import tokens
from factloom.sources.facts import facts


def stream_sources(spark: SparkSession, folder: str) -> DataFrame:
    """key (the path), text of files as they arrive."""
    files = spark.readStream.option("wholetext", True).format("text").load(folder)
    return files.select(F.col("_metadata.file_path").alias("key"), strip_shebang(F.col("value")).alias("text"))


def write_facts(sources: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Facts of every new source, appended as Parquet; ``once``: what is there now, then the query ends."""
    writer = facts(sources, "key", "text").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows by window and key; on a stream, rows later than ``late`` no longer count."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def token_counts(sources: DataFrame) -> DataFrame:
    """Running counts of identifiers, for complete or update output."""
    return tokens(sources, "key", "text").groupBy("name").agg(F.count("*").alias("n"))
