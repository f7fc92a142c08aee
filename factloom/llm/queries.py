"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, license_scan, media_store, near_dedup, packing, secret_scan, suffix_dedup, token_store, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's near-duplicate class: its smallest doc_id, and how many documents it has."""
    found = near_dedup.near_classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("class_docs").cast("long").alias("class_docs"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence."""
    p = packing.Packing(public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    pieces = packing.pack(_table(spark, sf_dir, "documents"), p)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    counts = [secret_scan.count_of(F.col("spans"), k).alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined_spans(base).cast("binary"), 256).alias("base_sha256"), secret_scan.joined_spans(F.col("spans")).alias("spans"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to shards and read back."""
    p = token_store.TokenStore(public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49408)
    read = token_store.read_tokens(token_store.write_tokens(_table(spark, sf_dir, "documents"), p))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 400 bytes."""
    found = suffix_dedup.dedup(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item, one row for each pair."""
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "points", "tokens")


def op8_media_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as media, stored in chunks and read back."""
    stored = media_store.store(_table(spark, sf_dir, "documents"))
    return media_store.read_back(stored)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licenses, by name, and its license sentences in order."""
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    total = F.aggregate("matches", F.lit(0).cast("long"), lambda a, m: a + m["n"])
    return found.select("doc_id", names.alias("licenses"), total.alias("n_matches"), F.array_join("sentences", ",").alias("sentences"))


def queries() -> dict[str, Query]:
    found = (op1_near_dedup, op2_packing, op3_secret_scan, op4_url_filter, op5_token_store, op6_suffix_dedup, op7_decontamination, op8_media_store, op9_toxicity, op10_license_scan)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from factloom.llm.sql import ORACLES

    return dict(ORACLES)
