"""Analyses of the identifiers of sources, by the name of a task; each takes sources (key, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import identifiers as ids
from factloom.operators import graph, naming, text


def frequencies(sources: DataFrame) -> DataFrame:
    """key, name, n: how often each identifier occurs."""
    return text.tokens(sources, "key", "text").groupBy("key", "name").agg(F.count("*").alias("n"))


def positions(sources: DataFrame) -> DataFrame:
    """key, name, score: 1 for an identifier whose first place is the text's start, near 0 for the end."""
    each = sources.select("key", "text", F.explode(F.array_distinct(text.identifiers(F.col("text")))).alias("name"))
    first = F.call_function("locate", F.col("name"), F.col("text")) - 1
    return each.select("key", "name", ids.positional_score(first, F.length("text")).alias("score"))


def entropies(sources: DataFrame) -> DataFrame:
    """key, name, entropy: bits a character of each identifier."""
    return frequencies(sources).select("key", "name", ids.entropy(F.col("name")).alias("entropy"))


def cooccurrences(sources: DataFrame) -> DataFrame:
    """a, b, n: how often two identifiers stand near one another, over all sources."""
    return graph.cooccurrence(text.tokens(sources, "key", "text"), "key", "ordinal", "name")


def ranks(sources: DataFrame) -> DataFrame:
    """key, name, n, rank, place, rank_match, importance of the names that look minified, in each source."""
    return naming.rank_identifiers(frequencies(sources), ["key"])


TASKS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "frequencyMap": frequencies,
    "positional": positions,
    "entropy": entropies,
    "cooccurrence": cooccurrences,
    "rank": ranks,
}


def run_task(name: str, sources: DataFrame) -> DataFrame:
    if name not in TASKS:
        raise ValueError(f"unknown task {name!r}; known are {', '.join(TASKS)}")
    return TASKS[name](sources)
