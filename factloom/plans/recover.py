"""The whole run over many sources: lay out, rename, split, index, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import namer as asking
from factloom.operators import naming
from factloom.operators import text as texts
from factloom.plans.scratch import cut
from factloom.sources import files
from factloom.sources.beautify import beautify
from factloom.sources.facts import facts

VERSION = "1.0"


@dataclass(frozen=True)
class Options:
    """``namer``: asked about what stays uncertain (nobody is, if not given), in batches of ``batch``, ``passes`` times; ``most`` bounds the names of a source.

    ``graph``: names are passed on between related names at the end, from ``graph_seeds`` names of each community.
    """

    least: float = 3
    indent: int = 2
    hints: bool = True
    properties: tuple[tuple[str, str, int], ...] = ()
    namer: Callable[[str], str] | None = None
    batch: int = 40
    passes: int = 1
    most: int | None = None
    graph: bool = False
    graph_seeds: int = 3


@dataclass(frozen=True)
class Recovered:
    pretty: DataFrame
    renamed: DataFrame
    renames: DataFrame
    stats: DataFrame
    modules: DataFrame
    symbols: DataFrame
    report: DataFrame


def rename_texts(sources: DataFrame, renames: DataFrame) -> DataFrame:
    """key, text with every source's own new names put in; sources without any stay as they are.

    The names of a source are gathered in one map beside its text: both are bounded by the text's length.
    """
    pairs = renames.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("mangled", "semantic"))).alias("names"))
    word = r"[A-Za-z_$][A-Za-z0-9_$]*"
    found = sources.select("key", "text").join(pairs, "key", "left")
    new = F.transform(texts.identifiers(F.col("text")), lambda w: F.coalesce(F.try_element_at("names", w), w))
    pieces = F.zip_with(F.split("text", word, -1), new, lambda gap, w: F.concat(gap, F.coalesce(w, F.lit(""))))
    return found.select("key", F.when(F.col("names").isNull(), F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"))


def name_all(found: DataFrame, sources: DataFrame, seeds: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """The rename map (:func:`naming.rename_map`) from all that there is: the sources themselves, seeds, the namer, the graph.

    Each is asked only about what those before it left open.
    """
    named = cut(naming.static_names(found, seeds, options.least, options.properties, options.hints), "static")
    bound = naming.bindings(found, "residual").select("key", "name", "ordinal")

    def add(named: DataFrame, more: DataFrame, origin: str, stage: int) -> DataFrame:
        new = more.join(named.select("key", "name"), ["key", "name"], "left_anti").join(bound, ["key", "name"])
        rows = new.select("key", "name", "ordinal", "candidate", F.lit(0.0).alias("score"), F.lit(origin).alias("origin"), F.lit(stage).alias("stage"))
        return cut(named.unionByName(rows), origin)

    if options.namer is not None:
        rest = naming.uncertain(found, named.select("key", F.col("name").alias("mangled")))
        answers = asking.name_rest(rest, sources, options.namer, options.batch, options.passes, options.most)
        named = add(named, answers.select("key", "name", "candidate"), "llm", naming.NAMER_STAGE)
    if options.graph:
        renames = cut(naming.number_names(named), "renames")
        rest = naming.uncertain(found, renames).select("key", "name")
        known = renames.select("key", F.col("mangled").alias("name"), "semantic")
        told = naming.graph_names(found, rest, known, options.graph_seeds)
        named = add(named, told.select("key", F.col("mangled").alias("name"), F.col("semantic").alias("candidate")), "graph", naming.GRAPH_STAGE)
    return naming.number_names(named)


def recover(sources: DataFrame, seeds: DataFrame | None = None, options: Options = Options(), tool: str = "factloom") -> Recovered:
    """All results for ``sources`` (key, text); names are mined from the text as it is, and put into the laid-out text."""
    began = datetime.now(timezone.utc)
    found = cut(facts(sources, "key", "text"), "facts")
    renames = cut(name_all(found, sources, seeds, options), "renames")
    stats = cut(naming.stats(found, renames), "stats")
    pretty = beautify(sources, "text", options.indent, "text").select("key", "text")
    renamed = cut(rename_texts(pretty, renames), "renamed")
    modules = cut(texts.extract_modules(renamed, "key", "text"), "modules")
    symbols = cut(naming.symbols(facts(renamed, "key", "text")), "symbols")
    passes = ["beautify", "rename", "split", "index"]
    report = files.report(sources, renames, modules, symbols, tool, VERSION, passes, began)
    return Recovered(pretty, renamed, renames, stats, modules, symbols, report)


def benchmark(sources: DataFrame, seeds: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """One row over all sources: bindings, names by origin, total, uncertain, coverage of the names alone, nothing written."""
    found = cut(facts(sources, "key", "text"), "facts")
    each = naming.stats(found, name_all(found, sources, seeds, options))
    sums = each.agg(*(F.sum(c).alias(c) for c in ("bindings", *naming.ORIGINS, "total", "uncertain")))
    return sums.withColumn("coverage", F.round(100 * F.col("total") / F.col("bindings"), 1))
