"""Votes, evidence and unique names: the kernels of naming, for any keys.

Every "best of a group" is one aggregation over ordered structs, so that it is
combined before the shuffle and a hot key costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.identifiers import to_identifier
from factloom.plans.scratch import cut

#: The order in which kinds of evidence win ties.
PHASES = {"init": 1, "namespace": 2, "usage": 3, "shape": 4, "prop_agg": 5, "destruct": 6, "call_arg": 7, "alias": 8}


def argmax(df: DataFrame, keys: list[str], score: str, *ties: str) -> DataFrame:
    """The row with the highest score of each group; ties go to the smallest of ``ties``, in order."""
    rest = [c for c in df.columns if c not in keys and c != score and c not in ties]
    order = F.struct((-F.col(score)).alias("s"), *ties, *rest)
    best = df.groupBy(*keys).agg(F.min(order).alias("b"))
    cols = {score: (-F.col("b.s")).alias(score)}
    return best.select(*keys, *(cols.get(c, F.col(f"b.`{c}`")) for c in df.columns if c not in keys))


def sum_votes(votes: DataFrame, keys: list[str], kind: str = "type", score: str = "score", ordinal: str = "ordinal") -> DataFrame:
    """Votes of a kind summed up, with the first's place."""
    return votes.groupBy(*keys, kind).agg(F.sum(score).alias(score), F.min(ordinal).alias(ordinal))


def best_type(votes: DataFrame, keys: list[str], kind: str = "type", score: str = "score", ordinal: str = "ordinal") -> DataFrame:
    """The kind with the most votes of each group; ties go to the one that came first."""
    return argmax(sum_votes(votes, keys, kind, score, ordinal), keys, score, ordinal, kind)


def event_pivot(events: DataFrame, keys: list[str], event: str, handler: str, ordinal: str) -> DataFrame:
    """Event votes as one: 9 for each distinct event, named by the first event's handler."""
    first = F.min(F.struct(ordinal, handler))
    return events.groupBy(*keys).agg((F.count_distinct(event) * 9).alias("score"), first[handler].alias("handler"))


def merge_evidence(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """One candidate for each name: the highest score, then the earlier phase.

    ``evidence``: keys, phase_rank, candidate, score.
    """
    return argmax(evidence, keys, "score", "phase_rank", "candidate")


def with_hints(merged: DataFrame, hints: DataFrame, keys: list[str], least: float = 3) -> DataFrame:
    """Scores raised by the hints' bonus; rows that then fall short of ``least`` go."""
    named = merged.join(hints, keys, "left")
    score = F.col("score") + F.coalesce("bonus", F.lit(0))
    candidate = F.when((F.col("hint") == "core") & (F.col("candidate") == "fn"), "coreUtil").otherwise(F.col("candidate"))
    return named.select(*keys, candidate.alias("candidate"), score.alias("score")).where(F.col("score") >= least)


def number_in_groups(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """Numbers from 1 within each group, in order; sorted in ranges, so that a group of any size is spread."""
    placed = cut(batches(df, [*groups, *order], 1, "__rank"), "numbers")
    first = placed.groupBy(*groups).agg(F.min("__rank").alias("__first"))
    return placed.join(first, groups).withColumn(out, (F.col("__rank") - F.col("__first") + 1).cast("int")).drop("__rank", "__first")


def unique_names(df: DataFrame, base: str, order: list[str], within: list[str] | None = None, out: str = "unique_name") -> DataFrame:
    """Identifiers of at most 32 characters; in order, a row takes its base, or with ``_2``, ``_3`` … the first that no earlier row has.

    ``order`` must tell rows of one group apart.  Rows begin with their number
    among the takers of their base; where two bases then meet (``a`` numbered
    and a base ``a_2``), the earlier row stays and the later one, with those
    behind it, moves on.  That settles after as many rounds as such meetings
    follow from one another, usually one, and gives what going through the
    rows one by one gives.
    """
    keys = [*(within or []), "__clean"]
    rows = df.withColumn("__clean", F.substring(to_identifier(F.col(base)), 1, 32))
    if within:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        rows = number_in_groups(rows, keys, order, "__n")
    rows = rows.withColumns({"__at": F.col("__n"), "__root": F.regexp_replace("__clean", r"(_[0-9]+)+$", "")})
    name = F.when(F.col("__at") == 1, F.col("__clean")).otherwise(F.concat("__clean", F.lit("_"), F.col("__at").cast("string")))
    # only bases that differ by numbers can meet
    group = [*(within or []), "__root"]
    mixed = rows.select(*keys, "__root").distinct().groupBy(*group).agg(F.count("*").alias("c")).where("c > 1").select(*group)
    rows = cut(rows.join(mixed.withColumn("__mixed", F.lit(True)), group, "left"), "unique")
    done, open_ = rows.where("__mixed is null"), rows.where("__mixed")
    earlier = Window.partitionBy(*keys).orderBy("__n")
    while not open_.isEmpty():
        named = open_.withColumn(out, name)
        rank = F.struct(*order)
        kept = named.groupBy(*(within or []), out).agg(F.min(rank).alias("__kept"))
        bumped = named.join(kept, [*(within or []), out]).withColumn("__lost", F.struct(*order) != F.col("__kept"))
        moved = bumped.withColumn("__ahead", F.col("__at") + F.col("__lost").cast("int") - F.col("__n"))
        new = moved.withColumn("__at", (F.col("__n") + F.max("__ahead").over(earlier)).cast("int")).select(*open_.columns, "__lost")
        new = cut(new, "unique")
        open_ = new.drop("__lost")
        if new.where("__lost").isEmpty():
            break
    return done.unionByName(open_).withColumn(out, name).select(*df.columns, out)


def seed_fallback(names: DataFrame, seeds: DataFrame, key: str, name: str = "candidate") -> DataFrame:
    """Names, or the seed where there is none; rows with neither keep null."""
    seeded = seeds.select(F.col("mangled").alias("__k"), F.col("semantic").alias("__seed"))
    return names.join(seeded, F.col(key) == F.col("__k"), "left").withColumn(name, F.coalesce(name, "__seed")).drop("__k", "__seed")


def accept_names(raw: DataFrame, batch: DataFrame, merged: DataFrame) -> DataFrame:
    """A namer's answers that can be taken: asked for, an identifier of 3 to 60 characters, key and value new.

    ``raw``: key, value, ordinal; ``batch``: key; ``merged``: key, value.  Of
    several keys with one value the first stays.
    """
    good = raw.where(F.length("value").between(3, 60) & F.col("value").rlike(r"^[a-zA-Z_$][a-zA-Z0-9_$]*$"))
    good = good.join(batch.select("key").distinct(), "key", "left_semi").join(merged.select("key"), "key", "left_anti").join(merged.select("value"), "value", "left_anti")
    one = argmax(good.select("key", "value", "ordinal", F.lit(0).alias("zero")), ["value"], "zero", "ordinal", "key")
    return one.select("key", "value", "ordinal")


def number_suffixes(df: DataFrame, value: str, order: list[str], most: int = 9, out: str = "final") -> DataFrame:
    """``v``, ``v2`` … ``v9`` for the takers of one value; later ones go."""
    w = Window.partitionBy(value).orderBy(*order)
    numbered = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    return numbered.withColumn(out, F.when(F.col("__n") == 1, F.col(value)).otherwise(F.concat(F.col(value), F.col("__n").cast("string")))).drop("__n")


def batches(df: DataFrame, order: list[str], size: int, out: str = "batch") -> DataFrame:
    """Numbers of batches of ``size`` rows, in order.

    Ranges are sorted in parallel; only one count a range is summed up.
    """
    df = cut(df, "rows")  # sampling reads it once more
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ordered.withColumn("__id", F.monotonically_increasing_id())
    placed = placed.withColumns({"__part": F.shiftright("__id", 33), "__row": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    placed = cut(placed, "ranges")  # the ranges are sampled, so they may be drawn only once
    counts = placed.groupBy("__part").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn(out, F.floor((F.col("__start") + F.col("__row")) / size)).drop("__id", "__part", "__row", "__start")


def histogram(df: DataFrame, kinds: list[str], order: str, sample: str) -> DataFrame:
    """kinds, n, first, sample: how many rows of each kind, the first one's place and its ``sample``."""
    first = F.min(F.struct(F.col(order).alias("first"), F.col(sample).alias("sample")))
    return df.groupBy(*kinds).agg(F.count("*").alias("n"), first.alias("f")).select(*kinds, "n", "f.first", "f.sample")


def agreed(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, value, order: the value of keys all of whose rows have one value, and its first place."""
    one = df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__most"), F.min(order).alias(order))
    return one.where(F.col(value) == F.col("__most")).drop("__most")


def residual(names: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return names.join(done.select(key).distinct(), key, "left_anti")


def union_by_priority(frames: list[DataFrame], key: str, value: str) -> DataFrame:
    """Rows of several origins; the earlier origin's value wins."""
    tagged = None
    for k, f in enumerate(frames):
        part = f.select(key, value, F.lit(-k).alias("rank"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return argmax(tagged, [key], "rank", value).select(key, value, (-F.col("rank")).alias("origin"))


def coverage(named: Column, total: Column) -> Column:
    """Per cent, to one decimal."""
    return F.round(100 * named / total, 1)


def dominant_type(votes: DataFrame, keys: list[str], kind: str, weight: str, least: int = 3) -> DataFrame:
    """The kind with at least three fifths of the weight, if that is at least ``least``; ties by name."""
    sums = votes.groupBy(*keys, kind).agg(F.sum(weight).alias("w"))
    best = sums.groupBy(*keys).agg(F.min(F.struct((-F.col("w")).alias("m"), kind)).alias("b"), F.sum("w").alias("total"))
    top = -F.col("b.m")
    return best.where((5 * top >= 3 * F.col("total")) & (top >= least)).select(*keys, F.col(f"b.{kind}").alias(kind), top.alias("w"), "total")


def shapes(members: DataFrame, keys: list[str], prop: str, least: int = 2) -> DataFrame:
    """The distinct properties of each name."""
    return members.where(F.length(prop) >= least).select(*keys, prop).distinct()


def shape_matches(shape: DataFrame, rules: DataFrame, keys: list[str], prop: str, least: int = 4) -> DataFrame:
    """The best rule for each name's properties: its score times the share of its properties that are there, rounded half up.

    ``rules``: rule, name, score, ordinal, prop (one row for each property).
    """
    sizes = rules.groupBy("rule").agg(F.count("*").alias("size"))
    wide = F.broadcast(rules.join(sizes, "rule").withColumnRenamed("prop", prop))
    hits = shape.join(wide, prop).groupBy(*keys, "rule", "name", "score", "ordinal", "size").agg(F.count("*").alias("hits"))
    raw = F.col("score") * F.col("hits") / F.col("size")
    scored = hits.withColumn("raw", raw).where(F.col("raw") >= least)
    best = argmax(scored.select(*keys, "name", "raw", "ordinal"), keys, "raw", "ordinal", "name")
    return best.select(*keys, "name", F.floor(F.col("raw") + 0.5).alias("score"))


def namespace_matches(shape: DataFrame, rules: DataFrame, keys: list[str], prop: str) -> DataFrame:
    """The best rule with as many of its properties there as it requires (column ``required``)."""
    hits = shape.join(F.broadcast(rules.withColumnRenamed("prop", prop)), prop).groupBy(*keys, "rule", "name", "score", "ordinal", "required").agg(F.count("*").alias("hits"))
    return argmax(hits.where("hits >= required").select(*keys, "name", "score", "ordinal"), keys, "score", "ordinal", "name")


def property_types(shape: DataFrame, rules: DataFrame, keys: list[str], prop: str, cap: float = 9, least: float = 3) -> DataFrame:
    """The type that a name's properties speak for: scores summed by type, lowered for few hits, capped.

    ``rules``: prop, type, score.  The number of hits is over all types.
    """
    hits = shape.join(F.broadcast(rules.withColumnRenamed("prop", prop)), prop)
    sums = hits.groupBy(*keys, "type").agg(F.sum("score").alias("s"), F.count("*").alias("c"))
    best = sums.groupBy(*keys).agg(F.min(F.struct((-F.col("s")).alias("m"), "type")).alias("b"), F.sum("c").alias("hits"))
    factor = F.when(F.col("hits") >= 3, 1.0).when(F.col("hits") == 2, 0.85).otherwise(0.65)
    return best.select(*keys, F.col("b.type").alias("type"), F.least(-F.col("b.m") * factor, F.lit(cap)).alias("score")).where(F.col("score") >= least)
