"""From facts to names: symbols, evidence, rename maps, relationship graphs.

All operators take the table of :mod:`factloom.sources.facts`; many sources
are named at once, each on its own (``key``).  Rule tables have a size that
the program fixes, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import rules, tables
from factloom.functions.identifiers import core_name, importance, is_minified, minification_score, sequence_name
from factloom.operators import evidence, graph
from factloom.plans.scratch import cut

KEYS = ["key", "name"]
PropertyRules = Iterable[tuple[str, str, int]]


def of_kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind).drop("kind")


def symbols(facts: DataFrame) -> DataFrame:
    """key, ordinal, kind, name, line of all symbols, in the order of the walk."""
    return of_kind(facts, "symbol").select("key", "ordinal", F.col("detail").alias("kind"), "name", "line")


def frequencies(facts: DataFrame) -> DataFrame:
    return of_kind(facts, "use").groupBy(*KEYS).agg(F.count("*").alias("n"))


def _table(facts: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(facts.sparkSession.createDataFrame(rows, schema))


def shown(kind: Column) -> Column:
    """How a type is shown in a name."""
    table = F.create_map(*(F.lit(x) for pair in tables.DISPLAY.items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), kind)


def initial_names(facts: DataFrame) -> DataFrame:
    """The best initializer of each name, the first of equal ones: keys, candidate, score."""
    best = evidence.argmax(of_kind(facts, "init").select(*KEYS, F.col("detail").alias("candidate"), "score", "ordinal"), KEYS, "score", "ordinal", "candidate")
    return best.where((F.col("score") >= 4) | ~F.col("candidate").startswith("N_")).select(*KEYS, "candidate", "score")


def property_table(facts: DataFrame, extra: PropertyRules = ()) -> DataFrame:
    return _table(facts, rules.property_rules(extra), "detail string, type string, score int")


def usage_types(facts: DataFrame, extra: PropertyRules = ()) -> DataFrame:
    """The type that most votes speak for: keys, type, score.  Handlers of known events are ``<event>Handler``."""
    members = of_kind(facts, "member").drop("score").join(property_table(facts, extra), "detail").select(*KEYS, "type", "score", "ordinal")
    votes = of_kind(facts, "vote").select(*KEYS, F.col("detail").alias("type"), "score", "ordinal")
    other = F.create_map(*(F.lit(x) for pair in tables.EVENT_HANDLERS.items() for x in pair))
    events = of_kind(facts, "event").withColumn("handler", F.coalesce(F.try_element_at(other, F.col("detail")), F.concat("detail", F.lit("Handler"))))
    first = F.min(F.struct("ordinal", "handler"))
    handlers = events.groupBy(*KEYS).agg(first["handler"].alias("type"), (F.count_distinct("detail") * 9).cast("int").alias("score"), F.min("ordinal").alias("ordinal"))
    return evidence.best_type(votes.unionByName(members).unionByName(handlers), KEYS).select(*KEYS, "type", "score")


def shape_types(facts: DataFrame, extra: PropertyRules = ()) -> DataFrame:
    """The type that a name's distinct properties speak for."""
    shape = evidence.shapes(of_kind(facts, "member"), KEYS, "detail")
    table = property_table(facts, extra).withColumnRenamed("detail", "prop")
    return evidence.property_types(shape, table, KEYS, "detail")


def shape_table(facts: DataFrame, extra: Iterable[tuple] = ()) -> DataFrame:
    return _table(facts, [*rules.shape_rules(), *extra], "rule string, name string, score int, ordinal int, prop string")


def namespace_names(facts: DataFrame, extra: Iterable[tuple] = ()) -> DataFrame:
    """Names of tables of constants, by the constants that are read from them: keys, candidate, score."""
    table = _table(facts, [*rules.namespace_rules(), *extra], "rule string, name string, score int, ordinal int, required int, prop string")
    shape = evidence.shapes(of_kind(facts, "member").withColumnRenamed("name", "owner"), ["key", "owner"], "detail")
    found = evidence.namespace_matches(shape, table, ["key", "owner"], "detail")
    return found.select("key", F.col("owner").alias("name"), F.col("name").alias("candidate"), "score")


def shape_names(facts: DataFrame, shape_rules: DataFrame, kind: str = "member") -> DataFrame:
    """Names by rules on sets of properties (``rule, name, score, ordinal, prop``), of accesses or of destructuring: keys, candidate, score."""
    shape = evidence.shapes(of_kind(facts, kind).withColumnRenamed("name", "owner"), ["key", "owner"], "detail")
    found = evidence.shape_matches(shape, shape_rules, ["key", "owner"], "detail")
    return found.select("key", F.col("owner").alias("name"), F.col("name").alias("candidate"), "score")


def argument_types(facts: DataFrame) -> DataFrame:
    """Types by the place among a known function's arguments, the highest score first.

    An object's method counts as that method of any object, unless the object is known to differ.
    """
    table = _table(facts, rules.argument_rules(), "callee string, place int, type string, points int")
    method = F.concat(F.lit("."), F.substring_index("detail", ".", -1))
    callee = F.when(F.col("detail").contains(".") & ~F.col("detail").isin(*tables.OBJECT_ARGUMENTS), method).otherwise(F.col("detail"))
    hits = of_kind(facts, "arg").withColumn("callee", callee).join(table, "callee").where((F.col("place") == F.col("score")) | (F.col("place") == -1))
    return evidence.argmax(hits.select(*KEYS, "type", F.col("points").alias("score"), "ordinal"), KEYS, "score", "ordinal", "type").select(*KEYS, "type", "score")


def return_types(facts: DataFrame) -> DataFrame:
    """key, name, type of functions of which at least three fifths of the returns have one type."""
    found = evidence.dominant_type(of_kind(facts, "returns"), KEYS, "detail", "score")
    return found.select(*KEYS, F.col("detail").alias("type"))


def direct_types(facts: DataFrame) -> DataFrame:
    """Types that an assignment itself shows, also by calls of functions whose returns have one type (score 5)."""
    shown_ = of_kind(facts, "typed").select(*KEYS, F.col("detail").alias("type"), "score", "ordinal")
    functions = return_types(facts).withColumnRenamed("name", "detail")
    called = of_kind(facts, "calls").join(functions, ["key", "detail"]).select(*KEYS, "type", F.lit(5).alias("score"), "ordinal")
    return evidence.argmax(shown_.unionByName(called), KEYS, "score", "ordinal", "type").select(*KEYS, "type", "score")


def alias_types(facts: DataFrame, known: DataFrame) -> DataFrame:
    """Types carried along links between names; ``known``: keys, type, score of names that keep theirs."""
    node = F.struct("key", "name")
    links = of_kind(facts, "link").select(node.alias("lhs"), F.struct("key", F.col("detail").alias("name")).alias("alias"), "score")
    base = known.unionByName(direct_types(facts).join(known, KEYS, "left_anti"))
    reached = graph.propagate_types(links, base.select(node.alias("node"), "type", "score"))
    return reached.select("node.key", "node.name", "type", "score").join(known.select(*KEYS), KEYS, "left_anti")


def rank_identifiers(counts: DataFrame, within: list[str] | None = None, name: str = "name", places: int = 5000) -> DataFrame:
    """``counts`` (within, name, n) of names that look minified, with rank, place, rank_match, importance.

    Ranks count from 0 by falling ``n``, then name; ``place`` is the name's own
    among a minifier's first ``places`` names.  Without ``within`` the ranks are
    those of sorted ranges, so no task sorts all names.
    """
    some = counts.where(F.round(minification_score(F.col(name)), 9) > 0.4)
    if within:
        ranked = some.withColumn("rank", (F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("n"), name)) - 1).cast("long"))
    else:
        ranked = evidence.batches(some.withColumn("down", -F.col("n")), ["down", name], 1, "rank").drop("down")
    spark = counts.sparkSession
    known = spark.range(places).select(F.col("id").alias("place"), sequence_name(F.col("id")).alias("__name"))
    found = ranked.join(F.broadcast(known), F.col(name) == F.col("__name"), "left").drop("__name")
    match = F.coalesce(F.abs(F.col("place") - F.col("rank")) < 20, F.lit(False))
    return found.withColumn("rank_match", match).withColumn("importance", importance(F.col("n")))


def math_hints(facts: DataFrame) -> DataFrame:
    """Bonus and hint of a name: 3 where its rank is the minifier's, 2 or 1 for many uses, 2 or 1 for an early first place."""
    first = facts.where(F.col("kind").isin("use", "binding")).groupBy(*KEYS).agg(F.min("score").alias("at"))
    found = rank_identifiers(frequencies(facts), ["key"]).join(first, KEYS)
    level, at = F.col("importance"), F.col("at")
    many = F.when(level == "critical", 2).when(level == "high", 1).otherwise(0)
    early = F.when(at < 100, 2).when(at < 250, 1).otherwise(0)
    hint = F.when(level == "critical", "critical").when(at < 100, "core")
    bonus = F.when(F.col("rank_match"), 3).otherwise(0) + many + early
    return found.select(*KEYS, bonus.alias("bonus"), hint.alias("hint")).where("bonus > 0")


def collect_evidence(facts: DataFrame, extra: PropertyRules = (), shape_rules: DataFrame | None = None) -> DataFrame:
    """keys, phase_rank, candidate, score of all kinds of evidence, each past its own threshold."""
    ranks = evidence.PHASES
    init, usage, shape, args = initial_names(facts), usage_types(facts, extra).where("score >= 4"), shape_types(facts, extra), argument_types(facts).where("score >= 5")
    by_name = _table(facts, list(tables.NAME_TYPES.items()), "candidate string, type string")
    seeds = init.where("score >= 5").join(by_name, "candidate").select(*KEYS, "type", F.col("score").cast("double").alias("score"))
    for part, least in ((usage, 4), (shape, 4), (args, 5)):
        seeds = seeds.unionByName(part.where(F.col("score") >= least).select(*KEYS, "type", F.col("score").cast("double").alias("score")))
    known = evidence.argmax(seeds, KEYS, "score", "type")
    carried = alias_types(facts, cut(known, "known")).where("score >= 3")
    found = init.select(*KEYS, F.lit(ranks["init"]).alias("phase_rank"), "candidate", F.col("score").cast("double").alias("score"))
    for phase, part in (("usage", usage), ("prop_agg", shape), ("call_arg", args), ("alias", carried)):
        found = found.unionByName(part.select(*KEYS, F.lit(ranks[phase]).alias("phase_rank"), shown(F.col("type")).alias("candidate"), F.col("score").cast("double").alias("score")))
    shape_rules = shape_table(facts) if shape_rules is None else shape_rules
    # a table of constants stands for the initializer where it scores higher
    named = [("shape", shape_names(facts, shape_rules)), ("destruct", shape_names(facts, shape_rules, "destruct")), ("namespace", namespace_names(facts))]
    for phase, part in named:
        found = found.unionByName(part.select(*KEYS, F.lit(ranks[phase]).alias("phase_rank"), "candidate", F.col("score").cast("double").alias("score")))
    return found


def bindings(facts: DataFrame, preset: str = "rename") -> DataFrame:
    """Bound names that look minified, with the place of the first binding."""
    bound = of_kind(facts, "binding").groupBy(*KEYS).agg(F.min("ordinal").alias("ordinal"))
    return bound.where(is_minified(F.col("name"), preset))


def late_names(facts: DataFrame, bound: DataFrame, named: DataFrame) -> DataFrame:
    """``named`` (keys, ordinal, candidate, score, origin, stage) and what the names without evidence fall back on.

    A round takes for each name its first phase that can be used: its own
    late candidates (property values only where all of a name's agree), or
    ones derived from names that earlier rounds gave.  All names of a round
    change at once; rounds go on until none does, so chains of any length are followed.
    """
    late = of_kind(facts, "late").select(*KEYS, F.col("detail").alias("candidate"), F.col("score").alias("phase"), F.col("ordinal").alias("at"))
    agreed = evidence.agreed(late.where("phase = 10"), KEYS, "candidate", "at")
    own = late.where("phase <> 10").unionByName(agreed.select(*KEYS, "candidate", F.lit(10).alias("phase"), "at"))
    derive = of_kind(facts, "derive").select(*KEYS, F.split_part("detail", F.lit(" "), F.lit(1)).alias("source"), F.split_part("detail", F.lit(" "), F.lit(2)).alias("ending"), F.col("score").alias("phase"), F.col("ordinal").alias("at"))
    own, derive = (cut(x.join(bound.select(*KEYS), KEYS, "left_semi").join(named.select(*KEYS), KEYS, "left_anti"), "late") for x in (own, derive))
    for k in count(1):
        known = named.select("key", F.col("name").alias("source"), F.col("candidate").alias("told"))
        reached = derive.join(known, ["key", "source"]).select(*KEYS, F.when(F.col("ending") == "", F.col("told")).otherwise(F.concat(core_name(F.col("told")), "ending")).alias("candidate"), "phase", "at")
        first = own.unionByName(reached).join(named.select(*KEYS), KEYS, "left_anti").groupBy(*KEYS).agg(F.min(F.struct("phase", "at", "candidate"))["candidate"].alias("candidate"))
        fresh = cut(bound.join(first, KEYS).select(*KEYS, "ordinal", "candidate", F.lit(3.0).alias("score"), F.lit("late").alias("origin"), F.lit(k).alias("stage")), "late")
        if fresh.isEmpty():
            break
        named = cut(named.unionByName(fresh), "named")
    return named


def static_names(facts: DataFrame, seeds: DataFrame | None = None, least: float = 3, extra: PropertyRules = (), hints: bool = True, shape_rules: DataFrame | None = None) -> DataFrame:
    """keys, ordinal, candidate, score, origin, stage: what a source itself says about its minified bindings.

    Evidence first; names without any take what they are set to or called
    with (``late``, :func:`late_names`), then the seed (``mangled, semantic``).
    """
    facts = cut(facts, "facts")
    bound = cut(bindings(facts), "bindings")
    merged = evidence.merge_evidence(collect_evidence(facts, extra, shape_rules).join(bound.select(*KEYS), KEYS, "left_semi"), KEYS)
    table = math_hints(facts) if hints else math_hints(facts).limit(0)
    best = evidence.with_hints(merged.select(*KEYS, "candidate", "score"), table, KEYS, least).where(F.col("candidate") != F.col("name"))
    named = cut(bound.join(best, KEYS).select(*KEYS, "ordinal", "candidate", "score", F.lit("static").alias("origin"), F.lit(0).alias("stage")), "named")
    found = late_names(facts, bound, named)
    if seeds is not None:
        given = seeds.select(F.col("mangled").alias("name"), F.col("semantic").alias("candidate")).dropDuplicates(["name"])
        seeded = bound.join(found.select(*KEYS), KEYS, "left_anti").join(given, "name")
        found = found.unionByName(seeded.select(*KEYS, "ordinal", "candidate", F.lit(0.0).alias("score"), F.lit("seed").alias("origin"), F.lit(SEED_STAGE).alias("stage")))
    return found


#: Stages of names that come after all rounds of :func:`late_names`.
SEED_STAGE, NAMER_STAGE, GRAPH_STAGE = 1_000_001, 1_000_002, 1_000_003


def number_names(found: DataFrame) -> DataFrame:
    """key, mangled, semantic, confidence, origin: candidates made unique within a source, earlier stages first."""
    unique = evidence.unique_names(found, "candidate", ["stage", "ordinal", "name"], ["key"], "semantic")
    return unique.select("key", F.col("name").alias("mangled"), "semantic", F.col("score").alias("confidence"), "origin")


def rename_map(facts: DataFrame, seeds: DataFrame | None = None, least: float = 3, extra: PropertyRules = (), hints: bool = True, shape_rules: DataFrame | None = None) -> DataFrame:
    """key, mangled, semantic, confidence, origin: a new name for each minified binding that a source or a seed speaks for.

    New names are unique within a source; a name without a row is uncertain.
    """
    return number_names(static_names(facts, seeds, least, extra, hints, shape_rules))


def uncertain(facts: DataFrame, renames: DataFrame) -> DataFrame:
    """keys, n: bound minified names without a new name, and how often they are used."""
    rest = bindings(facts, "residual").join(renames.select("key", F.col("mangled").alias("name")), KEYS, "left_anti")
    return rest.join(frequencies(facts), KEYS, "left").select(*KEYS, F.coalesce("n", F.lit(0)).alias("n"))


def priorities(rest: DataFrame) -> DataFrame:
    """``rest`` (keys, n) with ``place``: from 0, each source's most used names first, then by name."""
    return rest.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "name")) - 1)


ORIGINS = ("static", "late", "seed", "llm", "graph")


def stats(facts: DataFrame, renames: DataFrame) -> DataFrame:
    """Per source: bindings, names by origin, total, uncertain, coverage in per cent.

    ``llm`` are names from a namer, ``graph`` those propagated over relationships.
    """
    by_origin = [F.count_if(F.col("origin") == o).alias(o) for o in ORIGINS]
    done = bindings(facts).join(renames.select("key", F.col("mangled").alias("name"), "origin"), KEYS, "left").groupBy("key")
    sums = done.agg(F.count("*").alias("bindings"), *by_origin, F.count("origin").alias("total"))
    return sums.withColumn("uncertain", F.col("bindings") - F.col("total")).withColumn("coverage", evidence.coverage(F.col("total"), F.col("bindings")))


def init_histogram(facts: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """key, kind, n, first, sample: how the declared variables of a source begin (those without a new name, where ``renames`` is given), with the first one's place and name."""
    declared = of_kind(facts, "decl")
    if renames is not None:
        declared = declared.join(renames.select("key", F.col("mangled").alias("name")), KEYS, "left_anti")
    return evidence.histogram(declared.withColumnRenamed("detail", "kind"), ["key", "kind"], "ordinal", "name")


def top_calls(histogram: DataFrame, k: int = 25) -> DataFrame:
    """kind, n: the functions and methods that most declared variables of all sources are called with."""
    calls = histogram.where(F.col("kind").startswith("Call:")).groupBy("kind").agg(F.sum("n").alias("n"))
    return calls.orderBy(F.desc("n"), "kind").limit(k)


def relationships(facts: DataFrame) -> DataFrame:
    """key, src, dst, weight between minified names that meet in calls and expressions."""
    pairs = of_kind(facts, "edge").where(is_minified(F.col("name"), "graph") & is_minified(F.col("detail"), "graph") & (F.col("name") != F.col("detail")))
    return pairs.groupBy("key", F.least("name", "detail").alias("src"), F.greatest("name", "detail").alias("dst")).agg(F.sum("score").alias("weight"))


def graph_names(facts: DataFrame, rest: DataFrame, named: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """Names for uncertain names near named ones: ranks, communities, seeds, a cascade and propagated names.

    ``rest``: keys; ``named``: keys, semantic (of the seeds that were named).
    Nodes are (key, name), so that all sources run in one graph.
    """
    node = F.struct("key", "name")
    edges = relationships(facts).select(F.struct("key", F.col("src").alias("name")).alias("src"), F.struct("key", F.col("dst").alias("name")).alias("dst"), "weight")
    nodes = rest.select(node.alias("node")).union(named.select(node.alias("node"))).distinct()
    heavy = cut(graph.filter_edges(edges, nodes, "node"), "edges")
    tops = cut(graph.top_seeds(graph.label_propagation(heavy), graph.pagerank(heavy), k), "seeds")
    known = named.select(node.alias("node"), F.col("semantic").alias("name")).join(tops.select("node", F.col("place").alias("ordinal")), "node")
    active = graph.independent_cascade(heavy, known, seed=seed)
    return graph.propagated_names(active, heavy, cut(known, "known")).select("node.key", F.col("node.name").alias("mangled"), F.col("name").alias("semantic"))
