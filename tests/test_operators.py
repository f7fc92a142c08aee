"""Behaviour of the operators on small fixtures: ties, collisions, splitting, propagation."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import identifiers as ids
from factloom.functions import rules, tables
from factloom.operators import evidence, graph, text

BUNDLE = "var a=R(()=>{x={y:1}});var b = R(() => { function q(){} });"
BANNERS = "let z;\n// node_modules/chalk/source/index.js\nvar c=1;\n// node_modules/commander/index.js\nvar d=2;"
MARKED = "(function(){ /*0*/ a(); /*1*/ b(); /***/ /* 2 */ c(); "


def sources(spark):
    return spark.createDataFrame([(1, BUNDLE), (2, BANNERS), (3, MARKED), (4, "console.log(1);"), (5, None)], "k int, t string")


def test_formats_and_modules(spark):
    df = sources(spark)
    kinds = {r["k"]: r["f"] for r in df.select("k", ids.detect_format(F.coalesce("t", F.lit(""))).alias("f")).collect()}
    assert kinds == {1: "copilot", 2: "esbuild", 3: "webpack4", 4: "unknown", 5: "unknown"}
    found = {}
    for r in text.extract_modules(df, "k", "t").orderBy("k", "ordinal").collect():
        found.setdefault(r["k"], []).append((r["name"], r["code"]))
    assert [n for n, _ in found[1]] == ["a", "b"] and found[1][0][1] == "var a=R(()=>{x={y:1}})"
    assert [n for n, _ in found[2]] == ["chunk_0", "chalk_source_index.js", "commander_index.js"]
    assert "".join(c for _, c in found[2]) == BANNERS
    assert [n for n, _ in found[3]] == ["module_0", "module_1", "module_2", "module_3"]


def test_scalars(spark):
    row = spark.range(1).select(
        ids.strip_shebang(F.lit("#!/usr/bin/env node\nconst x = 1;")).alias("a"),
        ids.line_count(F.lit("a\nb\nc")).alias("b"),
        ids.line_count(F.lit("")).alias("c"),
        ids.symbol_key_name(F.lit("undici.error.UND_ERR_CONNECT_TIMEOUT")).alias("d"),
        ids.string_literal_name(F.lit("Connect Timeout Error")).alias("e"),
        ids.core_name(F.lit("parserMod_2")).alias("f"),
        ids.entropy(F.lit("")).alias("g"),
        ids.slug_name(F.array(F.lit("ab"), F.lit("fix-pr-comment"), F.lit("xx-yy-zz-comme"))).alias("h"),
        ids.context_lines(F.lit("x\n  ab = 1;\ny"), F.lit("ab"), 1).alias("i"),
    ).first()
    assert row["a"] == "const x = 1;" and row["b"] == 3 and row["c"] == 1
    assert row["d"] == "sym_errConnectTimeout" and row["e"] == "connectTimeoutErrorMsg" and row["f"] == "parser"
    assert row["g"] == 0 and row["h"] == "fixPrComment" and row["i"] == "ab = 1;"


def test_renames_leave_unknown_tokens(spark):
    df = spark.createDataFrame([(1, "var ab = 1; var abcd = ab.constructor"), (2, ""), (3, None)], "k int, t string")
    names = spark.createDataFrame([("ab", "CMD_INIT")], "mangled string, semantic string")
    got = {r["k"]: r["renamed"] for r in text.apply_renames(df, "k", "t", names).collect()}
    assert got == {1: "var CMD_INIT = 1; var abcd = CMD_INIT.constructor", 2: "", 3: None}
    same = spark.createDataFrame([(1, "ab x"), (1, "ab y"), (None, "z ab"), (None, None)], "k int, t string")
    for rows in (200_000, 0):  # with the map broadcast, and not
        found = sorted((str(r["k"]), str(r["renamed"])) for r in text.apply_renames(same, "k", "t", names, broadcast_rows=rows).collect())
        assert found == [("1", "CMD_INIT x"), ("1", "CMD_INIT y"), ("None", "None"), ("None", "z CMD_INIT")]


def test_argmax_ties_and_unique_names(spark):
    votes = spark.createDataFrame([("x", "array", 3, 2), ("x", "string", 5, 1), ("x", "array", 2, 3)], "name string, type string, score int, ordinal int")
    assert evidence.best_type(votes, ["name"]).first()["type"] == "string"
    names = spark.createDataFrame([(1, "a b"), (2, "a_b"), (3, "x" * 40), (4, "x" * 33)], "id int, base string")
    got = [r["unique_name"] for r in evidence.unique_names(names, "base", ["id"]).orderBy("id").collect()]
    assert got == ["a_b", "a_b_2", "x" * 32, "x" * 32 + "_2"]


def one_by_one(bases):
    taken, out = set(), []
    for base in bases:
        name, k = base, 1
        while name in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name)
        out.append(name)
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["a", "a_2", "a_3", "a_2_2", "b", "b_2", "a_4"]), min_size=1, max_size=30))
def test_unique_names_are_those_of_one_by_one(spark, bases):
    rows = spark.createDataFrame([(g, k, b) for g in (1, 2) for k, b in enumerate(bases)], "g int, id int, base string")
    for within in (["g"], None):
        part = rows if within else rows.where("g = 1")
        got = {}
        for r in evidence.unique_names(part, "base", ["id"], within).collect():
            got.setdefault(r["g"], {})[r["id"]] = r["unique_name"]
        assert all(list(dict(sorted(names.items())).values()) == one_by_one(bases) for names in got.values())


def test_two_names_never_become_one(spark):
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_2")], "id int, base string")
    got = [r["unique_name"] for r in evidence.unique_names(names, "base", ["id"]).orderBy("id").collect()]
    assert got == ["a", "a_2", "a_2_2"]


def test_tables_are_whole():
    sizes = {"INSTANCE_TYPES": 50, "TYPEOF_TYPES": 8, "SHAPES": 59, "NAMESPACES": 29, "ALIAS_PROPERTIES": 87, "MEMBER_CALLS": 77, "METHOD_RESULTS": 56, "SCHEMA_METHODS": 49,
             "MEMBER_NAMES": 104, "GLOBAL_ALIASES": 32, "CLASS_ROLES": 32, "ERROR_CLASSES": 8, "SURE_CLASSES": 17, "GLOBAL_CALLS": 8, "SWITCH_WORDS": 6, "FUNCTION_ARGUMENTS": 18}
    assert {k: len(getattr(tables, k)) for k in sizes} == sizes
    assert len(rules.EVENTS) == 68 and 2 * len(tables.MODULES) + len(tables.MODULE_PATHS) == 58
    assert all(len(v) <= 200 for v in vars(tables).values() if isinstance(v, (dict, tuple)))
    assert len(tables.METHOD_ARGUMENTS) + len(tables.ALL_ARGUMENTS) == 51


def test_connected_clusters_follow_chains(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")] + [(f"m{k:02}", f"m{k + 1:02}") for k in range(40)]
    matrix = spark.createDataFrame([(x, y, 5) for a, b in pairs for x, y in ((a, b), (b, a))] + [("d", "x", 4)], "a string, b string, n int")
    got = {r["name"]: r["cluster"] for r in graph.connected_clusters(matrix).collect()}
    assert got == {**dict.fromkeys("abcd", "a"), "x": "x", "y": "x"} | {f"m{k:02}": "m00" for k in range(41)}
    assert graph.connected_clusters(matrix.where("n > 9")).count() == 0


def test_batches_are_dense(spark):
    df = spark.range(0, 1000, 1, 7)
    got = sorted((r["batch"], r["n"]) for r in evidence.batches(df, ["id"], 64).groupBy("batch").agg(F.count("*").alias("n")).collect())
    assert got == [(b, 64 if b < 15 else 40) for b in range(16)]


def test_propagation_runs_to_the_end_of_a_chain(spark):
    links = spark.createDataFrame([(f"v{k}", f"v{k + 1}", 9 - k % 3) for k in range(27)], "lhs string, alias string, score int")
    base = spark.createDataFrame([("v27", "map", 8)], "node string, type string, score int")
    got = {r["node"]: (r["type"], r["score"]) for r in graph.propagate_types(links, base).collect()}
    assert len(got) == 28 and got["v0"] == ("map", 7)


def test_pagerank_of_a_sink_and_empty_graph(spark):
    edges = spark.createDataFrame([("a", "b", 2)], "src string, dst string, weight int")
    got = {r["node"]: r["rank"] for r in graph.pagerank(edges).collect()}
    assert abs(got["a"] - 0.075) < 1e-9 and abs(got["b"] - (0.075 + 0.85 * 0.075)) < 1e-9
    assert graph.pagerank(edges.where("weight > 9")).count() == 0


def test_greedy_clusters_take_free_neighbours(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d")]
    matrix = spark.createDataFrame([(x, y, 5) for a, b in pairs for x, y in ((a, b), (b, a))], "a string, b string, n int")
    got = {r["name"]: r["cluster"] for r in graph.greedy_clusters(matrix).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c"}


def test_propagated_names_take_suffixes_in_turn(spark):
    edges = spark.createDataFrame([("a", x, 3) for x in "bcdefgh"], "src string, dst string, weight int")
    active = spark.createDataFrame([(x,) for x in "bcdefg"], "node string")
    named = spark.createDataFrame([("a", "parser", 1)], "node string, name string, ordinal int")
    got = {r["node"]: r["name"] for r in graph.propagated_names(active, edges, named).collect()}
    assert got == {x: "parser" + graph.SUFFIXES[k % 5] for k, x in enumerate("bcdefg")}
