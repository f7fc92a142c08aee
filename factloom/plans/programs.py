"""Registered queries over small programs that are built from the parts table, and their SQL.

A family is a program and what should come of it, both as expressions over
``part`` that either engine can run; every part has a program of each family.
Rows of a rule table are taken in turn, so that all of them are reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import identifiers as ids
from factloom.functions import rules, tables
from factloom.operators import graph, namer, naming, text
from factloom.plans import recover, tasks
from factloom.plans.catalog import _EDGES, _ENTROPY, _NAME, _PLACES, _SCORE, _programs, _query, _t, _trade
from factloom.sources import files
from factloom.sources.facts import facts, of_texts
from factloom.sources.initializers import CAST, VERB, lower_first

A, B = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"


def up(x: str) -> str:
    return f"upper(substr({x}, 1, 1)) || substr({x}, 2)"


UA, UB = up(A), up(B)
AB = f"{A} || {UB}"
Family = tuple[str, ...]


def lit(x: object) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def pick(values: list, quote: bool = True) -> str:
    """One of the values in turn, by the part's number."""
    cases = " ".join(f"WHEN {k} THEN {lit(v) if quote else v}" for k, v in enumerate(values))
    return f"(CASE p_partkey % {len(values)} {cases} END)"


def nth(values: list) -> str:
    """As ``pick``, for Spark: a look-up instead of a chain of cases."""
    return f"get(array({', '.join(map(lit, values))}), CAST(p_partkey % {len(values)} AS INT))"


def table(rows: dict | list, before: str, after: str, name, score, key=lambda k: k) -> Family:
    """A family for the rows of a table: the key between two texts, the name and score of each."""
    rows = list(rows.items()) if isinstance(rows, dict) else [(r, r) for r in rows]
    told = pick([name(k, v) for k, v in rows])
    return (f"{lit(before)} || {nth([key(k) for k, _ in rows])} || {lit(after)}", told, pick([score(k, v) for k, v in rows], False))


def sources(spark: SparkSession, sf_dir: str, families: list[Family]) -> DataFrame:
    """key, text: the programs of all families; a key is a part's number times a hundred and the family's.

    A small table is one partition, however many programs it makes, so parts are dealt first, with the words that all families take.
    """
    words = {UA: "ua", UB: "ub", A: "a", B: "b"}

    def program(f: Family) -> str:
        told = f[0]
        for long, short in words.items():
            told = told.replace(long, short)
        return told

    each = F.array(*(F.struct(F.lit(k).alias("k"), F.expr(program(f)).alias("text")) for k, f in enumerate(families)))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", *(F.expr(e).alias(n) for e, n in words.items()))
    return part.repartition(tasks).select("p_partkey", F.explode(each).alias("f")).select((F.col("p_partkey") * 100 + F.col("f.k")).alias("key"), "f.text")


def expected(families: list[Family], *names: str) -> str:
    columns = lambda f: ", ".join(f"{e} AS {n}" for e, n in zip(f[1:], names, strict=True))
    parts = [f"SELECT p_partkey * 100 + {k} AS key, {columns(f)} FROM part" for k, f in enumerate(families)]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE {names[0]} IS NOT NULL"


def _plain_calls(rows: dict) -> dict:
    """Calls that no pattern of verbs or casts names before."""
    return {k: v for k, v in rows.items() if not VERB.match(k.split(".")[-1]) and not CAST.match(k.split(".")[-1])}


_sure = lambda k, v: lower_first(k)
_NEVER = "CAST(NULL AS VARCHAR(9))"
INITIALIZERS: list[Family] = [
    (f"'var zq=\"/' || {A} || '\";'", f"'CMD_' || upper({A})", "10"),
    (f"'var zq=\"' || upper({A}) || '_' || upper({B}) || '\";'", f"'K_' || upper({A}) || '_' || upper({B})", "8"),
    (f"'var zq=\"' || {A} || '-' || {B} || '\";'", f"'K_' || {A} || '_' || {B}", "7"),
    (f"'var zq=\"Bad ' || {A} || ' ' || {B} || ' error\";'", f"'bad' || {UA} || {UB} || 'Msg'", "6"),
    ("'var zq=\"?\";'", "'str'", "3"),
    ("'var zq=' || CAST(p_size AS VARCHAR(9)) || ';'", _NEVER, "3"),
    ("'var zq=!0;'", "'boolVal'", "5"),
    ("'var zq=/a+/g;'", "'rePattern'", "5"),
    table(list(tables.SURE_CLASSES), "var zq=new ", "();", _sure, lambda k, v: 9),
    (f"'var zq=new ' || {UA} || 'Store();'", f"{A} || 'StoreInst'", "5"),
    (f"'var zq=class ' || {UA} || '{{}};'", f"{A} || 'Class'", "8"),
    ("'var zq=class{};'", "'classDef'", "7"),
    ("'var zq=[];'", "'items'", "4"),
    ("'var zq={};'", "'config'", "4"),
    (f"'var zq={{' || {A} || ':1,b:2}};'", f"'obj_' || {A}", "6"),
    (f"'var zq=require(\"x/' || {A} || '-' || {B} || '\");'", f"'mod_' || substr({A} || '_' || {B}, 1, 20)", "9"),
    (f"'var zq=Symbol.for(\"' || {A} || '.the.' || {B} || '\");'", f"'sym_' || {AB}", "9"),
    (f"'var zq=Symbol(\"' || {A} || '\");'", f"'sym_' || {A}", "9"),
    ("'var zq=Symbol();'", "'symbolKey'", "8"),
    table(tables.GLOBAL_CALLS, "var zq=", "(cc);", lambda k, v: v[0], lambda k, v: v[1]),
    (f"'var zq=get' || {UA} || '();'", A, "8"),
    (f"'var zq=cc.load' || {UB} || '();'", B, "8"),
    (f"'var zq=cc.to' || {UB} || '();'", B, "7"),
    table(_plain_calls(tables.MEMBER_CALLS), "var zq=", "(cc);", lambda k, v: v, lambda k, v: 8),
    table(_plain_calls(tables.METHOD_RESULTS), "var zq=cc.", "(dd);", lambda k, v: v[0], lambda k, v: v[1]),
    (f"'var zq=cc.extend({{' || {A} || ':1}});'", f"{A} || 'Schema'", "7"),
    ("'var zq=cc.union([dd]);'", "'unionSchema'", "6"),
    ("'var zq=cc.nullable();'", "'nullableSchema'", "5"),
    (f"'var zq=cc.memo(({{' || {A} || 'Name,' || {B} || 'Name}})=>1);'", f"substr({A} || 'Name' || {UB} || 'Name', 1, 24) || 'Comp'", "7"),
    (f"'var zq=cc(\"' || {UA} || {UB} || '\");'", f"{AB} || 'Def'", "7"),
    (f"'var zq=cc(\"' || {A} || '.' || {B} || '\");'", f"{A} || '_' || {B} || 'Val'", "5"),
    (f"'var zq=cc({{' || {A} || ':1}});'", f"{A} || 'Config'", "5"),
    ("'var zq=cc([1,2]);'", "'arrayDef'", "3"),
    (f"'var zq=cc(/' || {A} || {B} || '/);'", f"substr({A} || {B}, 1, 16) || 'Regex'", "4"),
    table(list(tables.SURE_CLASSES), "var zq=cc.", ";", _sure, lambda k, v: 9),
    (f"'var zq=cc.' || {UA} || {UB} || ';'", f"{AB} || 'Ref'", "6"),
    table(tables.MEMBER_NAMES, "var zq=cc.", ";", lambda k, v: v, lambda k, v: 5),
    (f"'var zq=cc.' || {AB} || ';'", AB, "7"),
    table(tables.GLOBAL_ALIASES, "var zq=", ";", lambda k, v: v, lambda k, v: 7),
    ("'var zq=-1;'", "'negNum'", "4"),
    ("'var zq=~cc;'", "'bitwise'", "4"),
    ("'var zq=+cc;'", "'numCast'", "3"),
    ("'var zq=typeof cc;'", "'typeStr'", "6"),
    ("'var zq=void 0;'", "'undefinedVal'", "4"),
    ("'var zq=!cc;'", "'negated'", "4"),
    ("'async function ff(){var zq=await cc(1)}'", "'awaited'", "3"),
    ("'var zq=cc||new Map();'", "'map'", "9"),
    (f"'var zq=cc?[]:{{' || {A} || ':1}};'", f"'obj_' || {A}", "6"),
    (f"'var zq=\"' || {A} || '\"+cc;'", f"{A} || 'Str'", "4"),
    (f"'var zq=cc+\"' || {A} || '\";'", f"{A} || 'Str'", "3"),
    ("'var zq=cc<dd;'", "'boolResult'", "3"),
    ("'var zq=cc-dd;'", "'numResult'", "3"),
    ("'var zq=cc&dd;'", "'bitwise'", "3"),
    ("'var zq=async()=>1;'", "'asyncFn'", "4"),
    ("'var zq=function*(){};'", "'generatorFn'", "4"),
    (f"'var zq=()=>cc.' || {AB} || ';'", f"'get' || {UA} || {UB}", "4"),
    (f"'var zq=function(t){{return t[t.' || {UA} || '=0]=\"' || {UA} || '\"}};'", f"{A} || 'Enum'", "7"),
    (f"'var zq=S((e,m)=>{{if(cc)e.' || {AB} || '=1}});'", f"{AB} || 'Mod'", "7"),
    (f"'var zq=R(()=>{{dd.' || {AB} || '=1}});'", f"{AB} || 'Mod'", "4"),
    (f"'var zq=S((e,m)=>{{m.exports={{x:1,' || {AB} || ':2}}}});'", f"{AB} || 'Mod'", "7"),
    (f"'var zq=S(()=>{{if(cc){{class ' || {UA} || 'Base{{}}}}}});'", f"{A} || 'BaseCls'", "7"),
    (f"'var zq=S(()=>{{dd=class{{run(){{}}' || {AB} || '(){{}}}}}});'", f"{AB} || 'Cls'", "7"),
    (f"'var zq=S(()=>{{dd=class{{constructor(){{this.' || {AB} || '=1}}}}}});'", f"{AB} || 'Cls'", "6"),
    (f"'var zq=S(()=>{{dd=class extends ' || {UA} || 'Base{{}}}});'", f"{A} || 'BaseExt'", "5"),
    (f"'var zq=S(()=>{{function ' || {AB} || '(){{}}}});'", f"{AB} || 'Fn'", "5"),
    (f"'var zq=S(()=>{{dd={{x:1,' || {AB} || ':2}}}});'", f"{AB} || 'Obj'", "5"),
    (f"'var zq=S(()=>{{dd=[\"fix\",\"' || {A} || '-' || {B} || '-comment\"]}});'", f"{AB} || 'Comment' || 'Types'", "4"),
    ("'var zq=S(()=>{dd=/x+/});'", "'patternRegex'", "3"),
    (f"'var zq=S(()=>{{dd={{1:cc.' || upper({A}) || '_' || upper({B}) || ',2:0}}}});'", f"{AB} || 'Map'", "5"),
    ("'var zq=S(()=>{dd=new Uint8Array(9)});'", "'uint8ArrayTable'", "3"),
    (f"'var zq=S(()=>{{var dd=Ce(\"node:' || {A} || '_' || {B} || '\")}});'", f"{AB} || 'Mod'", "7"),
    (f"'var zq=S(()=>{{var{{' || {AB} || 'Key:dd}}=cc()}});'", f"{AB} || 'KeyMod'", "7"),
    (f"'var zq=S(()=>{{var dd=Symbol(\"' || {A} || '\")}});'", f"'sym_' || {A}", "6"),
    (f"'var zq=S(()=>{{(function(t){{t.' || {AB} || '=1}})(dd)}});'", f"{AB} || 'Enum'", "7"),
    ("'var zq=S(()=>{dd=()=>{let t={string:{unit:1}}}});'", "'localeMod'", "6"),
    table(tables.MODULES, 'import zq from "', '";', lambda k, v: v, lambda k, v: 8),
    table(tables.MODULES, 'import * as zq from "node:', '";', lambda k, v: v, lambda k, v: 8),
    (f"'import {{' || {A} || ' as zq}} from \"x\";'", A, "7"),
    table(tables.CLASS_ROLES, "class zq{", "(){}}", lambda k, v: v, lambda k, v: 8),
    table(list(tables.ERROR_CLASSES), "class zq extends ", "{}", lambda k, v: "errClass", lambda k, v: 9),
    ("'class zq extends cc{}'", "'subClass'", "8"),
    ("'class zq{}'", "'classDef'", "7"),
    ("'try{cc()}catch(zq){}'", "'err'", "9"),
    ("'function ff(...zq){}'", "'arr'", "8"),
    (f"'var {{' || {A} || 'Name:zq}}=cc;'", f"{A} || 'Name'", "7"),
]


@_query(expected(INITIALIZERS, "candidate", "score"))
def q_initializers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an initializer of each kind says, over all rows of the tables of calls, members, globals, modules and roles."""
    told = lambda found: naming.initial_names(found).where("name = 'zq'").select("key", "candidate", "score")
    return of_texts(sources(spark, sf_dir, INITIALIZERS), "key", "text", told)


def _use(program: str, kind: str, score: int) -> Family:
    return lit(program), lit(kind), str(score)


_EVENTS_ALL = [*tables.EVENTS, *tables.EVENT_HANDLERS]
_PROPERTIES = rules.property_rules()
USES: list[Family] = [
    table(tables.INSTANCE_TYPES, "if(zq instanceof ", ")cc();", lambda k, v: v, lambda k, v: 8),
    table(tables.TYPEOF_TYPES, 'if(typeof zq==="', '")cc();', lambda k, v: v, lambda k, v: 7),
    table(_EVENTS_ALL, 'cc.on("', '",zq);', lambda k, v: rules.handler_name(k), lambda k, v: 9),
    table({p: (t, s) for p, t, s in _PROPERTIES}, "zq.", ";", lambda k, v: v[0], lambda k, v: v[1]),
    table({("invalid_type", "too_big"): ("zodError", 8), ("string", "number"): ("string", 6), ("click", "submit"): ("eventType", 7), ("html", "cc"): ("parserToken", 7),
           ("pending", "cc"): ("statusStr", 7), ("GET", "cc"): ("httpMethod", 8)}, 'switch(zq){case "', '":}', lambda k, v: v[0], lambda k, v: v[1], lambda k: '":case "'.join(k)),
    _use("async()=>{await zq};", "promise", 4),
    _use("for(var kk of zq);", "array", 5),
    _use("for(var kk in zq);", "object", 4),
    _use("throw zq;", "error", 5),
    _use("new zq;", "ctor", 5),
    _use("zq();", "function", 3),
    _use("[...zq];", "array", 4),
    _use("!zq;", "boolean", 2),
    _use("-zq;", "number", 4),
    _use("zq*2;", "number", 3),
    _use("zq<2;", "number", 4),
    _use("zq==null;", "optional", 4),
    _use("zq===true;", "boolean", 5),
    _use("zq===1;", "number", 4),
    _use('zq==="x";', "string", 3),
    _use("zq??cc;", "optional", 3),
    _use("zq?1:2;", "boolean", 2),
    _use("delete zq.x;", "object", 3),
    _use("var [aa]=zq;", "array", 5),
    _use("var {aa}=zq;", "object", 4),
    _use("class cc extends zq{}", "ctor", 7),
    _use("function*ff(){yield zq}", "iterable", 3),
    _use("cc instanceof zq;", "ctor", 4),
    _use("zq.push(1);zq.push(2);zq.pop();", "array", 15),
]


@_query(f"SELECT key, type, score::BIGINT AS score FROM ({expected(USES, 'type', 'score')})")
def q_usage_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a use of each kind says of a name, over all rows of the tables of properties, events, classes and switches."""
    told = lambda found: naming.usage_types(found).where("name = 'zq'").select("key", "type", "score")
    return of_texts(sources(spark, sf_dir, USES), "key", "text", told)


def _best_shape(props: tuple[str, ...]) -> tuple[str, int]:
    """By trying every rule."""
    have = set(props)
    scored = [(score * sum(p in have for p in rule) / len(rule), -k, name) for k, (rule, name, score) in enumerate(tables.SHAPES)]
    raw, _, name = max(scored)
    return name, int(raw + 0.5)


def _best_namespace(props: tuple[str, ...]) -> tuple[str, int]:
    score, _, name = max((score, -k, name) for k, (name, score, least, constants) in enumerate(tables.NAMESPACES) if sum(p in constants for p in props) >= least)
    return name, score


_READ = {props: _best_shape(tuple(p for p in props if len(p) > 1)) for props, _, _ in tables.SHAPES if any(len(p) > 1 for p in props)}
_TAKEN = {props: _best_shape(tuple(p for p in props if len(p) > 2)) for props, _, _ in tables.SHAPES if sum(len(p) > 2 for p in props) > 1 or props == ("connectParams",)}
_members = lambda k: ",".join(f"zq.{p}" for p in k)
_first, _second = (lambda k, v: v[0]), (lambda k, v: v[1])
SHAPES_READ: list[Family] = [table(_READ, "cc(", ");", _first, _second, _members)]
SHAPES_TAKEN: list[Family] = [table(_TAKEN, "var {", "}=zq;", _first, _second, ",".join)]
_CONSTANTS = {constants[:least]: _best_namespace(constants[:least]) for _, _, least, constants in tables.NAMESPACES}
NAMESPACES: list[Family] = [table(_CONSTANTS, "cc(", ");", _first, _second, _members)]


@_query(f"SELECT how, key, candidate, score::BIGINT AS score FROM (SELECT 'read' AS how, * FROM ({expected(SHAPES_READ, 'candidate', 'score')}) UNION ALL SELECT 'taken', * FROM ({expected(SHAPES_TAKEN, 'candidate', 'score')}) UNION ALL SELECT 'constants', * FROM ({expected(NAMESPACES, 'candidate', 'score')}))")
def q_shape_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the properties that are read or taken out, and by constants, over all rows of their tables."""
    read, taken, constants = (facts(sources(spark, sf_dir, f), "key", "text") for f in (SHAPES_READ, SHAPES_TAKEN, NAMESPACES))
    parts = (("read", naming.shape_names(read, naming.shape_table(read))), ("taken", naming.shape_names(taken, naming.shape_table(taken), "destruct")), ("constants", naming.namespace_names(constants)))
    found = None
    for how, part in parts:
        part = part.where("name = 'zq'").select(F.lit(how).alias("how"), "key", "candidate", F.col("score").cast("long").alias("score"))
        found = part if found is None else found.unionByName(part)
    return found


def _call(callee: str, place: int) -> str:
    return ("cc" if callee.startswith(".") else "") + callee + "(" + "".join(f"a{k}," for k in range(max(place, 0))) + "zq)"


_ARGUMENTS = {_call(callee, place): (kind, score) for callee, place, kind, score in rules.argument_rules()}
_KNOWN = {f"{obj}.{m}(zq)": (tables.METHOD_ARGUMENTS[m][0] if m in tables.METHOD_ARGUMENTS else tables.ALL_ARGUMENTS[m]) for obj, methods in {
    "fs": ("readFile", "stat", "unlink"), "path": ("join", "dirname"), "JSON": ("parse", "stringify"), "console": ("log",), "Math": ("max", "floor"), "Object": ("keys", "freeze")}.items() for m in methods}
ARGUMENTS: list[Family] = [table(_ARGUMENTS, "", ";", _first, _second), table(_KNOWN, "", ";", _first, _second)]


@_query(expected(ARGUMENTS, "type", "score"))
def q_call_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by a name's place among the arguments of known functions and methods, over all rows of their tables."""
    found = naming.argument_types(facts(sources(spark, sf_dir, ARGUMENTS), "key", "text"))
    return found.where("name = 'zq'").select("key", "type", "score")


DIRECT: list[Family] = [
    table(tables.ALIAS_PROPERTIES, "var zq=cc.", ";", _first, _second),
    _use("var zq=`x`;", "string", 7),
    _use("var zq=cc-dd;", "number", 6),
    _use("zq=cc-dd;", "number", 5),
    _use("var zq=typeof cc;", "string", 7),
    _use("function gg(){return 'x'}var zq=gg();", "string", 5),
    _use("function gg(a){if(a)return 1;return 2}var zq=gg();", "number", 5),
]


@_query(expected(DIRECT, "type", "score"))
def q_direct_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that an assignment itself shows: properties, operators, functions whose returns have one type."""
    told = lambda found: naming.direct_types(found).where("name = 'zq'").select("key", "type", "score")
    return of_texts(sources(spark, sf_dir, DIRECT), "key", "text", told)


LATE: list[Family] = [
    ("'var ab=new Map();var zq=Oe(ab(),1);'", "'mapInterop'"),
    ("'var zq=Ce(\"os\");'", "'osModule'"),
    (f"'var zq=g1(cc,\"' || {A} || ' ' || {B} || '\");'", f"{AB} || 'Icon'"),
    (f"'var zq=Ok(cc,1,\"' || {AB} || '\");'", AB),
    ("'var zq=f0(Object.keys,Object);'", "'objectKeysFunc'"),
    (f"'var zq=(function(t){{return t[t.' || {UA} || '=0]=\"' || {UA} || '\"}})({{}});'", f"{A} || 'Enum'"),
    (f"'var zq=new Cc().name(\"' || {A} || ' ' || {B} || '\").opt();'", f"{AB} || 'Cmd'"),
    (f"'var zq=bb=cc.' || upper({A}) || '_' || upper({B}) || '=1;'", AB),
    (f"'var zq=cc.' || {AB} || 'Sync(1);'", f"{AB} || 'Sync'"),
    ("'var zq=(()=>new TextDecoder())();'", "'textDecoder'"),
    ("'var zq=cc&&cc.__extends||0;'", "'extendsHelper'"),
    (f"'var zq=g1(Oo.' || upper({A}) || '_' || upper({B}) || ',\"\");'", f"{AB} || 'Icon'"),
    ("'var ab=new Map();zq=ab(1);var zq;'", "'mapResult'"),
    ("'var aa=new Map();var zq=new Map();'", "'map_2'"),
    ("'var aa=new Map();var ab=aa;var ac=ab;var zq=ac;'", "'registry_3'"),
    table(tables.INSTANCE_TYPES, "cc(zq instanceof ", ");", lambda k, v: tables.DISPLAY.get(v, v), lambda k, v: 0)[:2],
    table(_EVENTS_ALL, 'cc.on("', '",zq);var zq;', lambda k, v: rules.handler_name(k), lambda k, v: 0)[:2],
    ("'var zq;cc(zq)'", "'seeded'"),
]
LATE[15] = (f"'var zq;' || {LATE[15][0]}", LATE[15][1])


@_query(expected(LATE, "semantic"))
def q_late_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New names where there is no other evidence: wrappers, factories, builders, constants, helpers, links, seeds."""
    seeds = spark.createDataFrame([("zq", "seeded")], "mangled string, semantic string")
    told = lambda found: naming.rename_map(found, seeds, hints=False).where("mangled = 'zq'").select("key", "semantic")
    return of_texts(sources(spark, sf_dir, LATE), "key", "text", told)


_NL = "chr(10)"
BUNDLES: list[Family] = [
    (f"'let z' || {_NL} || '// node_modules/' || {A} || '/' || {B} || '.js' || {_NL} || 'c(1)' || {_NL} || '// node_modules/@x/' || CAST(p_size AS VARCHAR(9)) || '.js' || {_NL} || 'd()'",),
    (f"'var ' || {A} || '=R(()=>{{x={{y:' || CAST(p_size AS VARCHAR(9)) || '}}}});var ' || {B} || ' = R(() => {{ function q(){{}} }});'",),
    ("'/*0*/a(' || CAST(p_size AS VARCHAR(9)) || ')/* 1 */b()'",),
    ("'console.log(1);'",),
]
_MODULES = [
    (0, 0, "'chunk_0'", f"'let z' || {_NL}"),
    (0, 1, f"{A} || '_' || {B} || '.js'", f"'// node_modules/' || {A} || '/' || {B} || '.js' || {_NL} || 'c(1)' || {_NL}"),
    (0, 2, "'x_' || p_size || '.js'", f"'// node_modules/@x/' || p_size || '.js' || {_NL} || 'd()'"),
    (1, 0, A, f"'var ' || {A} || '=R(()=>{{x={{y:' || p_size || '}}}})'"),
    (1, 1, B, f"'var ' || {B} || ' = R(() => {{ function q(){{}} }})'"),
    (2, 0, "'module_0'", "'a(' || p_size || ')'"),
    (2, 1, "'module_1'", "'b()'"),
]


@_query(" UNION ALL ".join(f"SELECT p_partkey * 100 + {k} AS key, {o}::BIGINT AS ordinal, {n} AS name, {c} AS code FROM part" for k, o, n, c in _MODULES))
def q_extract_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules of bundles of three formats; a text of none has no row."""
    found = text.extract_modules(sources(spark, sf_dir, BUNDLES), "key", "text")
    return found.select("key", F.col("ordinal").cast("long").alias("ordinal"), "name", "code")


_SCOPES: list[Family] = [(f"'var ' || {A} || '=S((ex,mo)=>{{1}}),q1;var ' || {B} || ' = W(($a, _b) => {{}});'",)]


@_query(f"SELECT p_partkey * 100 AS key, 0::BIGINT AS ordinal, {A} AS name, 'ex' AS exports, 'mo' AS module FROM part UNION ALL SELECT p_partkey * 100, 1, {B}, '$a', '_b' FROM part")
def q_module_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of lazy modules."""
    found = text.module_scopes(sources(spark, sf_dir, _SCOPES), "key", "text")
    return found.select("key", F.col("ordinal").cast("long").alias("ordinal"), "name", "exports", "module")


@_query(rf"""SELECT p_partkey, {AB} || p_type AS camel, {AB} || p_size AS slug, {A} AS core, regexp_matches({A}, '^[a-zA-Z][a-zA-Z0-9]{{1,3}}$') AS short, length({A}) <= 4 AS any_short,
    regexp_matches({A} || p_size, '^[A-Za-z_$][A-Za-z0-9_$]{{1,30}}$') AS answer, regexp_matches(p_name, '^[A-Za-z_$][A-Za-z0-9_$]{{1,30}}$') AS no_answer FROM part""")
def q_scalar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camel case, slugs, cores, short names and the test of answers."""
    a, b, size = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_size").cast("string")
    return _t(spark, sf_dir, "part").select(
        "p_partkey",
        ids.to_camel(F.concat("p_name", F.lit("-"), "p_type")).alias("camel"),
        ids.slug_name(F.array(a, F.concat(a, F.lit("-"), b, F.lit("-"), size), b)).alias("slug"),
        ids.core_name(F.concat(a, F.lit("Cls_"), size)).alias("core"),
        ids.is_short(a).alias("short"),
        ids.is_short(a, True).alias("any_short"),
        ids.valid_answer(F.concat(a, size)).alias("answer"),
        ids.valid_answer(F.col("p_name")).alias("no_answer"),
    )


_WINDOW = r"""SELECT doc_id, name, md5(regexp_replace(CASE WHEN length(head) + length(string_split(tail, chr(10))[1]) > 500 THEN substr(text, greatest(spot - 600, 1), spot - greatest(spot - 600, 1) + length(name) + 600)
    ELSE head || array_to_string(string_split(tail, chr(10))[1:10], chr(10)) END, '^\s+|\s+$', '', 'g')) AS digest
    FROM (SELECT *, string_split(substr(text, 1, spot - 1), chr(10))[-1] AS head, substr(text, spot) AS tail FROM (SELECT *, instr(text, name) AS spot FROM (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(text, '[a-z]{14,}')) AS name FROM documents)))"""


@_query(_WINDOW)
def q_context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten lines, or six hundred characters on both sides, at every long word of a document."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    rest = docs.select("key", F.explode(F.regexp_extract_all("text", F.lit("[a-z]{14,}"), F.lit(0))).alias("name")).distinct()
    return namer.windows(rest, docs).select(F.col("key").alias("doc_id"), "name", F.md5(F.col("context").cast("binary")).alias("digest"))


_LINES: list[Family] = [(f"'let ' || {A} || ' = 1;' || {_NL} || {A} || ' == 2;' || {_NL} || {A} || '(3);' || {_NL} || {A} || '.x;'",)]


@_query(f"SELECT p_partkey * 100 AS key, 'let ' || {A} || ' = 1; | ' || {A} || ' = 1; | ' || {A} || '(3);' AS contexts FROM part")
def q_telling_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name's first declaration, assignment and call."""
    texts = sources(spark, sf_dir, _LINES)
    rest = _t(spark, sf_dir, "part").select((F.col("p_partkey") * 100).alias("key"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))
    return namer.telling_contexts(rest, texts).select("key", F.array_join("contexts", " | ").alias("contexts"))


_FENCE = "'```json' || chr(10) || '{\"ab\":\"' || " + A + " || '\",\"cd\":\"' || " + B + " || '\"}' || chr(10) || '```'"
_LOOSE = "'Sure: \"ab\": \"' || " + A + " || '\", then \"cd\": \"' || " + B + " || '\" and no more'"


@_query(f"SELECT p_partkey, 0 AS kind, {A} AS ab, {B} AS cd FROM part UNION ALL SELECT p_partkey, 1, {A}, {B} FROM part")
def q_answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from answers in a fence, and from quoted pairs where there is no object."""
    each = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.expr(_FENCE).alias("answer")), F.struct(F.lit(1).alias("kind"), F.expr(_LOOSE).alias("answer"))))
    told = _t(spark, sf_dir, "part").select("p_partkey", each.alias("a")).select("p_partkey", "a.kind", namer.answer_pairs(F.col("a.answer")).alias("m"))
    return told.select("p_partkey", "kind", F.col("m")["ab"].alias("ab"), F.col("m")["cd"].alias("cd"))


_ASKED = f"SELECT p_partkey // 50 AS batch, 'n' || p_partkey AS name, {A} || ' = the synchronizer' || {B} AS context FROM part"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    return _t(spark, sf_dir, "part").select(F.floor(k / 50).alias("batch"), F.concat(F.lit("n"), k.cast("string")).alias("name"), F.concat(a, F.lit(" = the synchronizer"), b).alias("context"))


@_query(f"SELECT batch, md5({lit(namer.STRICT)} || chr(10) || string_agg('- ' || name || ': ' || context, chr(10) ORDER BY name)) AS digest FROM ({_ASKED}) GROUP BY batch")
def q_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt for each batch of names and contexts."""
    return namer.prompts(_asked(spark, sf_dir)).select("batch", F.md5(F.col("prompt").cast("binary")).alias("digest"))


@_query(f"SELECT name AS key, substr(string_split(context, ' ')[-1], 1, 26) || 'Ctx' AS value FROM ({_ASKED})")
def q_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the namer that is included, read and checked."""
    return namer.ask(namer.prompts(_asked(spark, sf_dir))).select("key", "value")


RUNS: list[Family] = [(f"'var ab=\"/' || {A} || '\";var zq;synchronizer' || {B} || '(zq);'",)]


@_query("SELECT p_partkey * 100 AS key, 2::BIGINT AS bindings, 1::BIGINT AS static, 1::BIGINT AS llm, 0::BIGINT AS graph, 2::BIGINT AS total, 0::BIGINT AS uncertain, 100.0::DOUBLE AS coverage FROM part")
def q_full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by origin of a whole run: evidence, then the namer about what is left, then the graph."""
    texts = sources(spark, sf_dir, RUNS)
    found = facts(texts, "key", "text").persist()
    renames = recover.name_all(found, texts, options=recover.Options(namer=namer.plain_namer, graph=True, hints=False))
    return naming.stats(found, renames).select("key", "bindings", "static", "llm", "graph", "total", "uncertain", "coverage")


SYMBOLS: list[Family] = [(f"'function ' || {A} || '(){{}}class ' || {UB} || '{{run(){{}}get x1(){{}}static go(){{}}}}' || {_NL} || 'var cc=()=>1,dd=2,ee={{fn1(){{}}}};' || {_NL} || 'export function ' || {B} || 'Out(){{}}'",)]
_SYMBOLS = [("function", A, 1), ("class", UB, 1), ("method:method", "'run'", 1), ("method:get", "'x1'", 1), ("method:method", "'go'", 1), ("function", "'cc'", 2), ("variable", "'dd'", 2),
            ("variable", "'ee'", 2), ("method:property", "'fn1'", 2), ("export:function", f"{B} || 'Out'", 3), ("function", f"{B} || 'Out'", 3)]


@_query(" UNION ALL ".join(f"SELECT p_partkey * 100 AS key, '{k}' AS kind, {n} AS name, {line}::BIGINT AS line FROM part" for k, n, line in _SYMBOLS))
def q_symbol_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of every kind."""
    found = naming.symbols(facts(sources(spark, sf_dir, SYMBOLS), "key", "text"))
    return found.select("key", "kind", "name", F.col("line").cast("long").alias("line"))


_PROGRAM_NAMES = ("CMD_' || upper(replace(p_brand, '#', '')) || '", "' || CASE WHEN p_size > 25 THEN 'map' ELSE 'set' END || '", "' || CASE WHEN p_size > 25 THEN 'registry' ELSE 'pool' END || '", "' || CASE WHEN p_size > 25 THEN 'closeHandler' ELSE 'errorHandler' END || '", "promise")
_JSON = "{\"total\":5,\"map\":{" + ",".join(f'"{m}":"{n}"' for m, n in zip(("ab", "cd", "ef", "hh", "px"), _PROGRAM_NAMES, strict=True)) + "}}"


@_query(f"SELECT p_partkey AS key, '{_JSON}' AS json FROM part")
def q_rename_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rename map of every program as one object."""
    return files.rename_json(naming.rename_map(facts(_programs(spark, sf_dir), "key", "text")))


_SYMBOL_NAMES = ("ab", "cd", "ef", "px", "hh", "readableName")


@_query("SELECT p_partkey AS key, '" + '{"total":6,"symbols":[' + ",".join(f'{{"kind":"variable","name":"{n}","line":1}}' for n in _SYMBOL_NAMES) + "]}' AS json, md5('| Kind | Name | Line |' || chr(10) || '|------|------|------|' || chr(10) || '"
        + "' || chr(10) || '".join(f"| variable | `{n}` | 1 |" for n in _SYMBOL_NAMES) + "') AS markdown FROM part")
def q_symbol_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol index of every program as an object and as a table."""
    found = files.symbol_documents(naming.symbols(facts(_programs(spark, sf_dir), "key", "text")))
    return found.select("key", "json", F.md5(F.col("markdown").cast("binary")).alias("markdown"))


@_query("SELECT p_partkey AS key, 1::BIGINT AS lines, 'unknown' AS bundler, 5::BIGINT AS renamed, 0::BIGINT AS modules, 6::BIGINT AS symbols FROM part")
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a whole run for each program."""
    found = recover.recover(_programs(spark, sf_dir)).report
    return found.select("key", F.col("lines").cast("long").alias("lines"), "bundler", "renamed", "modules", "symbols")


@_query("SELECT p_partkey AS key, 5::BIGINT AS bindings, 5::BIGINT AS static, 0::BIGINT AS late, 0::BIGINT AS seed, 5::BIGINT AS total, 0::BIGINT AS uncertain, 100.0::DOUBLE AS coverage FROM part")
def q_stats_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of bindings and of names by origin for each program."""
    found = facts(_programs(spark, sf_dir), "key", "text").persist()
    return naming.stats(found, naming.rename_map(found)).select("key", "bindings", "static", "late", "seed", "total", "uncertain", "coverage")


@_query(f"""WITH t AS ({_PLACES}), c AS (SELECT key, token, count(*) AS n, min(spot) AS spot FROM t GROUP BY ALL),
    s AS (SELECT key, token, n, spot, row_number() OVER (PARTITION BY key ORDER BY n DESC, token) - 1 AS rank FROM c WHERE round({_SCORE}, 9) > 0.4),
    q AS (SELECT n AS place, {_NAME} AS name FROM (SELECT range AS n FROM range(5000))),
    h AS (SELECT key, token, CASE WHEN abs(place - rank) < 20 THEN 3 ELSE 0 END + CASE WHEN n > 100 THEN 2 WHEN n > 20 THEN 1 ELSE 0 END + CASE WHEN spot < 100 THEN 2 WHEN spot < 250 THEN 1 ELSE 0 END AS bonus,
      CASE WHEN n > 100 THEN 'critical' WHEN spot < 100 THEN 'core' END AS hint FROM s LEFT JOIN q ON token = name)
    SELECT key, token, bonus, hint FROM h WHERE bonus > 0""")
def q_math_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonuses of the words of conversations by rank, number and first place."""
    c = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    toks = text.tokens(c, "key", "text").join(c.select("key", F.size(text.identifiers(F.col("text"))).alias("size")), "key")
    uses = toks.select("key", "ordinal", F.lit("use").alias("kind"), "name", F.lit("").alias("detail"), F.floor(1000 * F.col("ordinal") / F.col("size")).cast("int").alias("score"))
    return naming.math_hints(uses).select("key", F.col("name").alias("token"), "bonus", "hint")


@_query(f"""WITH e AS ({_EDGES}), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), s AS (SELECT n_name AS node, n_regionkey AS ordinal FROM nation WHERE n_nationkey % 5 = 0),
    f AS (SELECT dst AS node, s.node AS name FROM b JOIN s ON b.src = s.node WHERE dst NOT IN (SELECT node FROM s) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY ordinal, s.node) = 1),
    p AS (SELECT *, row_number() OVER (ORDER BY node) - 1 AS place FROM f)
    SELECT node, name || ['_ctx', '_peer', '_handler', '_ref', '_alt'][place % 5 + 1] AS name FROM p""")
def q_propagated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names passed on to neighbours, with suffixes in turn."""
    nation = _t(spark, sf_dir, "nation")
    named = nation.where("n_nationkey % 5 = 0").select(F.col("n_name").alias("node"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("ordinal"))
    return graph.propagated_names(nation.select(F.col("n_name").alias("node")), _trade(spark, sf_dir), named)


@_query("SELECT p_partkey AS key, v AS kind, n::BIGINT AS n FROM part, (VALUES ('Literal', 1), ('NewExpression', 1), ('Identifier', 2), ('Call:other', 1), ('none', 1)) t(v, n)")
def q_declared_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the variables of every program begin; what is called is one kind here."""
    found = naming.init_histogram(facts(_programs(spark, sf_dir), "key", "text"))
    kind = F.when(F.col("kind").startswith("Call:"), "Call:other").otherwise(F.col("kind"))
    return found.groupBy("key", kind.alias("kind")).agg(F.sum("n").alias("n"))


_WORDS = f"SELECT key, text, token, count(*) AS n FROM (SELECT conv_id * 1000 + turn AS key, text, unnest(regexp_extract_all(text, '{ids.IDENTIFIER}')) AS token FROM conversations) GROUP BY ALL"


@_query(f"""WITH w AS ({_WORDS}), r AS (SELECT key, token, row_number() OVER (PARTITION BY key ORDER BY n DESC, token) - 1 AS rank FROM w WHERE round({_SCORE}, 9) > 0.4)
    SELECT 'frequencyMap' AS task, key, token, n::DOUBLE AS value FROM w UNION ALL SELECT 'entropy', key, token, round({_ENTROPY}, 6) FROM w
    UNION ALL SELECT 'positional', key, token, round(1 - (instr(text, token) - 1) / length(text), 6) FROM w UNION ALL SELECT 'rank', key, token, rank FROM r""")
def q_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analyses that give a number for each identifier of a turn."""
    c = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    found = None
    for task, value in (("frequencyMap", "n"), ("entropy", "entropy"), ("positional", "score"), ("rank", "rank")):
        part = tasks.run_task(task, c).select(F.lit(task).alias("task"), "key", F.col("name").alias("token"), F.round(F.col(value).cast("double"), 6).alias("value"))
        found = part if found is None else found.unionByName(part)
    return found
