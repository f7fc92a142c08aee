"""The parser, facts, naming, layout, namer, whole runs and streams on small sources."""

import json
import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import namer, naming
from factloom.plans.recover import Options, benchmark, name_all, recover, rename_texts
from factloom.sources import files
from factloom.sources.beautify import layout, pieces
from factloom.sources.facts import facts, facts_of
from factloom.sources.javascript import SourceError, parse, split_statements, walk
from factloom.streaming import ingest

PROGRAMS = [
    "var a=1,b=a/2/c;", "var r=/a[/]b/g.test(x)", "(a,b)=>({a,b})", "async(a)=>{await a}", "({a=1,...b}={})=>b", "var {a:b=1,c,...d}=e,[f,,g=2]=h",
    "for(var i=0,n=x.length;i<n;i++)z(i)", "for(const k in o);for(let [a,b] of m){}", "class A extends B{static x=1;#p=2;get y(){return this.#p}async *z(){}static{q()}}",
    "`a${b}c${`d${e}`}f`", "import a,{b as c} from 'x';export default class{};export{a as z};export function w(){}", "a?.b?.[c]?.(d)??e", "new Foo(1).bar(new a.b.C)",
    "switch(a){case 1:b();break;default:c()}", "try{a()}catch{b()}finally{c()}", "a\nb\n++c", "var async;async=1;async()", "function*g(){yield;yield*x}",
    "({get a(){return 1},get:1,async:2,async b(){},[c]:d,'e':f,*h(){}})", "(0,a.b)(c)", "[a,b]=[b,a]", "a=1/2;b=/x/", "#!/usr/bin/env node\nx", "", "a?(b,c):(d)", "lab:for(;;){break lab}",
]


@pytest.mark.parametrize("source", PROGRAMS)
def test_programs_parse_and_keep_their_text_when_laid_out(source):
    shape = lambda s: [(n["type"], n.get("name"), n.get("operator")) for n, _ in walk(parse(s))]
    assert shape(source) == shape(layout(source))
    plain = lambda s: [p for p in pieces(s) if p.strip()]
    assert plain(source) == plain(layout(source))


@pytest.mark.parametrize("source", ["var", "a b", "(", "{", "x=", "function(", "`a", "'a"])
def test_no_program_is_one_error(source):
    with pytest.raises(SourceError):
        parse(source)
    assert [r[0] for r in facts_of(source)] == ["error"]


def test_deep_and_long_programs():
    assert sum(1 for _ in walk(parse("x=" + "+".join(["a"] * 5000)))) > 10_000
    parse("(" * 1000 + "a" + ")" * 1000)
    deep = facts_of('var ab="/init";x=' + "(" * 30_000 + "1" + ")" * 30_000)
    assert ("init", "ab", "CMD_INIT", 10, 1) in deep and not [r for r in deep if r[0] == "error"]
    chain = facts_of("var ab=" + "cc=" * 500 + "new Map()")
    assert ("init", "ab", "map", 9, 1) in chain


PIECES = [
    'var %s=R(()=>{x={y:1};var a="b;}{",c=`t${d({e:`u;`})}`;if(a/b/2>1)return /[/};]x/.test(q);f(a);});', "function %s(a,b){for(var i=0;i<a;i++){b.push(i);}return b.map(c=>c/2)}",
    "if(%s)b();else c();", "do %s();while(x);", "%s.a=new Map(),q=/re;/g;", "class %s extends B{m(){return`x`}};", "// %s;\n/*;*/x;",
]


def test_parts_of_a_program_have_the_facts_of_the_whole(spark):
    source = "".join(PIECES[k % len(PIECES)] % f"v{k % 50}" + "\n" * (k % 3) for k in range(400))
    cuts = [0, *split_statements(source, 500), len(source)]
    assert len(cuts) > 20
    found, line = [], 0
    for a, b in zip(cuts, cuts[1:]):
        found += facts_of(source[a:b], line, a, len(source))
        line += source.count("\n", a, b)
    assert found == facts_of(source)
    # a program that cannot be split, one that is none, one whose parts are none, and a short one
    misread = "x=a" + "+1" * 3000 + ";y=(b)/c;/d/g;" * 3 + "if(a)" + "b();" * 2000 + "var zz;"
    rows = [(1, source), (2, "f(" + source[:3000].replace("class", "") + ")"), (3, "var q=1;" * 1000 + "}"), (4, "var ok=1"), (5, None), (6, misread)]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {}
    for r in facts(df, "k", "t", split=4000).collect():
        got.setdefault(r["key"], []).append((r["ordinal"], (r["kind"], r["name"], r["detail"], r["score"], r["line"])))
    for k, t in rows:
        assert [f for _, f in sorted(got.get(k, []))] == facts_of(t or ""), k
        assert [o for o, _ in sorted(got.get(k, []))] == list(range(len(got.get(k, []))))


def test_patterns_are_no_uses():
    found = [n["name"] for n, use in walk(parse("var a=b;function f(c,d=e){g.h=i;({j:k}=l);m.n(o)}")) if use and n["type"] == "Identifier"]
    assert found == ["b", "e", "g", "i", "l", "m", "o"]


NAMED = {
    'var ab="/init"; var cd="/help";': {"ab": "CMD_INIT", "cd": "CMD_HELP"},
    "var ab=new Map();var cd=new Set()": {"ab": "map", "cd": "set"},
    "var ab=require('chalk');": {"ab": "mod_chalk"},
    "var ab={session:1,auth:2};": {"ab": "obj_session"},
    "var ab=[];ab.push(1);ab.push(2);ab.pop();ab.sort()": {"ab": "arr"},
    "var px=q1();px.then(a);px.catch(b);px.finally(c)": {"px": "promise"},
    "var sv=q1();sv.trim();sv.split(',');sv.toUpperCase()": {"sv": "str"},
    "var ev=q1();ev.on('a',b);ev.emit('x');ev.once('y',z)": {"ev": "emitter"},
    'var myLongVariableName="/init";': {},
    "const readable = compute(1);": {},
    "var ab=new Map();var cd=ab;var zz=cd": {"ab": "map", "cd": "registry", "zz": "registry_2"},
    "var hh;q1('close',hh)": {"hh": "closeHandler"},
    "function gg(){return 'x'} var kk=gg();": {"kk": "str"},
    "var zq;w(zq)": {"zq": "seeded"},
    "var ab=new Map();var q1=Oe(ab(),1);var q2=q1;q3=ab(1);var q3": {"ab": "map", "q1": "mapInterop", "q2": "mapInterop_2", "q3": "mapResult"},
    "var q1=(function(t){return t[t.Auto=0]='Auto',t[t.Fix=1]='Fix',t})({});var q2=zz=Oo.ELEMENT_NODE=1;var q3=new Cc().name('run all').opt()": {"q1": "autoEnum", "q2": "elementNode", "q3": "runAllCmd"},
    "(": {},
    None: {},
}


def test_names_of_many_sources_at_once(spark):
    rows = list(enumerate(NAMED))
    df = spark.createDataFrame(rows, "k int, t string")
    seeds = spark.createDataFrame([("zq", "seeded")], "mangled string, semantic string")
    found = facts(df, "k", "t").persist()
    renames = naming.rename_map(found, seeds).persist()
    got = {k: {} for k, _ in rows}
    for r in renames.collect():
        got[r["key"]][r["mangled"]] = r["semantic"]
    assert got == {k: NAMED[t] for k, t in rows}
    told = {r["key"]: r for r in naming.stats(found, renames).collect()}
    assert told[0]["coverage"] == 100 and told[13]["seed"] == 1 and told[13]["uncertain"] == 0
    maps = {r["key"]: json.loads(r["json"]) for r in files.rename_json(renames).collect()}
    assert maps[0] == {"total": 2, "map": {"ab": "CMD_INIT", "cd": "CMD_HELP"}}
    text = {r["key"]: r["text"] for r in rename_texts(df.select(F.col("k").alias("key"), F.col("t").alias("text")), renames).collect()}
    last = len(rows) - 1
    assert text[0] == 'var CMD_INIT="/init"; var CMD_HELP="/help";' and text[last - 1] == "(" and text[last] is None


def test_symbols_edges_and_graph_names(spark):
    source = "export function foo(){}\nclass Bar{run(){}}\nvar baz=()=>1, q={go(){}};\nqq(aa,bb);qq(aa,bb);bb(cc,aa);bb(cc)"
    found = facts(spark.createDataFrame([(1, source)], "k int, t string"), "k", "t").persist()
    rows = [(r["kind"], r["name"], r["line"]) for r in naming.symbols(found).orderBy("ordinal").collect()]
    assert rows == [("function", "foo", 1), ("export:function", "foo", 1), ("method:method", "run", 2), ("class", "Bar", 2), ("function", "baz", 3), ("method:property", "go", 3), ("variable", "q", 3)]
    edges = {(r["src"], r["dst"]): r["weight"] for r in naming.relationships(found).collect()}
    assert edges == {("aa", "bb"): 4, ("aa", "qq"): 6, ("aa", "cc"): 2, ("bb", "cc"): 6}
    rest = spark.createDataFrame([(1, n) for n in ("aa", "bb", "cc", "qq")], "key int, name string")
    named = spark.createDataFrame([(1, "aa", "parser")], "key int, name string, semantic string")
    assert {r["semantic"].split("_")[0] for r in naming.graph_names(found, rest, named).collect()} <= {"parser"}


def test_answers_and_rounds(spark):
    text = 'Sure: {"x": 1} and {"ab": "parserState", "cd": "token{Kind", "zz": "other"}'
    assert namer.parse_answer(text, ["ab", "cd"]) == {"ab": "parserState", "cd": "token{Kind"}
    assert namer.parse_answer('{"ab": "one", broken', ["ab"]) == {"ab": "one"} and namer.parse_answer("", ["ab"]) == {}
    rest = spark.createDataFrame([("ab", "var ab = tokenizer()"), ("cd", "cd.serializer"), ("ef", "ef")], "name string, context string")
    merged = spark.createDataFrame([("q", "taken")], "key string, value string")
    got = {r["key"]: r["value"] for r in namer.fill_gaps(rest, merged).collect()}
    assert got == {"q": "taken", "ab": "tokenizerCtx", "cd": "serializerCtx"}
    pairs = spark.createDataFrame([("```json\n{\"ab\":\"x\"}\n```",), ('"ab": "y",',)], "a string").select(namer.answer_pairs(F.col("a")).alias("m")).collect()
    assert [r["m"] for r in pairs] == [{"ab": "x"}, {"ab": "y"}]


def test_rounds_until_enough_and_passes(spark):
    rest = spark.createDataFrame([(f"n{k}", f"n{k} = tokenizer{chr(97 + k)}()") for k in range(6)], "name string, context string")
    merged = spark.createDataFrame([("q", "taken")], "key string, value string")
    assert namer.fill_until(rest, merged, 90).count() == 7 and namer.fill_until(rest, merged, 10).count() == 1
    sources = spark.createDataFrame([(1, "var ab; serializer(ab); ab()"), (2, "var ab; tokenizer(ab); var cd")], "key int, text string")
    left = spark.createDataFrame([(1, "ab", 2), (2, "ab", 1), (2, "cd", 0)], "key int, name string, n long")

    def shy(prompt):
        return "{}" if prompt.startswith(namer.STRICT) and "tokenizer" in prompt else namer.plain_namer(prompt)

    got = {(r["key"], r["name"], r["pass"]): r["candidate"] for r in namer.name_rest(left, sources, shy, passes=2).collect()}
    assert got == {(1, "ab", 1): "serializerCtx", (2, "ab", 2): "tokenizerCtx", (2, "cd", 2): "tokenizerCtx"}
    assert {(r["key"], r["name"]) for r in namer.name_rest(left, sources, most=1).collect()} == {(1, "ab"), (2, "ab")}
    assert [r["name"] for r in naming.priorities(left).orderBy("key", "place").collect()] == ["ab", "ab", "cd"]


def test_models_and_profiles():
    assert namer.profile("some-opus-1").batch == 50 and namer.profile("gpt-4o-mini").batch == 30 and namer.profile("gpt-4o").batch == 60 and namer.profile("").batch == 10
    assert namer.choose_model(["b", "a-sonnet"], ["opus", "sonnet"]) == "a-sonnet" and namer.choose_model(["b"], ["opus"]) == "b" and namer.choose_model([], ["x"]) is None


def test_namer_and_graph_take_what_is_left(spark):
    sources = spark.createDataFrame([(1, 'var ab="/init";var zq;synchronizer(zq);var kk;ff(ab,kk);ff(ab,kk);gg(kk)')], "key int, text string")
    found = facts(sources, "key", "text").persist()
    plain = {r["mangled"]: r["origin"] for r in name_all(found, sources).collect()}
    assert plain == {"ab": "static"}
    both = {r["mangled"]: r["origin"] for r in name_all(found, sources, options=Options(namer=namer.plain_namer, most=1, graph=True)).collect()}
    assert both["ab"] == "static" and "llm" in both.values() and set(both.values()) <= {"static", "llm", "graph"}
    told = benchmark(sources, options=Options(namer=namer.plain_namer)).first()
    assert (told["bindings"], told["static"], told["llm"], told["uncertain"]) == (3, 1, 2, 0)


def test_histogram_of_beginnings(spark):
    found = facts(spark.createDataFrame([(1, "var a1=f1(),b1=f1(),c1=x.g1(),d1,e1=2")], "k int, t string"), "k", "t").persist()
    got = {r["kind"]: (r["n"], r["sample"]) for r in naming.init_histogram(found).collect()}
    assert got == {"Call:f1": (2, "a1"), "Call:g1": (1, "c1"), "none": (1, "d1"), "Literal": (1, "e1")}
    named = spark.createDataFrame([(1, "a1")], "key int, mangled string")
    assert [(r["kind"], r["n"]) for r in naming.top_calls(naming.init_histogram(found, named)).collect()] == [("Call:f1", 1), ("Call:g1", 1)]


def test_occurrences_prefer_telling_places(spark):
    sources = spark.createDataFrame([(1, "ab; x = ab.c"), (2, "abc")], "key int, text string")
    rest = spark.createDataFrame([(1, "ab"), (2, "ab")], "key int, name string")
    got = namer.occurrences(rest, sources, around=3).collect()
    assert [(r["key"], r["snippets"]) for r in got] == [(1, "= ab.c | ab; x")]


def test_snippets_of_a_text_read_it_once(spark):
    import random

    rng = random.Random(7)
    texts = ["".join(rng.choice(["ab", "ab", "c", "ab1", "(", "=", ",", ".", " ", "  ", "\n", "\r\n", "\t \n", "\u2028", "\u00e9", "\U0001f600", "5"]) for _ in range(rng.choice([0, 3, 40, 200]))) for _ in range(40)]

    def plain(source, name, around, k):
        found = {}
        places = [m.span() for m in re.finditer(r"[A-Za-z_$][A-Za-z0-9_$]*", source) if m[0] == name]
        sign = r"[=,(](\r\n|[\n\r\x85\u2028\u2029])? *\Z"
        score = lambda a, b: 2 * bool(re.search(sign, source[:a])) + bool(re.match(r" *[.(]", source[b:]))
        for a, b in sorted(places, key=lambda p: (-score(*p), p[0])):
            found[re.sub(r"\s+", " ", source[max(a - around, 0) : b + around], flags=re.ASCII).strip(" ")[:400]] = None
        return " | ".join(list(found)[:k])

    for around, k in ((3, 2), (400, 5)):
        for source in texts:
            want = {n: plain(source, n, around, k) for n in ("ab", "c", "ab1") if plain(source, n, around, k)}
            assert dict(namer.snippets_of(source, ["ab", "c", "ab1", "zz"], around, k)) == want
    # each occurrence was a row with the whole text before: 6,000 rows of 24,000 characters
    sources = spark.createDataFrame([(1, "ab; " * 6000), (2, None)], "key int, text string")
    rest = spark.createDataFrame([(1, "ab"), (2, "ab")], "key int, name string")
    plan = namer.occurrences(rest, sources)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and namer.occurrences(rest, sources).count() == 1


def test_neighbours_give_numbered_names(spark):
    toks = spark.createDataFrame([(1, "ab", 0), (1, "pq", 50), (1, "ab", 80), (1, "pq", 500), (1, "cd", 510), (1, "cd", 520)], "key int, name string, pos int")
    rest = spark.createDataFrame([("ab",), ("cd",)], "name string")
    named = spark.createDataFrame([("pq", "parserState")], "name string, semantic string")
    votes = namer.neighbour_votes(toks, rest, named)
    assert {(r["name"], r["neighbour"], r["n"]) for r in votes.collect()} == {("ab", "pq", 2), ("cd", "pq", 2)}
    assert {r["name"]: r["semantic"] for r in namer.neighbour_names(votes, named).collect()} == {"ab": "parserCtx", "cd": "parserCtx2"}


def test_whole_run_from_files_and_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.js").write_text('#!/usr/bin/env node\nvar ab="/init";var cd=ab;')
    (folder / "b.js").write_text("var x1=R(()=>{y={z:1}});")
    (tmp_path / "seeds.json").write_text('{\n  "q": "w"\n}')
    sources = files.read_sources(spark, str(folder))
    assert sources.count() == 2
    seeds = files.read_seeds(spark, str(tmp_path / "seeds.json"))
    r = recover(sources, seeds)
    text = {x["key"].rsplit("/", 1)[1]: x["text"] for x in r.renamed.collect()}
    assert text["a.js"] == 'var CMD_INIT="/init";\nvar CMD_INIT_2=CMD_INIT;\n'
    report = {x["key"].rsplit("/", 1)[1]: x for x in r.report.collect()}
    assert report["b.js"]["bundler"] == "copilot" and report["a.js"]["symbols"] == 2 and report["a.js"]["renamed"] == 2
    assert files.symbol_documents(r.symbols).count() == 2
    assert report["a.js"]["tool"] == "factloom" and report["a.js"]["duration_ms"] >= 0 and report["a.js"]["passes"][0] == "beautify"
    assert "2 sources" in files.summary(r.report, r.stats)
    docs = files.documents(r.renamed, files.rename_json(r.renames), files.last_modules(r.modules), files.symbol_documents(r.symbols), files.report_json(r.report))
    files.write_files(docs, str(tmp_path / "files"))
    assert (tmp_path / "files" / "a" / "a.renamed.js").read_text() == text["a.js"] and (tmp_path / "files" / "b" / "modules" / "x1.js").exists()
    assert json.loads((tmp_path / "files" / "a" / "report.json").read_text())["stats"]["renamed"] == 2
    assert len(list((tmp_path / "files").rglob("*.*"))) == docs.count()
    (tmp_path / "batch.json").write_text('[{"name": "ab", "context": ["x", "y"]}, {"name": "cd"}]')
    assert [(x["name"], x["context"]) for x in files.read_batches(spark, str(tmp_path / "batch.json")).orderBy("ordinal").collect()] == [("ab", ["x", "y"]), ("cd", [])]
    merged = files.read_merged(spark, str(tmp_path / "seeds.json"))
    assert [(x["key"], x["value"]) for x in merged.collect()] == [("q", "w")]
    assert files.add_seeds(seeds, spark.createDataFrame([("q", "z"), ("r", "s")], "key string, value string")).count() == 2
    assert files.names_json(merged).first()["json"] == '{"q":"w"}'
    (tmp_path / "rules.json").write_text('{"frobnicate": ["gizmo", 9]}')
    extra = files.read_property_rules(spark, str(tmp_path / "rules.json"))
    found = facts(spark.createDataFrame([(1, "var ab;ab.frobnicate")], "k int, t string"), "k", "t")
    assert naming.rename_map(found, extra=extra).first()["semantic"] == "gizmo"
    ingest.write_facts(ingest.stream_sources(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("kind = 'symbol'").count() == 3


def test_each_different_text_is_parsed_once(spark):
    from factloom.operators import naming
    from factloom.sources.facts import facts, of_texts

    long = 'var zq="/' + "x" * 80 + '";'
    texts = ['var zq="/run";', long, "", None, "var zq=(", "var zq=[],aa={}"]
    rows = spark.createDataFrame([(k, texts[k % 6]) for k in range(60)], "key long, text string")
    parsed = []

    def run(found):
        parsed.append(found.select("key").distinct().count())
        return naming.initial_names(found)

    want = sorted(map(tuple, naming.initial_names(facts(rows, "key", "text")).collect()))
    for most in (200_000, 0):
        assert sorted(map(tuple, of_texts(rows, "key", "text", run, most).collect())) == want
    assert len(want) == 40 and parsed == [4, 4]


@pytest.mark.parametrize("name", ["q_initializers", "q_late_names", "q_direct_types", "q_usage_types"])
def test_queries_parse_no_program_twice(spark, monkeypatch, name):
    import sys

    from factloom.plans import catalog, programs

    module, seen = sys.modules["factloom.sources.facts"], []

    def counted(df, key, text, real=module.facts):
        seen.append(df.count() - df.select(text).distinct().count())
        return real(df, key, text)

    query = catalog.queries()[name]
    monkeypatch.setattr(module, "facts", counted)
    monkeypatch.setattr(programs, "facts", counted)
    query(spark, "/root/testdata/sf0.001")
    assert seen == [0]
