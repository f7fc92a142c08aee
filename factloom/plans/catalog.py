"""The registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import identifiers as ids
from factloom.operators import evidence, graph, namer, naming, text
from factloom.plans import recover
from factloom.sources.beautify import beautify
from factloom.sources.facts import facts
from factloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "q_token_frequency_topk"

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_SKIP = ", ".join(f"'{x}'" for x in ids.SKIP)
_SKIP_GRAPH = ", ".join(f"'{x}'" for x in ids.SKIP_GRAPH)
_TOKENS = f"SELECT doc_id, unnest(regexp_extract_all(text, '{ids.IDENTIFIER}')) AS token FROM documents"


def _minified(name: str, preset: str) -> str:
    least, most, _, pattern = ids.PRESETS[preset]
    skip = _SKIP_GRAPH if preset == "graph" else _SKIP
    return f"(length({name}) BETWEEN {least} AND {most} AND {name} NOT IN ({skip}) AND regexp_matches({name}, '{pattern}'))"


def _document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tokens(_t(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("name", "token")


@_query(f"""
    WITH t AS ({_TOKENS}), c AS (SELECT token, count(*) AS n FROM t WHERE {_minified("token", "rename")} GROUP BY token)
    SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rank FROM c ORDER BY n DESC, token LIMIT 100
""")
def q_token_frequency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent minified names (a top-k report)."""
    counts = text.frequencies(_document_tokens(spark, sf_dir).where(ids.is_minified(F.col("token"))), "token")
    top = counts.orderBy(F.desc("n"), "token").limit(100)
    held = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "token"))).alias("x"))
    return held.select(F.posexplode("x").alias("i", "r")).select("r.token", (-F.col("r.m")).alias("n"), (F.col("i") + 1).cast("long").alias("rank"))


@_query(f"""SELECT DISTINCT token, {_minified("token", "rename")} AS rename, {_minified("token", "residual")} AS residual, {_minified("token", "graph")} AS graph FROM ({_TOKENS})""")
def q_minified_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _document_tokens(spark, sf_dir).select("token").distinct()
    return found.select("token", *(ids.is_minified(F.col("token"), p).alias(p) for p in ("rename", "residual", "graph")))


_ENTROPY = "coalesce(list_aggregate(string_split(token, ''), 'entropy'), 0.0)"
_VOWELS = "length(regexp_replace(token, '[^aeiouAEIOU]', '', 'g')) / length(token)"
_SCORE = f"""CASE WHEN length(token) > 8 OR length(token) = 0 THEN 0.0 WHEN length(token) = 1 THEN 0.9
    ELSE greatest(0.0, 1 - (length(token) - 1) / 6) * 0.4 + least(1.0, {_ENTROPY} / 4) * 0.35
    + (CASE WHEN {_VOWELS} < 0.2 THEN 0.7 WHEN {_VOWELS} > 0.4 THEN 0.3 ELSE 0.5 END) * 0.25 END"""


@_query(f"SELECT token, round({_ENTROPY}, 6) AS entropy FROM (SELECT DISTINCT token FROM ({_TOKENS}))")
def q_token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _document_tokens(spark, sf_dir).select("token").distinct()
    return found.select("token", F.round(ids.entropy(F.col("token")), 6).alias("entropy"))


@_query(f"SELECT token, round({_SCORE}, 6) AS score FROM (SELECT DISTINCT token FROM ({_TOKENS}))")
def q_minification_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _document_tokens(spark, sf_dir).select("token").distinct()
    return found.select("token", F.round(ids.minification_score(F.col("token")), 6).alias("score"))


_NAME = f"""CASE WHEN n // 54 = 0 THEN substr('{ids.NAME_CHARS}', n % 54 + 1, 1)
    WHEN (n // 54 - 1) // 64 = 0 THEN substr('{ids.NAME_CHARS}', n % 54 + 1, 1) || substr('{ids.NAME_MORE}', (n // 54 - 1) % 64 + 1, 1)
    ELSE substr('{ids.NAME_CHARS}', n % 54 + 1, 1) || substr('{ids.NAME_MORE}', (n // 54 - 1) % 64 + 1, 1) || substr('{ids.NAME_MORE}', ((n // 54 - 1) // 64 - 1) % 64 + 1, 1) END"""


@_query(f"SELECT n, {_NAME} AS name FROM (SELECT range AS n FROM range(10000))")
def q_sequence_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(10000).select(F.col("id").alias("n"), ids.sequence_name(F.col("id")).alias("name"))


@_query(f"""
    WITH c AS (SELECT token, count(*) AS n FROM ({_TOKENS}) GROUP BY token),
    s AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS rank FROM c WHERE round({_SCORE}, 9) > 0.4),
    q AS (SELECT n AS place, {_NAME} AS name FROM (SELECT range AS n FROM range(5000)))
    SELECT token, n, rank, place, coalesce(abs(place - rank) < 20, false) AS rank_match,
      CASE WHEN n > 100 THEN 'critical' WHEN n > 20 THEN 'high' WHEN n > 5 THEN 'medium' ELSE 'low' END AS importance
    FROM s LEFT JOIN q ON token = name
""")
def q_rank_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = text.frequencies(_document_tokens(spark, sf_dir), "token")
    return naming.rank_identifiers(counts, name="token")


@_query(f"""SELECT d.doc_id, t.token, round(1 - (instr(d.text, t.token) - 1) / length(d.text), 6) AS score
    FROM documents d JOIN (SELECT DISTINCT doc_id, token FROM ({_TOKENS})) t USING (doc_id)""")
def q_positional_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    each = docs.select("doc_id", F.explode(F.array_distinct(F.transform(text.identifiers(F.col("text")), lambda x: x))).alias("token"), "text")
    at = F.call_function("locate", F.col("token"), F.col("text")) - 1
    return each.select("doc_id", "token", F.round(ids.positional_score(at, F.length("text")), 6).alias("score"))


@_query(r"""SELECT p_partkey, CASE WHEN regexp_matches(c, '^[a-zA-Z_$]') THEN c ELSE '_' || c END AS name
    FROM (SELECT p_partkey, regexp_replace(p_size || ' ' || p_name || '-' || p_type, '[^a-zA-Z0-9_$]', '_', 'g') AS c FROM part)""")
def q_to_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit("-"), "p_type")
    return _t(spark, sf_dir, "part").select("p_partkey", ids.to_identifier(raw).alias("name"))


def _camel_sql(words: str) -> str:
    return f"array_to_string(list_transform({words}, lambda w, i: CASE WHEN i = 1 THEN lower(w) ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), '')"


@_query(f"SELECT p_partkey, {_camel_sql("string_split(upper(replace(p_type, ' ', '_')), '_')")} AS name FROM part")
def q_scream_to_camel(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.upper(F.replace("p_type", F.lit(" "), F.lit("_")))
    return _t(spark, sf_dir, "part").select("p_partkey", ids.scream_to_camel(raw).alias("name"))


_PARTS = r"list_filter(regexp_split_to_array(p_brand || '.the.' || p_type || '_' || p_name, '[._\s-]+'), lambda p: length(p) > 1 AND NOT regexp_matches(p, '(?i)^(the|a|an|of|for|in|on|by)$'))"


@_query(f"""SELECT p_partkey, CASE WHEN len(m) = 0 THEN 'namedSym' ELSE 'sym_' || substr({_camel_sql("list_transform(m[-3:], lambda p: regexp_replace(lower(p), '[^a-z0-9]', '', 'g'))")}, 1, 28) END AS name
    FROM (SELECT p_partkey, {_PARTS} AS m FROM part)""")
def q_symbol_key_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("p_brand", F.lit(".the."), "p_type", F.lit("_"), "p_name")
    return _t(spark, sf_dir, "part").select("p_partkey", ids.symbol_key_name(key).alias("name"))


@_query(rf"""SELECT l.o, CASE WHEN length(s) BETWEEN 5 AND 80 AND regexp_matches(s, '[a-zA-Z]{{3}}') THEN
      CASE WHEN regexp_matches(s, '\s') AND len(w) >= 2 THEN substr({_camel_sql("w[1:3]")}, 1, 30) || 'Msg'
      WHEN regexp_matches(s, '^[a-z][a-zA-Z0-9]{{3,20}}$') AND regexp_matches(s, '[A-Z_-]') THEN 'K_' || substr(regexp_replace(s, '[^a-zA-Z0-9_]', '_', 'g'), 1, 24) END END AS name
    FROM (SELECT o_orderkey AS o, s, list_filter(regexp_split_to_array(s, '\s+'), lambda x: regexp_matches(x, '^[A-Za-z][a-z]+$')) AS w
      FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority || ' order of Clerk' WHEN 1 THEN 'onOrder' || o_orderkey ELSE o_orderstatus END AS s FROM orders)) l""")
def q_string_literal_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = F.when(k % 3 == 0, F.concat("o_orderpriority", F.lit(" order of Clerk"))).when(k % 3 == 1, F.concat(F.lit("onOrder"), k.cast("string"))).otherwise(F.col("o_orderstatus"))
    return _t(spark, sf_dir, "orders").select(k.alias("o"), ids.string_literal_name(s).alias("name"))


@_query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM documents")
def q_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", ids.line_count(F.col("text")).cast("long").alias("lines"))


@_query("""SELECT doc_id, md5(CASE WHEN starts_with(s, '#!') THEN regexp_replace(s, '^#![^' || chr(10) || ']*' || chr(10), '') ELSE s END) AS digest
    FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '#!/usr/bin/env node' || chr(10) || text ELSE text END AS s FROM documents)""")
def q_strip_shebang(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("#!/usr/bin/env node\n"), "text")).otherwise(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(ids.strip_shebang(s).cast("binary")).alias("digest"))


_MARKED = "CASE page_id % 4 WHEN 0 THEN '/* 12 */' WHEN 1 THEN '// node_modules/a' WHEN 2 THEN 'var q = R(() => {' ELSE '' END"


@_query(rf"""SELECT page_id, CASE WHEN regexp_matches(s, '__webpack_require__|__webpack_exports__|__webpack_modules__') THEN 'webpack5' WHEN regexp_matches(s, '/\*+\s*\d+\s*\*+/') THEN 'webpack4'
      WHEN regexp_matches(s, '(?i)/\* rollup \|') THEN 'rollup' WHEN regexp_matches(s, '// node_modules/') THEN 'esbuild'
      WHEN regexp_matches(s, 'var\s+\w+\s*=\s*\w+\s*\(\s*\(\s*\)\s*=>') THEN 'copilot' WHEN regexp_matches(s, 'Object\.defineProperty\(exports,\s*[''"]__esModule[''"]') THEN 'commonjs' ELSE 'unknown' END AS format
    FROM (SELECT page_id, html || {_MARKED} AS s FROM pages)""")
def q_detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat("html", F.expr(_MARKED))
    return _t(spark, sf_dir, "pages").select("page_id", ids.detect_format(s).alias("format"))


@_query(r"""SELECT doc_id, i - 1 AS ordinal, 'module_' || (i - 1) AS name, md5(p[i]) AS digest
    FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS p FROM documents))""")
def q_split_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = text.split_numbered(_t(spark, sf_dir, "documents"), "doc_id", "text", r"\n")
    return parts.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "name", F.md5(F.col("code").cast("binary")).alias("digest"))


#: Rules for the events table: type, event, score.
_VOTES = (("click", "fn", 3), ("click", "handler", 2), ("view", "handler", 3), ("purchase", "number", 4), ("purchase", "fn", 1), ("signup", "promise", 3), ("error", "error", 6))
_VOTES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _VOTES) + ") v(event_type, type, score)"


@_query(f"""WITH s AS (SELECT user_id, type, sum(v.score) AS score, min(event_id) AS ordinal FROM events JOIN {_VOTES_SQL} USING (event_type) GROUP BY user_id, type)
    SELECT user_id, type, score::BIGINT AS score FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ordinal, type) = 1""")
def q_best_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.broadcast(_rows(spark, list(_VOTES), "event_type string, type string, score int"))
    votes = _t(spark, sf_dir, "events").join(rules, "event_type").select("user_id", "type", "score", F.col("event_id").alias("ordinal"))
    return evidence.best_type(votes, ["user_id"]).select("user_id", "type", "score")


@_query("""SELECT user_id, count(DISTINCT event_type) * 9 AS score, arg_min(event_type || 'Handler', event_id) AS handler FROM events GROUP BY user_id""")
def q_event_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("handler", F.concat("event_type", F.lit("Handler")))
    return evidence.event_pivot(e, ["user_id"], "event_type", "handler", "event_id")


_SHAPES = (("buyer", 9, 1, 2, ("purchase", "view", "click")), ("newcomer", 8, 2, 1, ("signup", "view")), ("faulty", 7, 3, 1, ("error",)), ("reader", 8, 4, 2, ("view", "click")))
_SHAPE_ROWS = [(n, n, s, o, r, p) for n, s, o, r, ps in _SHAPES for p in ps]
_SHAPE_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', {c}, {d}, {e}, '{f}')" for a, b, c, d, e, f in _SHAPE_ROWS) + ") r(rule, name, score, ordinal, required, prop)"
_SHAPE_SCHEMA = "rule string, name string, score int, ordinal int, required int, prop string"
_FEW = "(SELECT DISTINCT user_id, event_type FROM events)"


def _user_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    return evidence.shapes(e, ["user_id"], "event_type")


@_query(f"""WITH z AS (SELECT rule, count(*) AS size FROM {_SHAPE_SQL} GROUP BY rule),
    h AS (SELECT user_id, rule, name, score, ordinal, size, count(*) AS hits FROM {_FEW} f JOIN {_SHAPE_SQL} ON prop = event_type JOIN z USING (rule) GROUP BY ALL)
    SELECT user_id, name, floor(score * hits / size + 0.5)::BIGINT AS score FROM h WHERE score * hits / size >= 4
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score * hits / size DESC, ordinal, name) = 1""")
def q_shape_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _rows(spark, _SHAPE_ROWS, _SHAPE_SCHEMA).drop("required")
    return evidence.shape_matches(_user_shapes(spark, sf_dir), rules, ["user_id"], "event_type")


@_query(f"""WITH h AS (SELECT user_id, rule, name, score, ordinal, required, count(*) AS hits FROM {_FEW} f JOIN {_SHAPE_SQL} ON prop = event_type GROUP BY ALL)
    SELECT user_id, name, score FROM h WHERE hits >= required QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ordinal, name) = 1""")
def q_namespace_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.namespace_matches(_user_shapes(spark, sf_dir), _rows(spark, _SHAPE_ROWS, _SHAPE_SCHEMA), ["user_id"], "event_type")
    return found.select("user_id", "name", "score")


@_query(f"""WITH h AS (SELECT user_id, type, score FROM {_FEW} f JOIN {_VOTES_SQL} USING (event_type)), s AS (SELECT user_id, type, sum(score) AS s FROM h GROUP BY ALL),
    c AS (SELECT user_id, count(*) AS hits FROM h GROUP BY user_id), b AS (SELECT * FROM s JOIN c USING (user_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, type) = 1)
    SELECT user_id, type, round(least(s * CASE WHEN hits >= 3 THEN 1.0 WHEN hits = 2 THEN 0.85 ELSE 0.65 END, 9)::DOUBLE, 4) AS score FROM b WHERE least(s * CASE WHEN hits >= 3 THEN 1.0 WHEN hits = 2 THEN 0.85 ELSE 0.65 END, 9) >= 3""")
def q_property_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _rows(spark, list(_VOTES), "prop string, type string, score int")
    found = evidence.property_types(_user_shapes(spark, sf_dir), rules, ["user_id"], "event_type")
    return found.select("user_id", "type", F.round("score", 4).alias("score"))


@_query("""WITH s AS (SELECT o_custkey, o_orderstatus, count(*) AS w FROM orders GROUP BY ALL), t AS (SELECT o_custkey, sum(w) AS total FROM s GROUP BY ALL)
    SELECT o_custkey, o_orderstatus, w, total::BIGINT AS total FROM s JOIN t USING (o_custkey) WHERE 5 * w >= 3 * total AND w >= 3
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, o_orderstatus) = 1""")
def q_dominant_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _t(spark, sf_dir, "orders").withColumn("one", F.lit(1))
    return evidence.dominant_type(votes, ["o_custkey"], "o_orderstatus", "one")


_EVIDENCE_SQL = """SELECT c_custkey AS id, 1 AS phase_rank, 'init' || c_nationkey AS candidate, c_custkey % 7 + 2 AS score FROM customer
    UNION ALL SELECT c_custkey, 2, 'usage' || c_nationkey, c_custkey % 5 + 3 FROM customer UNION ALL SELECT c_custkey, 7, 'alias', 6 FROM customer WHERE c_acctbal < 0"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    init = c.select(k.alias("id"), F.lit(1).alias("phase_rank"), F.concat(F.lit("init"), F.col("c_nationkey").cast("string")).alias("candidate"), (k % 7 + 2).alias("score"))
    usage = c.select(k.alias("id"), F.lit(2).alias("phase_rank"), F.concat(F.lit("usage"), F.col("c_nationkey").cast("string")).alias("candidate"), (k % 5 + 3).alias("score"))
    alias = c.where("c_acctbal < 0").select(k.alias("id"), F.lit(7).alias("phase_rank"), F.lit("alias").alias("candidate"), F.lit(6).cast("long").alias("score"))
    return init.unionByName(usage).unionByName(alias)


@_query(f"SELECT id, candidate, score, phase_rank FROM ({_EVIDENCE_SQL}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, phase_rank) = 1")
def q_evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.merge_evidence(_evidence(spark, sf_dir), ["id"]).select("id", "candidate", "score", "phase_rank")


#: Bases that look like other bases with numbers: a, a_2, a_3, a_2_2.
_BASE_SQL = "CASE p_partkey % 10 WHEN 0 THEN {a} || '_2' WHEN 3 THEN {a} || '_3' WHEN 7 THEN {a} || '_2_2' ELSE {a} END"
_BASE = _BASE_SQL.format(a="split_part(p_name, ' ', 1)")


@_query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT p_partkey AS id, p_brand AS brand, {_BASE} AS base, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part),
    r AS (SELECT brand, 0::BIGINT AS turn, []::VARCHAR[] AS taken, NULL::VARCHAR AS new, NULL::BIGINT AS id FROM (SELECT DISTINCT brand FROM p) UNION ALL
      SELECT brand, turn, list_append(taken, new), new, id FROM (SELECT p.brand, p.turn, r.taken, p.id, CASE WHEN NOT list_contains(r.taken, base) THEN base ELSE base || '_' || list_filter(range(2, len(r.taken) + 3), lambda k: NOT list_contains(r.taken, base || '_' || k))[1] END AS new
        FROM r JOIN p ON p.brand = r.brand AND p.turn = r.turn + 1))
    SELECT id, new AS unique_name FROM r WHERE id IS NOT NULL""")
def q_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names unique within a brand; the SQL goes through them one by one."""
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.expr(_BASE).alias("base"))
    return evidence.unique_names(rows, "base", ["id"], ["p_brand"]).select("id", "unique_name")


@_query(f"""WITH m AS (SELECT id, candidate FROM ({_EVIDENCE_SQL}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, phase_rank) = 1)
    SELECT id, CASE WHEN n = 1 THEN candidate ELSE candidate || '_' || n END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY id) AS n FROM m)""")
def q_numbered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names unique over the whole table, numbered in sorted ranges."""
    merged = evidence.merge_evidence(_evidence(spark, sf_dir), ["id"])
    return evidence.unique_names(merged, "candidate", ["id"]).select("id", "unique_name")


@_query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE coalesce('seed_' || lang, lang) END AS candidate
    FROM documents LEFT JOIN labels USING (doc_id)""")
def q_seed_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    names = docs.select("doc_id", "lang", F.when(F.col("quality") == 1, "good").alias("candidate"))
    seeds = docs.select(F.col("lang").alias("mangled"), F.concat(F.lit("seed_"), "lang").alias("semantic")).distinct()
    return evidence.seed_fallback(names, seeds, "lang").select("doc_id", "candidate")


@_query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.residual(_t(spark, sf_dir, "documents").select("doc_id", "lang"), _t(spark, sf_dir, "labels"), "doc_id")


@_query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 50 AS batch FROM orders")
def q_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return evidence.batches(rows, ["o_totalprice", "o_orderkey"], 50).select("o_orderkey", "batch")


@_query(r"""WITH raw AS (SELECT p_partkey AS key, replace(p_name, ' ', '_') AS value FROM part), m AS (SELECT p_partkey AS key, replace(p_name, ' ', '_') AS value FROM part WHERE p_size = 1)
    SELECT key, value FROM raw WHERE key IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND length(value) BETWEEN 3 AND 60 AND regexp_matches(value, '^[a-zA-Z_$][a-zA-Z0-9_$]*$') AND key NOT IN (SELECT key FROM m) AND value NOT IN (SELECT value FROM m)
    QUALIFY row_number() OVER (PARTITION BY value ORDER BY key) = 1""")
def q_accept_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    raw = part.select(F.col("p_partkey").alias("key"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("value"), F.col("p_partkey").alias("ordinal"), "p_size")
    asked = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("key"))
    found = evidence.accept_names(raw.drop("p_size"), asked, raw.where("p_size = 1").select("key", "value"))
    return found.select("key", "value")


@_query("""SELECT p_partkey, CASE WHEN n = 1 THEN p_brand ELSE p_brand || n END AS final FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n <= 9""")
def q_number_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.number_suffixes(_t(spark, sf_dir, "part"), "p_brand", ["p_partkey"]).select("p_partkey", "final")


@_query("""WITH u AS (SELECT doc_id, 'label' AS v, 0 AS origin FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, lang, 1 FROM documents)
    SELECT doc_id, v, origin FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY origin) = 1""")
def q_union_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _t(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("label").alias("v"))
    return evidence.union_by_priority([good, _t(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("v"))], "doc_id", "v")


@_query("SELECT event_type, count(*) AS n, min(event_id) AS first, arg_min(props, event_id) AS sample FROM events GROUP BY event_type")
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.histogram(_t(spark, sf_dir, "events"), ["event_type"], "event_id", "props")


@_query("SELECT l_orderkey, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1")
def q_conflict_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with several candidates are left alone."""
    found = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("at"))
    return evidence.agreed(found, ["l_orderkey"], "flag", "at").select("l_orderkey", "flag")


_EDGES = """SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS weight FROM (SELECT c.n_name AS a, s.n_name AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation c ON c_nationkey = c.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s_nationkey = s.n_nationkey) WHERE a <> b GROUP BY ALL"""


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that trade with one another: 25 nodes."""
    nation = _t(spark, sf_dir, "nation")
    buys = _t(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("a"))
    sells = _t(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("b"))
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = lines.join(buys, F.col("o_custkey") == F.col("c_custkey")).join(sells, F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.edge_weights(pairs.select("a", "b", F.lit(1).alias("w")), "a", "b", "w")


@_query(_EDGES)
def q_edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trade(spark, sf_dir)


@_query(f"SELECT src, dst, weight FROM ({_EDGES}) WHERE weight >= 2 AND src IN (SELECT n_name FROM nation WHERE n_regionkey <> 1) AND dst IN (SELECT n_name FROM nation WHERE n_regionkey <> 1)")
def q_edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.filter_edges(_trade(spark, sf_dir), _t(spark, sf_dir, "nation").where("n_regionkey <> 1"), "n_name")


def _pagerank_sql(rounds: int) -> str:
    ctes = [f"e AS MATERIALIZED ({_EDGES})", "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)", "o AS (SELECT src, sum(weight) AS total FROM e GROUP BY src)",
            "s AS MATERIALIZED (SELECT e.src, e.dst, e.weight / o.total AS share FROM e JOIN o ON e.src = o.src)", "r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n)"]
    for k in range(rounds):
        ctes.append(f"r{k + 1} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85::DOUBLE * coalesce(sum(r.rank * s.share), 0) AS rank FROM n LEFT JOIN s ON s.dst = n.node LEFT JOIN r{k} r ON r.node = s.src GROUP BY n.node)")
    return f"WITH {', '.join(ctes)} "


@_query(_pagerank_sql(20) + "SELECT node, round(rank, 9) AS rank FROM r20")
def q_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(_trade(spark, sf_dir)).select("node", F.round("rank", 9).alias("rank"))


def _labels_sql(rounds: int) -> str:
    ctes = [f"e AS MATERIALIZED ({_EDGES})", "l0 AS (SELECT src AS node, src AS label FROM e UNION SELECT dst, dst FROM e)"]
    for k in range(rounds):
        ctes.append(f"v{k} AS (SELECT e.src, l.label, sum(e.weight) AS w FROM e JOIN l{k} l ON e.dst = l.node GROUP BY ALL)")
        ctes.append(f"l{k + 1} AS MATERIALIZED (SELECT l.node, coalesce(b.label, l.label) AS label FROM l{k} l LEFT JOIN (SELECT src, label FROM v{k} QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, label) = 1) b ON b.src = l.node)")
    return f"WITH {', '.join(ctes)} "


@_query(_labels_sql(10) + "SELECT node, label FROM l10")
def q_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.label_propagation(_trade(spark, sf_dir))


@_query("""SELECT n_name AS node, r_name AS label, s AS rank, row_number() OVER (PARTITION BY r_name ORDER BY s DESC, n_name) AS place
    FROM (SELECT n_name, r_name, count(*) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) QUALIFY place <= 3""")
def q_top_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ranks = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("rank")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    found = graph.top_seeds(nation.select(F.col("n_name").alias("node"), F.col("r_name").alias("label")), ranks.select(F.col("n_name").alias("node"), "rank"))
    return found.select("node", "label", "rank", F.col("place").cast("long").alias("place"))


def _propagate_sql(rounds: int) -> str:
    ctes = ["w AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst, n_nationkey % 4 + 3 AS link FROM nation UNION ALL SELECT (n_nationkey * 7 + 3) % 25, n_nationkey, n_nationkey % 4 + 3 FROM nation))",
            "k0 AS (SELECT n_nationkey AS node, 't' || n_regionkey AS type, n_regionkey + 4 AS score FROM nation WHERE n_nationkey % 9 = 0)"]
    for k in range(rounds):
        ctes.append(f"k{k + 1} AS MATERIALIZED (SELECT node, type, score FROM (SELECT * FROM k{k} UNION ALL SELECT w.dst, k.type, least(w.link, k.score) FROM w JOIN k{k} k ON w.src = k.node WHERE w.dst NOT IN (SELECT node FROM k0)) QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, type) = 1)")
    return f"WITH {', '.join(ctes)} SELECT node, type, score FROM k{rounds}"


@_query(_propagate_sql(25))
def q_propagate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    links = n.select(((k * 7 + 3) % 25).alias("lhs"), k.alias("alias"), (k % 4 + 3).alias("score"))
    base = n.where("n_nationkey % 9 = 0").select(k.alias("node"), F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("type"), (F.col("n_regionkey") + 4).alias("score"))
    return graph.propagate_types(links, base)


#: Places of words in a turn, in thousandths of their number.
_PLACES = f"SELECT key, w[i + 1] AS token, 1000 * i // len(w) AS spot FROM (SELECT key, w, unnest(range(0, len(w))) AS i FROM (SELECT conv_id * 1000 + turn AS key, regexp_extract_all(text, '{ids.IDENTIFIER}') AS w FROM conversations))"


@_query(f"""WITH t AS (SELECT conv_id * 1000 + turn AS k, unnest(range(0, len(w))) AS at, unnest(w) AS name FROM (SELECT conv_id, turn, regexp_extract_all(text, '{ids.IDENTIFIER}') AS w FROM conversations)),
    p AS (SELECT x.name AS a, y.name AS b FROM t x JOIN t y ON x.k = y.k AND y.at > x.at AND y.at < x.at + 10 WHERE x.name <> y.name)
    SELECT a, b, count(*) AS n FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) GROUP BY ALL""")
def q_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return graph.cooccurrence(text.tokens(c, "k", "text"), "k", "ordinal", "name")


_RENAMES = (("the", "theNamed"), ("of", "ofNamed"), ("and", "and_2"))


@_query("""SELECT conv_id, turn, md5(replace(replace(replace(replace(replace(regexp_replace(t, '([A-Za-z_$][A-Za-z0-9_$]*)', chr(1) || '\\1' || chr(2), 'g'), chr(1) || 'the' || chr(2), 'theNamed'), chr(1) || 'of' || chr(2), 'ofNamed'),
    chr(1) || 'and' || chr(2), 'and_2'), chr(1), ''), chr(2), '')) AS digest FROM (SELECT conv_id, turn, CASE WHEN turn % 7 = 0 THEN NULL ELSE text END AS t FROM conversations)""".replace("\\\\1", "\\1"))
def q_rename_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with new names; the key is a conversation, so that many rows share it, and some texts are null."""
    c = _t(spark, sf_dir, "conversations").withColumns({"k": F.struct("conv_id", "turn"), "t": F.when(F.col("turn") % 7 != 0, F.col("text"))})
    done = text.apply_renames(c, "k", "t", _rows(spark, list(_RENAMES), "mangled string, semantic string"))
    return done.select("k.conv_id", "k.turn", F.md5(F.col("renamed").cast("binary")).alias("digest"))


@_query("SELECT event_id, 'k' AS mangled, json_extract_string(props, '$.k') AS semantic FROM events")
def q_json_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds, a JSON object of names, as rows."""
    e = _t(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("mangled", "semantic"))
    return e.select("event_id", "mangled", "semantic")


@_query()
def q_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random by contract; the dice are hashes, so a run repeats."""
    seeds = _t(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_name").alias("node"))
    return graph.independent_cascade(_trade(spark, sf_dir), seeds)


@_query()
def q_greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _trade(spark, sf_dir)
    matrix = graph.both_ways(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("n"))
    return graph.greedy_clusters(matrix, 5)



_SCRIPT = r"SELECT page_id * 100 + i - 1 AS key, s[i] AS s FROM (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<script[^>]*>([^<]*(?:<[^<]*)*?)</script>', 1) AS s FROM pages))"


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, text: all inline scripts of every page."""
    scripts = F.regexp_extract_all("html", F.lit(r"<script[^>]*>([^<]*(?:<[^<]*)*?)</script>"), F.lit(1))
    each = _t(spark, sf_dir, "pages").select("page_id", F.posexplode(scripts).alias("k", "text"))
    return each.select((F.col("page_id") * 100 + F.col("k")).alias("key"), "text")


@_query(rf"""SELECT key, 'variable' AS kind, regexp_extract(s, '\bvar (\w+)=', 1) AS name, 1::BIGINT AS line FROM ({_SCRIPT}) WHERE regexp_matches(s, '\bvar \w+=')""")
def q_symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols of every page's script, by the parser."""
    found = naming.symbols(facts(_scripts(spark, sf_dir), "key", "text"))
    return found.select("key", "kind", "name", F.col("line").cast("long").alias("line"))


@_query(rf"""SELECT key, kind, detail, (score + 1000 * spot // length(s))::BIGINT AS score FROM ({_SCRIPT}),
    (VALUES ('binding', '', 0, 4), ('symbol', 'variable', 0, 0), ('vote', 'function', 3, 0), ('use', '', 0, 13), ('init', 'str', 3, 0), ('decl', 'Literal', 0, 0)) v(kind, detail, score, spot) WHERE regexp_matches(s, '^var t="</p>";track\(\d+\);$')""")
def q_source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of the scripts: one declared text and one call of a number."""
    found = facts(_scripts(spark, sf_dir), "key", "text")
    return found.select("key", "kind", "detail", F.col("score").cast("long").alias("score"))


#: A program for each part: a command, an instance, an alias, a promise, a handler; all names but the last are minified.
_PROGRAM = """'var ab="/' || lower(replace(p_brand, '#', '')) || '";var cd=new ' || CASE WHEN p_size > 25 THEN 'Map' ELSE 'Set' END
    || '();var ef=cd;var px=run' || p_partkey || '();px.then(cd);px.catch(cd);var hh;cd.on("' || CASE WHEN p_size > 25 THEN 'close' ELSE 'error' END || '",hh);var readableName=ab;'"""


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.expr(_PROGRAM).alias("text"))


_NEW_NAMES = """SELECT p_partkey AS key, mangled, semantic FROM (SELECT p_partkey, unnest(['ab', 'cd', 'ef', 'px', 'hh']) AS mangled,
    unnest(['CMD_' || upper(replace(p_brand, '#', '')), CASE WHEN p_size > 25 THEN 'map' ELSE 'set' END, CASE WHEN p_size > 25 THEN 'registry' ELSE 'pool' END, 'promise', CASE WHEN p_size > 25 THEN 'closeHandler' ELSE 'errorHandler' END]) AS semantic FROM part)"""


@_query(_NEW_NAMES)
def q_rename_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of many programs at once: initializers, usage, events, links."""
    return naming.rename_map(facts(_programs(spark, sf_dir), "key", "text")).select("key", "mangled", "semantic")


@_query(f"""SELECT p_partkey AS key, md5(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\bab\\b', 'CMD_' || upper(replace(p_brand, '#', '')), 'g'), '\\bef\\b', CASE WHEN p_size > 25 THEN 'registry' ELSE 'pool' END, 'g'),
    '\\bcd\\b', CASE WHEN p_size > 25 THEN 'map' ELSE 'set' END, 'g'), '\\bpx\\b', 'promise', 'g'), '\\bhh\\b', CASE WHEN p_size > 25 THEN 'closeHandler' ELSE 'errorHandler' END, 'g'), ';', ';' || chr(10)), chr(13), '')) AS digest
    FROM (SELECT p_partkey, p_brand, p_size, {_PROGRAM} AS t FROM part)""")
def q_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs laid out, with their new names."""
    done = recover.recover(_programs(spark, sf_dir)).renamed
    return done.select("key", F.md5(F.col("text").cast("binary")).alias("digest"))


@_query(f"SELECT key, md5(replace(s, ';', ';' || chr(10))) AS digest FROM ({_SCRIPT})")
def q_beautify(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = beautify(_scripts(spark, sf_dir), "text")
    return done.select("key", F.md5(F.col("pretty").cast("binary")).alias("digest"))


@_query(rf"""WITH d AS (SELECT DISTINCT conv_id * 1000 + turn AS key, text, unnest(regexp_extract_all(text, '{ids.IDENTIFIER}')) AS name FROM conversations), s AS (SELECT *, instr(text, name) AS spot FROM d),
    p AS (SELECT key, name, string_split(substr(text, 1, spot - 1), chr(10))[-1] AS head, array_to_string(string_split(substr(text, spot), chr(10))[1:8], chr(10)) AS tail FROM s)
    SELECT key, name, md5(substr(trim(head || tail, ' '), 1, 600)) AS digest FROM p""")
def q_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines from the first place of every identifier of a turn on, as a namer is shown them."""
    c = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    rest = text.tokens(c, "key", "text").select("key", "name").distinct()
    return namer.contexts(rest, c).select("key", "name", F.md5(F.col("context").cast("binary")).alias("digest"))


@_query()
def q_context_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most telling places of every minified name of every document."""
    names = F.array_distinct(F.filter(text.identifiers(F.col("text")), lambda n: ids.is_minified(n, "rename")))
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", names.alias("names"))
    return namer.snippets(docs).select(F.col("key").alias("doc_id"), "name", F.md5(F.col("snippets").cast("binary")).alias("digest"))


_PLACED = f"""SELECT key, name, (sum(length(g) + length(name)) OVER (PARTITION BY key ORDER BY i) - length(name))::BIGINT AS pos FROM (SELECT conv_id * 1000 + turn AS key, unnest(range(0, len(w))) AS i, unnest(w) AS name, unnest(g[1:len(w)]) AS g
    FROM (SELECT conv_id, turn, regexp_extract_all(text, '{ids.IDENTIFIER}') AS w, regexp_split_to_array(text, '{ids.IDENTIFIER}') AS g FROM conversations))"""


@_query(f"""WITH t AS ({_PLACED}), p AS (SELECT x.key, x.name, y.name AS neighbour, count(*) AS n FROM t x JOIN t y ON x.key = y.key AND abs(x.pos - y.pos) <= 100 AND x.name <> y.name
    WHERE length(x.name) <= 3 AND length(y.name) >= 6 GROUP BY ALL HAVING count(*) >= 2)
    SELECT key, name, neighbour, n FROM p QUALIFY row_number() OVER (PARTITION BY key, name ORDER BY n DESC, neighbour) = 1""")
def q_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every short word of a turn the long one that is most often near."""
    c = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    toks = text.placed_tokens(c, "key", "text")
    return namer.neighbour_votes(toks, toks.where(F.length("name") <= 3), toks.where(F.length("name") >= 6))


@_query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: counts by hour, as the stream computes them."""
    return ingest.windowed_counts(_t(spark, sf_dir, "events"), "ts", "event_type")


def queries() -> dict[str, Query]:
    from factloom.plans import programs  # noqa: F401 - registers its queries

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
