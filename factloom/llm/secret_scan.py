"""Secret scans over a trigram inverted index, in DataFrame operations only.

From every rule's regular expression a Boolean query over trigrams is derived
(an OR of ANDs).  The trigrams that the queries name are the index's
dictionary; its postings, rows (trigram, document key), are one pass of
substring searches and one table in the shared folder.  Joined with the
clauses and counted by document, they give the candidates, and only those
are verified with the rule's expression.  A rule without mandatory trigrams
scans all texts.

Keys are hashes of id and text: should two documents share one, both become
candidates, and the verification still decides.

Defined cases: a null text is empty; equal rows give a row each; null ids
stay null; extra columns are ignored.  Positions count code points, ends are
exclusive, and matches of a kind don't overlap (leftmost first).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, text_or_empty

parser, ops = re._parser, re._constants  # the standard library's own syntax trees

#: Larger sets of exact strings or of clauses are not carried on.
MOST = 64


@dataclass(frozen=True)
class Rule:
    """``least`` characters of ``group`` are needed; shorter matches are dropped, not searched again."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three, and their order, are fixed by contract.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repository_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)
BASE = ("assign", "access", "hex")

Query = frozenset  # of clauses; a clause is a frozenset of trigrams; the empty clause is true
TRUE: Query = frozenset([frozenset()])


def _either(*queries: Query) -> Query:
    clauses = frozenset().union(*queries)
    kept = frozenset(c for c in clauses if not any(d < c for d in clauses))
    return kept if len(kept) <= MOST and all(len(c) < 63 for c in kept) else TRUE


def _both(a: Query, b: Query) -> Query:
    joined = _either(frozenset(x | y for x, y in product(a, b)))
    return joined if joined != TRUE else (b if a == TRUE else a)  # too many clauses: one side alone is weaker, and right


def _of_strings(strings: set[str]) -> Query:
    return _either(*(frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings)) if strings else TRUE


def _analyse(items) -> tuple[set[str] | None, Query]:
    """All strings (lower-case) that a part matches, if few, and its query."""
    run, query, exact = {""}, TRUE, True
    for op, value in items:
        strings, part = _node(op, value)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a, b in product(run, strings)}
            continue
        query, exact = _both(query, _of_strings(run)), False
        query = _both(query, part)
        run = strings if strings is not None else {""}
    if exact:
        return run, _of_strings(run)
    return None, _both(query, _of_strings(run))


def _node(op, value) -> tuple[set[str] | None, Query]:
    if op is ops.LITERAL:
        return {chr(value).lower()}, TRUE
    if op is ops.IN:
        found: set[str] = set()
        for kind, x in value:
            if kind is ops.LITERAL:
                found.add(chr(x).lower())
            elif kind is ops.RANGE and x[1] - x[0] < 8:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, TRUE
        return (found, TRUE) if len(found) <= 8 else (None, TRUE)
    if op is ops.SUBPATTERN:
        return _analyse(value[-1])
    if op is ops.BRANCH:
        parts = [_analyse(x) for x in value[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), _either(*(q for _, q in parts))
        return None, _either(*(q for _, q in parts))
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
        low, high, body = value
        strings, query = _analyse(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, TRUE
        if low == 0:
            return None, TRUE
        if low == high and strings is not None and len(strings) ** low <= MOST:
            return {"".join(x) for x in product(strings, repeat=low)}, TRUE
        return None, query
    return None, TRUE


def trigram_query(pattern: str) -> Query:
    """The OR of ANDs of lower-case trigrams that any match's text holds; ``TRUE`` if none is mandatory."""
    return _analyse(parser.parse(pattern))[1]



def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key) for each of ``trigrams`` in the lower-case text of ``keyed`` (key, text)."""
    low = keyed.select("key", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("key", F.explode(found).alias("trigram")).select("trigram", "key")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): for each document the rules whose query its postings fulfil."""
    spark = index.sparkSession
    rows = [(kind, n, t, 1 << k, (1 << len(clause)) - 1) for kind, q in queries.items() for n, clause in enumerate(sorted(q, key=sorted)) for k, t in enumerate(sorted(clause))]
    # the clauses come from the rules, not from the data: a few hundred rows at most
    clauses = F.broadcast(spark.createDataFrame(rows, "kind string, clause int, trigram string, bit long, needed long"))
    hit = index.join(clauses, "trigram").groupBy("key", "kind", "clause", "needed").agg(F.bit_or("bit").alias("have")).where("have = needed")
    return hit.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, rank, end, kind>> of a rule's matches in ``text``.

    Starts are sums of the lengths of the texts between the matches and of the
    matches before.
    """
    p = F.lit(rule.pattern)
    hits, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, rule.pattern, -1)
    part = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else hits
    zipped = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("gap"), part.alias("part"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the column ``__fl_spans``: all matches by start, then by the rules' order."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != TRUE}
    trigrams = sorted({t for q in indexed.values() for c in q for t in c})
    key = F.xxhash64(F.col(id_col), text_or_empty(text_col))
    index = cut(postings(docs.select(key.alias("key"), text_or_empty(text_col).alias("text")), trigrams), "postings")
    found = candidates(index, indexed).select(F.col("key").alias("__fl_key"), F.col("kinds").alias("__fl_kinds"))
    named = docs.withColumn("__fl_doc", key)
    joined = named.join(found, F.col("__fl_doc") == F.col("__fl_key"), "left")
    text, none = text_or_empty(text_col), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    each = []
    for order, r in enumerate(rules):
        if r.kind in indexed:
            use = F.coalesce(F.array_contains("__fl_kinds", r.kind), F.lit(False))
        elif re.fullmatch(r"\[[^\]]+\]\+", r.pattern) and not r.group:
            use = text.rlike(f"{r.pattern[:-1]}{{{r.least}}}")  # a run that is long enough
        else:
            use = text.rlike(r.pattern)
        each.append(F.when(use, spans_of(text, r, order)).otherwise(none))
    return joined.select(*(named[c] for c in docs.columns), F.array_sort(F.concat(*each)).alias("__fl_spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans``, an array<struct<kind, start, end>>, for every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = find_spans(slim, rules)
    return found.select("doc_id", F.transform("__fl_spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; overlapping spans count as one.

    ``n_chars``, where there is such a column, follows the changed text.
    """
    found = find_spans(docs, rules, text_col, id_col)
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        touching = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"])
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        fresh = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        return F.when(touching, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    text = F.col(text_col)
    merged = F.aggregate("__fl_spans", empty, step)
    ends = F.concat(F.array(F.lit(0)), F.transform(merged, lambda s: s["end"]))
    starts = F.concat(F.transform(merged, lambda s: s["start"]), F.array(F.length(text)))
    kept = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.substring(text, x["a"] + 1, x["b"] - x["a"]))
    changed = F.size("__fl_spans") > 0
    new = F.when(changed, F.array_join(kept, mark)).otherwise(text)
    out = found.withColumn("__fl_new", new)
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("__fl_new").alias(c))
        elif c == "n_chars":
            columns.append(F.when(changed, F.length("__fl_new")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
