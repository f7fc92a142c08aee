"""Names from an outside namer: contexts, batches, prompts, answers, rounds.

A namer is any function from a prompt to an answer that Python workers can
import; none that uses a network is included.  ``plain_namer`` answers from the
contexts alone.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.identifiers import IDENTIFIER, context_lines, context_window, pattern_contexts, valid_answer
from factloom.operators import evidence
from factloom.plans.scratch import bound_batches, cut

Namer = Callable[[str], str]


@dataclass(frozen=True)
class Profile:
    """What a model takes: characters of context for a name, names in a batch, words in an answer."""

    context: int
    characters: int
    batch: int
    answer: int


# Profiles by a part of the model's name, the first that fits; the last is for all others.
PROFILES = (
    ("opus", Profile(128_000, 2000, 50, 16_000)),
    ("sonnet", Profile(128_000, 1600, 60, 12_000)),
    ("gpt-4o-mini", Profile(128_000, 1000, 30, 3_000)),
    ("gpt-4o", Profile(128_000, 1600, 60, 6_000)),
    ("", Profile(32_000, 600, 10, 1_200)),
)


def profile(model: str) -> Profile:
    return next(p for part, p in PROFILES if part in model.lower())


def choose_model(available: list[str], wanted: list[str]) -> str | None:
    """The first wanted model that is there, by a part of its name; else the first that is there."""
    return next((a for w in wanted for a in available if w.lower() in a.lower()), available[0] if available else None)

STRICT = "Name these identifiers of a program. Answer with one JSON object of old and new names; leave out those that you are not sure of."
EAGER = "Name every one of these identifiers of a program, with your best guess. Answer with one JSON object of old and new names."


def contexts(rest: DataFrame, sources: DataFrame, most: int = 600) -> DataFrame:
    """key, name, context: the lines from a name's first place on."""
    return rest.select("key", "name").join(sources.select("key", "text"), "key").select("key", "name", context_lines(F.col("text"), F.col("name"), most=most).alias("context"))


#: Snippets of so many names, or characters, about, are handed on at once.
SNIPPET_ROWS, SNIPPET_CHARS = 4096, 4_000_000
_IDENTIFIER, _SPACES, _RUNS, _USED = re.compile(IDENTIFIER), re.compile(r"\s+", re.ASCII), re.compile(r"\s{2,}", re.ASCII), re.compile(r" *[.(]")
# fixed value: what may end a line, where an expression's ``$`` also matches
_ENDS = ("\r\n", "\n", "\r", "\x85", "\u2028", "\u2029")


def _after_sign(gap: str) -> bool:
    gap = gap.rstrip(" ")
    if gap.endswith(_ENDS):
        gap = gap.removesuffix(next(e for e in _ENDS if gap.endswith(e)))
    return gap.endswith(("=", ",", "("))


def snippets_of(source: str, names: Iterable[str], around: int = 400, k: int = 5, most: int = 400) -> Iterator[tuple[str, str]]:
    """(name, snippets) of one text: a pass for the places, another for the spaces; a place's snippet is a slice.

    Places are taken from the most telling on until ``k`` different snippets are found.
    """
    wanted: dict[str, list[tuple[int, int]]] = {n: [] for n in names}
    last, used = 0, _USED.match
    for m in _IDENTIFIER.finditer(source):
        start, end = m.span()
        places = wanted.get(m[0])
        if places is not None:
            gap = source[last:start]
            score = (2 if gap != " " and _after_sign(gap) else 0) + (1 if used(source, end) else 0)
            places.append((-score, start))
        last = end
    flat = _SPACES.sub(" ", source)
    begins, ends, gone = [], [], [0]
    for m in _RUNS.finditer(source):
        begins.append(m.start())
        ends.append(m.end())
        gone.append(gone[-1] + m.end() - m.start() - 1)

    def place(at: int) -> int:
        """Where a place of the text is once its runs of spaces are single ones."""
        r = bisect.bisect_left(begins, at) - 1
        return at if r < 0 else at - gone[r] - min(at, ends[r]) + begins[r] + 1

    for name, places in wanted.items():
        found: dict[str, None] = {}
        places.sort()
        for _, start in places:
            found[flat[place(max(start - around, 0)) : place(start + around + len(name))].strip(" ")[:most]] = None
            if len(found) == k:
                break
        if found:
            yield name, " | ".join(found)


def snippets(sources: DataFrame, around: int = 400, k: int = 5) -> DataFrame:
    """key, name, snippets, as :func:`occurrences`, of the ``names`` (an array) of each text; every text is read once, where it is."""
    kind = dict(sources.dtypes)["key"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, held, size = batch.column(0), [], 0

            def made(keys=keys, held=held):
                whose, names, told = zip(*held, strict=True)
                return pa.RecordBatch.from_arrays([keys.take(pa.array(whose, pa.int64())), pa.array(names, pa.string()), pa.array(told, pa.string())], ["key", "name", "snippets"])

            for i, (source, names) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                for name, told in snippets_of(source.as_py() or "", names.as_py() or (), around, k):
                    held.append((i, name, told))
                    size += len(told)
                    if len(held) >= SNIPPET_ROWS or size >= SNIPPET_CHARS:
                        yield made()
                        held.clear()
                        size = 0
            if held:
                yield made()

    bound_batches(sources.sparkSession)
    return sources.select("key", "text", "names").mapInArrow(run, f"key {kind}, name string, snippets string")


def occurrences(rest: DataFrame, sources: DataFrame, around: int = 400, k: int = 5) -> DataFrame:
    """key, name, snippets: of all whole-word places the ``k`` most telling distinct ones.

    A place scores 2 after ``=``, ``,`` or ``(`` and 1 before ``.`` or ``(``; ties go to the earlier.
    """
    names = rest.groupBy("key").agg(F.collect_set("name").alias("names"))
    return snippets(sources.select("key", "text").join(names, "key"), around, k)


def windows(rest: DataFrame, sources: DataFrame) -> DataFrame:
    """key, name, context: ten lines from a name's first place on, or 600 characters on both sides where its line is long."""
    return rest.select("key", "name").join(sources.select("key", "text"), "key").select("key", "name", context_window(F.col("text"), F.col("name")).alias("context"))


def telling_contexts(rest: DataFrame, sources: DataFrame, most: int = 3) -> DataFrame:
    """key, name, contexts: the first declaration, assignment, call and property access of a name, ``most`` of them."""
    return rest.select("key", "name").join(sources.select("key", "text"), "key").select("key", "name", F.slice(pattern_contexts(F.col("text"), F.col("name")), 1, most).alias("contexts"))


def neighbour_votes(toks: DataFrame, rest: DataFrame, named: DataFrame, near: int = 100, least: int = 2) -> DataFrame:
    """key, name, neighbour, n: the named identifier that is most often within ``near`` characters of an uncertain one.

    ``toks``: key, name, pos; ``rest``: name; ``named``: name.  Places are
    joined by bands of ``near`` characters, so that no text's pairs are all
    formed; ties go to the smaller name.
    """
    band = F.floor(F.col("pos") / near)
    asked = toks.join(rest.select("name").distinct(), "name", "left_semi").select("key", "name", "pos", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    others = toks.join(named.select("name").distinct(), "name", "left_semi").select("key", F.col("name").alias("neighbour"), F.col("pos").alias("at"), band.alias("band"))
    pairs = asked.join(others, ["key", "band"]).where((F.abs(F.col("pos") - F.col("at")) <= near) & (F.col("name") != F.col("neighbour")))
    counts = pairs.groupBy("key", "name", "neighbour").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return evidence.argmax(counts, ["key", "name"], "n", "neighbour")


def neighbour_names(votes: DataFrame, named: DataFrame) -> DataFrame:
    """key, name, semantic: the first word of the neighbour's new name with ``Ctx``, numbered up to 29 takers.

    ``named``: name, semantic.
    """
    first = F.regexp_extract("semantic", r"^_*([A-Z]?[a-z0-9]+|[A-Z]+)", 1)
    words = votes.join(named.select(F.col("name").alias("neighbour"), "semantic"), "neighbour").select("key", "name", "n", F.concat(first, F.lit("Ctx")).alias("base"))
    return evidence.number_suffixes(words.withColumn("down", -F.col("n")), "base", ["down", "key", "name"], 29, "semantic").select("key", "name", "semantic")


def prompts(batch: DataFrame, eager: bool = False) -> DataFrame:
    """batch, names, prompt: one row for each batch of (batch, name, context)."""
    item = F.struct("name", F.concat(F.lit("- "), "name", F.lit(": "), F.col("context")).alias("line"))
    items = F.array_sort(F.collect_list(item))
    found = batch.groupBy("batch").agg(items.alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["line"]), "\n")
    return found.select("batch", F.transform("items", lambda x: x["name"]).alias("names"), F.concat(F.lit((EAGER if eager else STRICT) + "\n"), body).alias("prompt"))


def json_blocks(text: str) -> Iterator[str]:
    """Outermost blocks in braces; braces in strings do not count."""
    depth, start, at = 0, 0, 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}]', text):
        at = m.start()
        if m[0] == "{":
            start = at if depth == 0 else start
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                yield text[start : at + 1]


def parse_answer(text: str, expected: list[str]) -> dict[str, str]:
    """The block with the most expected names; where none is JSON, the quoted pairs of the longest."""
    blocks, asked = list(json_blocks(text or "")), set(expected)
    best: dict[str, str] = {}
    read = False
    for block in blocks:
        try:
            found = json.loads(block)
        except ValueError:
            continue
        good = {k: v for k, v in found.items() if isinstance(v, str)}
        if not read or len(good.keys() & asked) > len(best.keys() & asked):
            best, read = good, True
    if not read:
        longest = max(blocks or [text or ""], key=len)
        best = dict(re.findall(r'"([A-Za-z_$][\w$]*)"\s*:\s*"([A-Za-z_$][\w$]*)"', longest))
    return {k: v for k, v in best.items() if k in asked}


def plain_namer(prompt: str) -> str:
    """A name for each line from the longest other word in its context."""
    found = {}
    for name, context in re.findall(r"^- ([\w$]+): (.*)$", prompt, re.MULTILINE):
        words = [w for w in re.findall(r"[A-Za-z]{5,}", context) if w != name and w not in ("const", "function", "return", "undefined")]
        if words:
            found[name] = max(words, key=len)[:26] + "Ctx"
    return json.dumps(found)


def ask(batches: DataFrame, namer: Namer = plain_namer) -> DataFrame:
    """key, value, ordinal: usable answers to all prompts, by name (:func:`prompts`)."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(k, v, int(b)) for b, names, prompt in zip(frame["batch"], frame["names"], frame["prompt"], strict=True) for k, v in parse_answer(namer(prompt), list(names)).items()]
            yield pd.DataFrame(rows, columns=["key", "value", "ordinal"])

    return batches.select("batch", "names", "prompt").mapInPandas(run, "key string, value string, ordinal long").where(valid_answer(F.col("value")))


def first_answer(answers: list[DataFrame]) -> DataFrame:
    """Answers of several namers; the earlier one's stays."""
    return evidence.union_by_priority(answers, "key", "value").select("key", "value")


def fill_gaps(rest: DataFrame, merged: DataFrame, namer: Namer = plain_namer, size: int = 100, rounds: int = 3) -> DataFrame:
    """Rounds of asking about the names that are left, ``rest`` (name, context), until no answer is taken.

    ``merged``: key, value of the names that are given; the result adds the new ones.
    """
    done = cut(merged.select("key", "value"), "merged")
    for k in range(rounds):
        left = rest.join(done.select(F.col("key").alias("name")), "name", "left_anti")
        asked = cut(evidence.batches(left, ["name"], size), "asked")
        raw = cut(ask(prompts(asked, eager=k > 0), namer), "answers")
        taken = cut(evidence.accept_names(raw, asked.select(F.col("name").alias("key")), done).select("key", "value"), "taken")
        if taken.isEmpty():
            break
        done = cut(done.unionByName(taken), "merged")
    return done


def name_rest(rest: DataFrame, sources: DataFrame, namer: Namer = plain_namer, size: int = 40, passes: int = 1, most: int | None = None) -> DataFrame:
    """key, name, candidate, pass: answers for the uncertain names of each source, the most used ones first.

    ``rest``: key, name, n.  The first pass asks in batches of ``size``, a
    second one asks about what is left, in batches of 30, for its best guess.
    ``most`` names of a source are asked about (all, if not given).
    """
    order = Window.partitionBy("key").orderBy(F.desc("n"), "name")
    placed = rest.select("key", "name", "n").withColumn("place", F.row_number().over(order) - 1)
    placed = cut(placed.where(F.col("place") < most) if most is not None else placed, "asked")
    told = cut(occurrences(placed, sources).withColumnRenamed("snippets", "context"), "contexts")
    done: DataFrame | None = None
    for k in range(1, passes + 1):
        left = placed if done is None else placed.join(done, ["key", "name"], "left_anti")
        many = size if k == 1 else min(30, size)
        batch = F.struct("key", F.floor((F.row_number().over(order) - 1) / many).alias("number"))
        batched = left.withColumn("batch", batch).join(told, ["key", "name"], "left").withColumn("context", F.coalesce("context", F.lit("")))
        asked = prompts(batched.select("batch", "name", "context"), eager=k > 1)
        rows = ask_keyed(asked.select(F.col("batch.key").alias("key"), "names", "prompt"), namer).where(F.col("candidate") != F.col("name"))
        new = cut(rows.join(placed.select("key", "name"), ["key", "name"], "left_semi").withColumn("pass", F.lit(k)), "answers")
        done = new if done is None else done.unionByName(new)
    return done


def ask_keyed(batches: DataFrame, namer: Namer) -> DataFrame:
    """key, name, candidate: usable answers to the prompts of each source."""
    kind = dict(batches.dtypes)["key"]

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(key, k, v) for key, names, prompt in zip(frame["key"], frame["names"], frame["prompt"], strict=True) for k, v in parse_answer(namer(prompt), list(names)).items()]
            yield pd.DataFrame(rows, columns=["key", "name", "candidate"])

    return batches.mapInPandas(run, f"key {kind}, name string, candidate string").where(valid_answer(F.col("candidate")))


def fill_until(rest: DataFrame, merged: DataFrame, target: float, namer: Namer = plain_namer, size: int = 100, rounds: int = 10) -> DataFrame:
    """:func:`fill_gaps`, a round at a time, until ``target`` per cent of all names are given or a round gives none."""
    total = rest.select("name").union(merged.select("key")).distinct().count()
    done = cut(merged.select("key", "value"), "merged")
    for _ in range(rounds):
        have = done.count()
        if 100 * have >= target * total:
            break
        done = fill_gaps(rest, done, namer, size, 1)
        if done.count() == have:
            break
    return done


def answer_pairs(answer: Column) -> Column:
    """A map from an answer with or without a code fence, in expressions only; pairs where it is no JSON object."""
    plain = F.regexp_replace(answer, r"```[a-z]*", "")
    block = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    pairs = F.arrays_zip(F.regexp_extract_all(plain, F.lit(r'"([A-Za-z_$][A-Za-z0-9_$]{1,5})"\s*:\s*"([^"]*)"'), F.lit(1)).alias("k"), F.regexp_extract_all(plain, F.lit(r'"([A-Za-z_$][A-Za-z0-9_$]{1,5})"\s*:\s*"([^"]*)"'), F.lit(2)).alias("v"))
    return F.coalesce(F.from_json(block, "map<string,string>"), F.map_from_entries(pairs))
