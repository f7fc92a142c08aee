"""Tokens, splitting and rewriting of source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.identifiers import IDENTIFIER, detect_format
from factloom.plans.scratch import bound_batches, cut


def identifiers(text: Column) -> Column:
    """All identifiers of a text, in order."""
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, name): one row for each identifier."""
    return df.select(key, F.posexplode(identifiers(F.col(text))).alias("ordinal", "name"))


def placed_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, name, pos, before, after): identifiers with their place and the gaps around them.

    Places are running sums over one text's tokens, so a task holds a text at a time.
    """
    gaps = F.split(F.col(text), IDENTIFIER, -1)
    both = F.arrays_zip(identifiers(F.col(text)).alias("name"), gaps.alias("before"), F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("after"))
    rows = df.select(key, F.posexplode(both).alias("ordinal", "t")).where("t.name is not null")
    end = F.sum(F.length("t.before") + F.length("t.name")).over(Window.partitionBy(key).orderBy("ordinal"))
    return rows.select(key, "ordinal", "t.name", (end - F.length("t.name")).alias("pos"), "t.before", "t.after")


def frequencies(toks: DataFrame, name: str = "name") -> DataFrame:
    return toks.groupBy(name).agg(F.count("*").alias("n"))


def split_numbered(df: DataFrame, key: str, text: str, pattern: str, prefix: str = "module_") -> DataFrame:
    """The parts between marks; blank ones go before the rest is numbered."""
    parts = F.filter(F.split(F.col(text), pattern, -1), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    return df.select(key, F.posexplode(parts).alias("ordinal", "code")).withColumn("name", F.concat(F.lit(prefix), F.col("ordinal").cast("string")))


def split_banners(df: DataFrame, key: str, text: str) -> DataFrame:
    """Parts that begin with a ``// node_modules/<path>`` banner, named by the path; what is before is ``chunk_0``."""
    parts = F.filter(F.split(F.col(text), r"(?=// node_modules/)", -1), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    rows = df.select(key, F.posexplode(parts).alias("ordinal", "code"))
    path = F.regexp_extract("code", r"// node_modules/([^\n]+)", 1)
    clean = F.regexp_replace(F.replace(path, F.lit("/"), F.lit("_")), r"[^a-zA-Z0-9_.]", "")
    return rows.withColumn("name", F.when(path == "", F.concat(F.lit("chunk_"), F.col("ordinal").cast("string"))).otherwise(clean))


def split_wrappers(df: DataFrame, key: str, text: str) -> DataFrame:
    """Modules ``var x = f(() => {...})``, nested ones as well, to the brace that closes them and one character more.

    Braces in strings count.  One pass over each text finds where every brace closes.
    """
    import re

    import pandas as pd

    # fixed value: the head of a module
    header = re.compile(r"var\s+(\w+)\s*=\s*\w+\s*\(\s*\(\s*\)\s*=>\s*\{", re.ASCII)

    def run(frames):
        for frame in frames:
            out = []
            for k, source in zip(frame[key], frame[text], strict=True):
                source = source or ""
                closes, open_ = {}, []
                for m in re.finditer(r"[{}]", source):
                    if m[0] == "{":
                        open_.append(m.start())
                    elif open_:
                        closes[open_.pop()] = m.start()
                at, ordinal = 0, 0
                while (m := header.search(source, at)) is not None:
                    at = m.end()
                    if m.end() - 1 in closes:
                        out.append((k, ordinal, source[m.start() : closes[m.end() - 1] + 2], m[1]))
                        ordinal += 1
            yield pd.DataFrame(out, columns=[key, "ordinal", "code", "name"])

    kind = dict(df.dtypes)[key]
    bound_batches(df.sparkSession)
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, ordinal int, code string, name string")


def extract_modules(df: DataFrame, key: str, text: str) -> DataFrame:
    """The modules of every text whose format can be split: key, ordinal, code, name, format."""
    known = df.withColumn("format", detect_format(F.col(text)))
    parts = {
        "webpack4": lambda d: split_numbered(d, key, text, r"/\*+\s*\d+\s*\*+/"),
        "esbuild": lambda d: split_banners(d, key, text),
        "copilot": lambda d: split_wrappers(d, key, text),
    }
    found = None
    for name, split in parts.items():
        part = split(known.where(F.col("format") == name)).select(key, "ordinal", "code", "name").withColumn("format", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


def apply_renames(df: DataFrame, key: str, text: str, renames: DataFrame, out: str = "renamed", broadcast_rows: int = 200_000) -> DataFrame:
    """Texts with whole identifiers replaced; ``renames``: mangled, semantic, one row a name.

    One row for each row of ``df``, whatever its key; a null text stays null.
    Unknown identifiers stay.  Tokens are joined with the map (broadcast if it
    has ``broadcast_rows`` rows at most) and put back between the gaps.
    """
    rows = cut(df.select(key, F.col(text).alias("__text")).withColumn("__row", F.monotonically_increasing_id()), "texts")
    pieces = rows.where("__text is not null").select("__row", identifiers(F.col("__text")).alias("ids"), F.split(F.col("__text"), IDENTIFIER, -1).alias("gaps"))
    parts = pieces.select("__row", F.posexplode("gaps").alias("at", "gap"), "ids").select("__row", "at", "gap", F.get("ids", F.col("at")).alias("mangled"))
    names = renames.select("mangled", "semantic")
    names = F.broadcast(names) if names.count() <= broadcast_rows else names
    piece = F.concat("gap", F.coalesce("semantic", "mangled", F.lit("")))
    line = F.transform(F.array_sort(F.collect_list(F.struct("at", piece.alias("p")))), lambda x: x["p"])
    done = parts.join(names, "mangled", "left").groupBy("__row").agg(F.array_join(line, "").alias(out))
    return rows.select(key, "__row").join(done, "__row", "left").select(key, out)


def module_scopes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, name, exports, module): the heads ``name = f((exports, module) => {`` of lazy modules."""
    head = r"(?:var|let|const|,)?\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*[A-Za-z_$][A-Za-z0-9_$]*\(\(([A-Za-z_$][A-Za-z0-9_$]*),\s*([A-Za-z_$][A-Za-z0-9_$]*)\)\s*=>\s*\{"
    groups = [F.regexp_extract_all(F.col(text), F.lit(head), F.lit(k)).alias(n) for k, n in ((1, "name"), (2, "exports"), (3, "module"))]
    return df.select(key, F.posexplode(F.arrays_zip(*groups)).alias("ordinal", "m")).select(key, "ordinal", "m.name", "m.exports", "m.module")


def markdown_table(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A Markdown table of symbols (kind, name, line) for each key."""
    line = F.concat(F.lit("| "), F.col("kind"), F.lit(" | `"), F.col("name"), F.lit("` | "), F.col("line").cast("string"), F.lit(" |"))
    body = F.array_sort(F.collect_list(F.struct(order, line.alias("l"))))
    text = F.array_join(F.transform(body, lambda x: x["l"]), "\n")
    return rows.groupBy(key).agg(F.concat(F.lit("| Kind | Name | Line |\n|------|------|------|\n"), text).alias("markdown"))


def symbols_json(rows: DataFrame, key: str, order: str) -> DataFrame:
    body = F.transform(F.array_sort(F.collect_list(F.struct(order, "kind", "name", "line"))), lambda x: F.struct(x["kind"].alias("kind"), x["name"].alias("name"), x["line"].alias("line")))
    return rows.groupBy(key).agg(F.to_json(F.struct(F.count("*").alias("total"), body.alias("symbols"))).alias("json"))
