"""Readable layout of minified source: one statement a line, indented by braces; tokens stay as they are."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|[\w$#]+(?:\.\d+)?|[^\S\n]+|\n|[\s\S]"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_BEFORE_REGEX = re.compile(r"[\w$)\]}]$")
_WORD_BEFORE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await"}


def _template_end(source: str, at: int) -> int:
    """The place after the template that begins at ``at``; inner templates included."""
    depth, at = [0], at + 1
    while at < len(source):
        c = source[at]
        if c == "\\":
            at += 1
        elif depth[-1] == 0 and c == "`":
            depth.pop()
            if not depth:
                return at + 1
        elif depth[-1] == 0 and source.startswith("${", at):
            depth[-1] = 1
            at += 1
        elif depth[-1] > 0:
            if c == "`":
                depth.append(0)
            else:
                depth[-1] += (c == "{") - (c == "}")
        at += 1
    return len(source)


def pieces(source: str) -> Iterator[str]:
    """The text in tokens that must stay whole: strings, templates, expressions, comments, words, single signs."""
    at, last = 0, ""
    while at < len(source):
        c = source[at]
        if c == "`":
            end = _template_end(source, at)
        elif c == "/" and source[at + 1 : at + 2] not in ("/", "*") and (last in _WORD_BEFORE or not _BEFORE_REGEX.search(last)) and (m := _REGEX.match(source, at)):
            end = m.end()
        else:
            end = _TOKEN.match(source, at).end()
        piece = source[at:end]
        yield piece
        if piece.strip() and not piece.startswith(("//", "/*")):
            last = piece
        at = end


def layout(source: str, indent: int = 2) -> str:
    """Statements on lines of their own; braces of blocks and literals indent what is in them."""
    out: list[str] = []
    level, parens, fresh = 0, [0], True
    texts = list(pieces(source))

    def line() -> None:
        nonlocal fresh
        if not fresh:
            while out and out[-1] == " ":
                out.pop()
            out.append("\n")
            fresh = True

    for k, p in enumerate(texts):
        if p == "\n" or p.isspace():
            if "\n" in p:
                line()
            elif not fresh:
                out.append(" ")
            continue
        if p == "}":
            line()
            level, _ = max(level - 1, 0), len(parens) > 1 and parens.pop()
        if fresh:
            out.append(" " * (indent * level))
            fresh = False
        out.append(p)
        if p == "{":
            level += 1
            parens.append(0)
            line()
        elif p == "(":
            parens[-1] += 1
        elif p == ")":
            parens[-1] = max(parens[-1] - 1, 0)
        elif p == ";" and parens[-1] == 0 or p.startswith("//"):
            line()
        elif p == "}":
            after = next((t for t in texts[k + 1 : k + 4] if not t.isspace()), "")
            if after and after not in (")", ",", ";", ".", "]", "(", "}", "else", "catch", "finally", "while", "[", "?", ":", "=", "`") and parens[-1] == 0:
                line()
    return "".join(out).strip("\n") + ("\n" if source else "")


def beautify(df: DataFrame, text: str, indent: int = 2, out: str = "pretty") -> DataFrame:
    """Texts laid out; null stays null.  One text at a time is in a worker's hands."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else layout(t, indent))

    return df.withColumn(out, run(F.col(text).cast("string")))
