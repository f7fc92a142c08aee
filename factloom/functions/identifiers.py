"""Scalar functions over identifiers and source text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that are never taken for minified.
SKIP = (
    "i", "j", "k", "n", "s", "e", "t", "r", "x", "y", "ok", "id", "fn", "cb", "el",
    "ms", "db", "fs", "vm", "io", "os", "if", "do", "in", "of", "to", "is", "on",
    "by", "at", "up", "go", "no", "me", "my", "we",
)
SKIP_GRAPH = SKIP[:21]

#: The three presets of the minified test (shortest, longest, names skipped, pattern).
PRESETS = {
    "rename": (1, 7, SKIP, r"^[a-zA-Z$_][a-zA-Z0-9$_]{0,5}$"),
    "residual": (2, 7, SKIP, r"^[a-zA-Z$_][a-zA-Z0-9$_]{1,5}$"),
    "graph": (1, 7, SKIP_GRAPH, r"^[a-zA-Z$_][a-zA-Z0-9$_]{0,6}$"),
}

IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"

#: The alphabet of minified names; later places may also be digits.
NAME_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ$_"
NAME_MORE = NAME_CHARS + "0123456789"


def is_minified(name: Column, preset: str = "rename") -> Column:
    least, most, skip, pattern = PRESETS[preset]
    return F.length(name).between(least, most) & ~name.isin(*skip) & name.rlike(pattern)


def to_identifier(raw: Column) -> Column:
    clean = F.regexp_replace(raw, r"[^a-zA-Z0-9_$]", "_")
    return F.when(clean.rlike(r"^[a-zA-Z_$]"), clean).otherwise(F.concat(F.lit("_"), clean))


def _camel(words: Column, lower_rest: bool = True) -> Column:
    """The first word lower-case, the others with a capital."""

    def word(w: Column, i: Column) -> Column:
        rest = F.substring(w, 2, 10_000)
        rest = F.lower(rest) if lower_rest else rest
        return F.when(i == 0, F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), rest))

    return F.array_join(F.transform(words, word), "")


def symbol_key_name(key: Column) -> Column:
    """``a.long.key`` to ``sym_aLongKey``: at most the last three telling parts."""
    parts = F.filter(F.split(key, r"[._\s-]+"), lambda p: (F.length(p) > 1) & ~p.rlike(r"(?i)^(the|a|an|of|for|in|on|by)$"))
    last = F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3)
    clean = F.transform(last, lambda p: F.regexp_replace(F.lower(p), r"[^a-z0-9]", ""))
    return F.when(F.size(parts) == 0, "namedSym").otherwise(F.concat(F.lit("sym_"), F.substring(_camel(clean), 1, 28)))


def string_literal_name(text: Column) -> Column:
    """A name for a telling string literal, or null."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"^[A-Za-z][a-z]+$"))
    phrase = F.concat(F.substring(_camel(F.slice(words, 1, 3)), 1, 30), F.lit("Msg"))
    event = F.concat(F.lit("K_"), F.substring(F.regexp_replace(text, r"[^a-zA-Z0-9_]", "_"), 1, 24))
    fits = F.length(text).between(5, 80) & text.rlike(r"[a-zA-Z]{3}")
    is_phrase = text.rlike(r"\s") & (F.size(words) >= 2)
    is_event = text.rlike(r"^[a-z][a-zA-Z0-9]{3,20}$") & text.rlike(r"[A-Z_-]")
    return F.when(fits & is_phrase, phrase).when(fits & is_event, event)


def scream_to_camel(text: Column) -> Column:
    return _camel(F.split(text, "_"))


def to_camel(text: Column) -> Column:
    """Separators go and make the next letter a capital; the first is lower-case."""
    parts = F.filter(F.split(text, r"[^A-Za-z0-9]+"), lambda p: F.length(p) > 0)
    joined = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 10_000)))), "")
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, 2, 10_000))


def slug_name(elements: Column) -> Column:
    """The longest string of an array, the first of equal ones, in camel case."""
    longest = F.array_max(F.transform(elements, lambda e, i: F.struct(F.length(e).alias("n"), (-i).alias("i"), e.alias("e"))))
    return to_camel(longest["e"])


def core_name(name: Column) -> Column:
    """A name without its number and its generic suffix (all of it, where nothing would be left)."""
    plain = F.regexp_replace(name, r"_\d+$", "")
    core = F.regexp_replace(plain, r"(?:Mod|Cls|Obj|Fn|_2|_3)$", "")
    return F.when(core == "", plain).otherwise(core)


def entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty string."""
    n = F.length(text)

    def bits(c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)

    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(chars, F.lit(0.0), lambda a, c: a + bits(c)))


def minification_score(name: Column) -> Column:
    """0 for readable names to 1: shortness, entropy and few vowels."""
    n = F.length(name)
    vowels = F.length(F.regexp_replace(name, r"(?i)[^aeiou]", "")) / n
    vowel = F.when(vowels < 0.2, 0.7).when(vowels > 0.4, 0.3).otherwise(0.5)
    short = F.greatest(F.lit(0.0), 1 - (n - 1) / 6)
    mixed = F.least(F.lit(1.0), entropy(name) / 4) * 0.35
    return F.when((n > 8) | (n == 0), 0.0).when(n == 1, 0.9).otherwise(short * 0.4 + mixed + vowel * 0.25)


def sequence_name(n: Column) -> Column:
    """The n-th name (from 0) of a minifier that counts names up; right for n below 54 * 65 * 65."""
    first, more = len(NAME_CHARS), len(NAME_MORE)
    rest = F.floor(n / first)
    deeper = F.floor((rest - 1) / more)
    one = F.substring(F.lit(NAME_CHARS), (n % first + 1).cast("int"), F.lit(1))
    two = F.substring(F.lit(NAME_MORE), ((rest - 1) % more + 1).cast("int"), F.lit(1))
    three = F.substring(F.lit(NAME_MORE), ((deeper - 1) % more + 1).cast("int"), F.lit(1))
    return F.when(rest == 0, one).when(deeper == 0, F.concat(one, two)).otherwise(F.concat(one, two, three))


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def strip_shebang(text: Column) -> Column:
    return F.when(text.startswith("#!"), F.regexp_replace(text, r"^#![^\n]*\n", "")).otherwise(text)


def importance(count: Column) -> Column:
    return F.when(count > 100, "critical").when(count > 20, "high").when(count > 5, "medium").otherwise("low")


def positional_score(position: Column, length: Column) -> Column:
    """1 for the start of a text, near 0 for its end."""
    return 1 - position / length


def context_lines(text: Column, name: Column, lines: int = 8, most: int = 600) -> Column:
    """From the line of the first occurrence, so many lines, trimmed and cut; empty where there is none."""
    spot = F.call_function("locate", name, text)
    before = F.substring(text, F.lit(1), spot - 1)
    start = F.length(before) - F.length(F.substring_index(before, "\n", -1)) + 1
    rest = F.substring(text, spot, F.length(text))
    tail = F.substring_index(rest, "\n", lines)
    return F.when(spot == 0, "").otherwise(F.substring(F.trim(F.concat(F.substring(text, start, spot - start), tail)), 1, most))


def context_window(text: Column, name: Column, lines: int = 10, long_line: int = 500, radius: int = 600) -> Column:
    """The first occurrence with ``radius`` characters on both sides where its line is longer than ``long_line``; else ``lines`` lines from it on."""
    spot = F.call_function("locate", name, text)
    before = F.substring_index(F.substring(text, F.lit(1), spot - 1), "\n", -1)
    rest = F.substring(text, spot, F.length(text))
    line = F.length(before) + F.length(F.substring_index(rest, "\n", 1))
    left = F.greatest(spot - radius, F.lit(1))
    around = F.substring(text, left, spot - left + F.length(name) + radius)
    # the last line end belongs to it, but goes with the white space
    ahead = F.concat(before, F.substring_index(rest, "\n", lines))
    return F.when(spot == 0, "").otherwise(F.regexp_replace(F.when(line > long_line, around).otherwise(ahead), r"^\s+|\s+$", ""))


def pattern_contexts(text: Column, name: Column, most: int = 100) -> Column:
    """What stands at a name's first declaration, assignment, call and property access; those that there are, each cut."""
    word = F.concat(F.lit(r"\b"), F.regexp_replace(name, r"\$", r"\\\$"))
    patterns = (
        F.concat(F.lit(r"((?:var|let|const|function|class)\s+"), word, F.lit(r"\b[^\n]{0,80})")),
        F.concat(F.lit("("), word, F.lit(r"\s*=[^=\n][^\n]{0,80})")),
        F.concat(F.lit("("), word, F.lit(r"\([^\n]{0,80})")),
        F.concat(F.lit("("), word, F.lit(r"\.[^\n]{0,80})")),
    )
    found = F.array(*(F.substring(F.call_function("regexp_extract", text, p, F.lit(1)), 1, most) for p in patterns))
    return F.filter(found, lambda x: x != "")


#: Two more tests of minified names, of analyses: a letter first, then letters and digits; or anything after it.
SHORT_NAME = r"^[a-zA-Z][a-zA-Z0-9]{1,3}$"


def is_short(name: Column, any_rest: bool = False) -> Column:
    """Names of at most four characters that begin with a letter (of two to four letters and digits, unless ``any_rest``)."""
    return (F.length(name) <= 4) & name.rlike("^[a-zA-Z]") if any_rest else name.rlike(SHORT_NAME)


def valid_answer(name: Column) -> Column:
    """Whether a namer's answer can be used."""
    return name.isNotNull() & name.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]{1,30}$")


#: The marks of bundle formats, in the order in which they are tried.
FORMATS = (
    ("webpack5", r"(?:__webpack_require__|__webpack_exports__|__webpack_modules__)"),
    ("webpack4", r"/\*+\s*\d+\s*\*+/"),
    ("rollup", r"(?i)/\* rollup \|"),
    ("esbuild", r"// node_modules/"),
    ("copilot", r"var\s+\w+\s*=\s*\w+\s*\(\s*\(\s*\)\s*=>"),
    ("commonjs", r"Object\.defineProperty\(exports,\s*['\"]__esModule['\"]"),
)


def detect_format(text: Column) -> Column:
    found = F.lit("unknown")
    for name, pattern in reversed(FORMATS):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found
