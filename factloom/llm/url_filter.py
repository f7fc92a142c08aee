"""URL filter by rules and a character language-model ratio, in DataFrame operations only.

URLs that a host and path rule covers are judged by it, and they train two
variable-order Markov models of characters, one of accepted and one of
rejected URLs: contexts of up to ``order - 1`` characters, counts of all
orders from one aggregation of the longest, and Witten-Bell interpolation
(a context that is new or varied leans on the shorter one).  The other URLs
are judged by the difference of the two log-likelihoods, divided by the
length.  The threshold is the one with the least balanced error on a fifth of
the covered URLs (by hash) that the models don't learn from.

Counts are over all rows.  The only numbers that reach the driver are a row
count and the threshold.

Defined cases: a null URL, or one without ``://``, has an empty host and path;
what is left without a character to score is allowed.  Equal rows give a row
each; null ids stay null; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, heavy_keys, join_split


@dataclass(frozen=True)
class UrlFilter:
    """``rules``: (verdict, host and path)."""

    rules: tuple[tuple[str, str], ...] = (
        ("allow", "com/"),
        ("block", "example.com/en/"),
        ("allow", "www.example.com/en/"),
        ("block", "net/es/"),
        ("block", "net/fr/"),
    )
    order: int = 5
    alphabet: int = 256
    folds: int = 5
    bin_width: float = 0.02
    broadcast_bytes: int = 32 << 20


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return lower_ascii(host), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, r in sorted(rules, key=lambda x: len(x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def model_text(url: Column) -> Column:
    """What the models read: no scheme, ASCII in lower case, every digit a 0."""
    return F.translate(lower_ascii(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")), "123456789", "000000000")


def grams(text: Column, order: int) -> Column:
    """All runs of ``order`` characters of the text between its marks."""
    marked = F.concat(F.lit("\u0002" * (order - 1)), text, F.lit("\u0003"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(marked, i, order))


def ratio_table(counts: DataFrame, order: int, alphabet: int) -> DataFrame:
    """(gram, ratio): log P(last | rest) in the accepted model less that in the rejected one.

    ``counts``: gram, a, b (how often accepted and rejected URLs hold it).
    """
    below: DataFrame | None = None
    for k in range(1, order + 1):
        level = counts if k == order else counts.groupBy(F.substring("gram", order - k + 1, k).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        level = level.withColumn("context", F.substring("gram", 1, k - 1))
        totals = level.groupBy("context").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb"))
        level = level.join(totals, "context")
        if below is None:
            level = level.withColumns({"qa": F.lit(1.0 / alphabet), "qb": F.lit(1.0 / alphabet)})
        else:
            shorter = below.select(F.col("gram").alias("shorter"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            level = level.withColumn("shorter", F.substring("gram", 2, k - 1)).join(shorter, "shorter")

        def smooth(n: str, total: str, kinds: str, less: str) -> Column:
            weight = F.col(total) + F.col(kinds)
            return F.when(weight > 0, (F.col(n) + F.col(kinds) * F.col(less)) / weight).otherwise(F.col(less))

        below = level.select("gram", smooth("a", "na", "ta", "qa").alias("pa"), smooth("b", "nb", "tb", "qb").alias("pb"))
    return below.select("gram", (F.log("pa") - F.log("pb")).alias("ratio"))


def threshold(scored: DataFrame, width: float) -> float:
    """The bin edge with the least balanced error of rows (verdict, score); 0 if a verdict is missing.

    Scores are gathered in bins of ``width`` between -10 and 10, so that a
    thousand rows at most are ordered, however many URLs there are.
    """
    spot = F.floor(F.least(F.greatest("score", F.lit(-10.0)), F.lit(10.0)) / width).cast("int")
    bins = scored.groupBy(spot.alias("bin")).agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    held = bins.agg(F.array_sort(F.collect_list(F.struct("bin", "a", "b"))).alias("x")).first()["x"]
    a, b = sum(x["a"] for x in held), sum(x["b"] for x in held)
    if not a or not b:
        return 0.0
    best, lost, passed = (float("inf"), 0.0, 0.0), 0, b
    for x in held:
        edge = x["bin"] * width
        best = min(best, (lost / a + passed / b, abs(edge), edge))
        lost, passed = lost + x["a"], passed - x["b"]
    return best[2]


def judge(pages: DataFrame, params: UrlFilter | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides) for every row."""
    p = params or UrlFilter()
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"))
    host, path = host_and_path(F.col("url"))
    base = base.select("page_id", host.alias("host"), path.alias("path"), model_text(F.col("url")).alias("text"))
    rule, by_rule = rule_of(F.col("host"), F.col("path"), p.rules)
    base = base.select("page_id", "host", "path", "text", rule.alias("rule"), by_rule.alias("by_rule"))
    texts = base.groupBy("text", "by_rule").agg(F.count("*").alias("n")).where("text <> ''")
    texts = cut(texts.withColumn("held", (F.pmod(F.xxhash64("text"), F.lit(p.folds)) == 0) & F.col("by_rule").isNotNull()), "urls")
    learns = F.when(F.col("held"), 0).otherwise(F.col("n"))
    runs = texts.select(F.explode(grams(F.col("text"), p.order)).alias("gram"), F.when(F.col("by_rule") == "allow", learns).otherwise(0).alias("a"), F.when(F.col("by_rule") == "block", learns).otherwise(0).alias("b"))
    ratios = cut(ratio_table(cut(runs.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "grams"), p.order, p.alphabet), "ratios")
    asked = texts.where("held or by_rule is null").select("text", "by_rule", "n", F.explode(grams(F.col("text"), p.order)).alias("gram"))
    if ratios.count() * 64 <= p.broadcast_bytes:
        rated = asked.join(F.broadcast(ratios), "gram")
    else:  # frequent grams are few: their ratios go to the rows
        counts = cut(asked.groupBy("gram").agg(F.count("*").alias("c")), "counts")
        total = counts.agg(F.sum("c")).first()[0] or 0
        rated = join_split(asked, ratios, ["gram"], heavy_keys(counts, ["gram"], "c", total))
    scores = rated.groupBy("text", "by_rule", "n").agg((F.sum("ratio") / F.count("*")).alias("score"))
    scores = cut(scores, "scores")
    at = threshold(scores.where("by_rule is not null").select(F.col("by_rule").alias("verdict"), "score"), p.bin_width)
    free = scores.where("by_rule is null").select(F.col("text").alias("scored"), "score")
    judged = base.join(free, (F.col("text") == F.col("scored")) & F.col("by_rule").isNull(), "left")
    verdict = F.coalesce("by_rule", F.when(F.col("score") < at, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))
