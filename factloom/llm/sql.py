"""DuckDB SQL of the queries that SQL can express over whole tables.

The SQL states results plainly, without the operators' indexes: expressions
over every text, windows counted by digest, shingles joined with shingles.
"""

from __future__ import annotations

from factloom.llm import decontaminate, license_scan, secret_scan


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _secrets() -> str:
    """Every rule's matches of every text; starts are sums over the gaps and matches before."""
    rules = []
    for rank, r in enumerate(secret_scan.RULES):
        pattern, least = r.pattern, r.least
        if not r.group and pattern.endswith("]+") and least > 1:
            fixed = 4 if pattern.startswith("AKIA") else 0  # a run is as long as it can be, so short ones need not be listed
            pattern = f"{pattern[:-1]}{{{least - fixed},}}"
        p = _text(pattern)
        part = f"regexp_extract_all(text, {p}, {r.group})" if r.group else "hits"
        rules.append(f"""SELECT row, doc_id, {rank} AS rank, '{r.kind}' AS kind, {least} AS least, hits, gaps, {part} AS parts
            FROM (SELECT *, regexp_extract_all(text, {p}) AS hits, regexp_split_to_array(text, {p}) AS gaps FROM d WHERE regexp_matches(text, {p}))""")
    base = ", ".join(f"'{k}'" for k in secret_scan.BASE)
    span = "kind || ':' || first || ':' || past"
    counts = ", ".join(f"(count(*) FILTER (WHERE kind = '{k}'))::BIGINT AS n_{k}" for k in secret_scan.BASE)
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
        m AS ({" UNION ALL ".join(rules)}),
        u AS (SELECT row, rank, kind, least, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(parts) AS part FROM m),
        e AS (SELECT *, (sum(length(gap) + length(hit)) OVER (PARTITION BY row, rank ORDER BY i))::BIGINT AS past FROM u),
        s AS (SELECT row, rank, kind, past - length(hit) AS first, past FROM e WHERE length(part) >= least),
        g AS (SELECT row, {counts}, string_agg({span}, ',' ORDER BY first, rank) FILTER (WHERE kind IN ({base})) AS base, string_agg({span}, ',' ORDER BY first, rank) AS spans FROM s GROUP BY row)
        SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (row)"""


def _licenses() -> str:
    """Sentences of both readings looked up, then the rules taken out one after the other."""
    p = license_scan.LicenseScan()
    known = license_scan.known_sentences(p)
    table = "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in known.items()) + "}"
    marked = """regexp_replace(lower(coalesce(text, '')), '([.!?;:][)"'']*)(\\s|$)', '\\1' || chr(1) || '\\2', 'g')"""
    clean = f"list_filter(list_transform(list_transform(@, lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: map_extract_value({table}, s)), lambda x: x IS NOT NULL)"
    lines = clean.replace("@", "regexp_split_to_array(t, '\\n|' || chr(1))")
    wrapped = clean.replace("@", "regexp_split_to_array(t, '\\n\\s*\\n|' || chr(1))")
    ctes = [
        f"d AS (SELECT doc_id, {marked} AS t FROM documents)",
        f"r AS (SELECT doc_id, {lines} AS a, {wrapped} AS b FROM d)",
        "l0 AS (SELECT doc_id, sentences, coalesce(array_to_string(list_transform(sentences, lambda i: '<' || i || '>'), ''), '') AS l, 0::BIGINT AS n, []::VARCHAR[] AS found FROM (SELECT doc_id, CASE WHEN len(b) > len(a) THEN b ELSE a END AS sentences FROM r))",
    ]
    for k, (name, parts) in enumerate(p.rules):
        ids = [i for sentence in parts for i in license_scan.run_of(sentence, p)]
        run = "".join(f"<{i}>" for i in ids)
        ctes.append(f"""l{k + 1} AS (SELECT doc_id, sentences, x AS l, n + c AS n, CASE WHEN c > 0 THEN list_append(found, '{name}') ELSE found END AS found
            FROM (SELECT *, replace(l, '{run}', '|') AS x, (length(l) - length(replace(l, '{run}', '|'))) // {len(run) - 1} AS c FROM l{k}))""")
    return f"""WITH {", ".join(ctes)} SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS licenses, n::BIGINT AS n_matches,
        coalesce(array_to_string(sentences, ','), '') AS sentences FROM l{len(p.rules)}"""


def _repeats(size: int = 400, block: int = 1000) -> str:
    """Windows of every byte counted by digest; runs of covered bytes taken out of the hexadecimal text."""
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc, pos, substr(h, 2 * pos + 1, {2 * (block + size - 1)}) AS h, least({block}, length(h) // 2 - {size - 1} - pos) AS n FROM (SELECT doc, h, unnest(range(0, greatest(length(h) // 2 - {size - 1}, 0), {block})) AS pos FROM d)),
        w AS (SELECT doc, pos + i AS pos, md5_number(substr(h, 2 * i + 1, {2 * size})) AS k FROM (SELECT *, unnest(range(0, n)) AS i FROM b)),
        c AS (SELECT doc, pos FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
        f AS (SELECT doc, pos, coalesce(pos - lag(pos) OVER (PARTITION BY doc ORDER BY pos) > {size}, true) AS fresh FROM c),
        s AS (SELECT doc, run, min(pos) AS first, max(pos) + {size} AS past FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc ORDER BY pos) AS run FROM f) GROUP BY ALL),
        g AS (SELECT doc, list(first ORDER BY first) AS firsts, list(past ORDER BY first) AS pasts FROM s GROUP BY doc)
        SELECT doc_id, length(h)::BIGINT // 2 AS n_bytes, coalesce(list_sum(pasts) - list_sum(firsts), 0)::BIGINT AS n_removed, coalesce(len(firsts), 0)::BIGINT AS n_spans,
            sha256(unhex(CASE WHEN firsts IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(firsts) + 1), lambda i: substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE pasts[i] END) + 1,
            2 * ((CASE WHEN i = len(firsts) THEN length(h) // 2 ELSE firsts[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE pasts[i] END)))), '') END)) AS kept_sha256
        FROM d LEFT JOIN g USING (doc)"""


def _near_classes(size: int = 5, similarity: str = "4 * (p + q - m) <= 5 * m") -> str:
    """Counted shingles joined with shingles, exact weighted Jaccard, then what each text reaches."""
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
        t AS MATERIALIZED (SELECT row_number() OVER () AS id, text, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT text FROM d)),
        s AS (SELECT id, array_to_string(w[i:i + {size - 1}], ' ') AS k, count(*) AS n FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {size - 2}, 2))) AS i FROM t WHERE len(w) > 0) GROUP BY ALL),
        z AS MATERIALIZED (SELECT id, k, n, (sum(n) OVER (PARTITION BY id))::BIGINT AS total FROM s),
        p AS (SELECT x.id AS a, y.id AS b, x.total AS p, y.total AS q, sum(least(x.n, y.n)) AS m FROM z x JOIN z y ON x.k = y.k AND x.id < y.id AND 5 * least(x.total, y.total) >= 4 * greatest(x.total, y.total) GROUP BY ALL),
        e AS MATERIALIZED (SELECT a, b FROM p WHERE {similarity} UNION SELECT b, a FROM p WHERE {similarity}),
        r AS (SELECT id AS a, id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        c AS (SELECT a AS id, min(b) AS class FROM r GROUP BY a), f AS (SELECT doc_id, class FROM d JOIN t USING (text) JOIN c USING (id))
        SELECT doc_id, class_id, class_docs FROM (SELECT doc_id, class FROM documents o JOIN t ON coalesce(o.text, '') = t.text JOIN c USING (id)) JOIN (SELECT class, min(doc_id) AS class_id, count(*) AS class_docs FROM f GROUP BY class) USING (class)"""


def _leaks() -> str:
    """Seeds as the picked words themselves, joined; the best stretch of each diagonal by prefix sums."""
    p = decontaminate.Decontaminate()
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"

    def seeds(source: str) -> str:
        each = []
        for mask in p.masks:
            picked = " || ' ' || ".join(f"w[i + {k + 1}]" for k, m in enumerate(mask) if m == "1")
            each.append(f"SELECT id, i, '{mask} ' || {picked} AS k FROM (SELECT id, w, unnest(range(0, len(w) - {len(mask) - 1})) AS i FROM {source} WHERE len(w) >= {len(mask)})")
        return " UNION ALL ".join(each)

    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {words} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
        b AS MATERIALIZED (SELECT row_number() OVER () AS id, item_id, {words} AS w FROM benchmark),
        h AS MATERIALIZED (SELECT DISTINCT x.id AS doc, y.id AS item, x.i - y.i AS diagonal FROM ({seeds("d")}) x JOIN ({seeds("b")}) y USING (k)),
        u AS (SELECT doc, item, diagonal, doc_id, item_id, d.w AS x, b.w AS y, unnest(range(greatest(0, -diagonal), least(len(b.w), len(d.w) - diagonal))) AS j FROM h JOIN d ON d.id = doc JOIN b ON b.id = item),
        v AS (SELECT doc, item, diagonal, doc_id, item_id, len(y) AS tokens, j, sum(CASE WHEN x[j + diagonal + 1] = y[j + 1] THEN 1 ELSE -1 END) OVER (PARTITION BY doc, item, diagonal ORDER BY j) AS s FROM u),
        g AS (SELECT doc, doc_id, item_id, tokens, s - least(0, coalesce(min(s) OVER (PARTITION BY doc, item, diagonal ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS points FROM v)
        SELECT doc_id, item_id, max(points)::BIGINT AS points, tokens FROM g GROUP BY doc, doc_id, item_id, tokens HAVING max(points) >= least({p.points}, ceil(tokens * {p.share}))"""


ORACLES: dict[str, str] = {
    "op1_near_dedup": _near_classes(),
    "op3_secret_scan": _secrets(),
    "op6_suffix_dedup": _repeats(),
    "op7_decontamination": _leaks(),
    "op10_license_scan": _licenses(),
}
