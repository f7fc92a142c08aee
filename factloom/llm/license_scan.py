"""License scans: known sentences to identifiers, identifier sequences to ordered rules.

A text is split into sentences twice: at line ends and sentence ends, and with
single line ends taken as spaces (wrapped headers).  Each sentence is
normalised (lower case, runs of other characters than ASCII letters and digits
to one space) and looked up among the known sentences.  Both readings are
merged in the order of the text: a wrapped sentence replaces those of its lines
that say less of it.  The identifiers, in
the order of the text, are then read against the rules in their order: a rule
is a run of identifiers, its matches are counted and taken out, and later,
shorter rules see what is left.

Texts that hold none of the known sentences' longest words cannot hold a
sentence and are not split.

Everything is an expression over one row: no shuffle, no Python worker.

Defined cases: a null text is empty and has no license; equal rows give a row
each; null ids stay null; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import text_or_empty

#: The sentences of public license notices.
SENTENCES: dict[str, str] = {
    "apache_named": "Licensed under the Apache License, Version 2.0.",
    "apache_you_may": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache_copy": "You may obtain a copy of the License at",
    "apache_url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache_copy_url": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache_as_is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache_see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit_named": "Released under the MIT License.",
    "mit_licensed": "Licensed under the MIT License.",
    "mit_granted": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl3_named": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_details": "See the GNU General Public License for more details.",
    "ccbync4_named": "Licensed under CC BY-NC 4.0.",
    "ccby4_named": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd_redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "agpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl_free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl_named": "Licensed under the Mozilla Public License 2.0.",
    "isc_granted": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc_named": "Released under the ISC License.",
    "unlicense_free": "This is free and unencumbered software released into the public domain.",
    "cc0_named": "This work is dedicated to the public domain under CC0 1.0.",
    "cc0_waived": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ccbysa4_named": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbysa4_short": "Licensed under CC BY-SA 4.0.",
    "ccby4_short": "Licensed under CC BY 4.0.",
    "bsd3_named": "Licensed under the BSD 3-Clause License.",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}

#: License and the sentences that say so, in this order; earlier rules first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache_you_may", "apache_copy", "apache_url", "apache_as_is", "apache_see")),
    ("Apache-2.0", ("apache_you_may", "apache_copy_url", "apache_as_is", "apache_see")),
    ("MIT", ("mit_granted", "mit_notice")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope", "gpl_details")),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache_you_may",)),
    ("Apache-2.0", ("apache_named",)),
    ("MIT", ("mit_granted",)),
    ("MIT", ("mit_named",)),
    ("MIT", ("mit_licensed",)),
    ("GPL-3.0-or-later", ("gpl_free",)),
    ("GPL-3.0-only", ("gpl3_named",)),
    ("CC-BY-NC-4.0", ("ccbync4_named",)),
    ("CC-BY-4.0", ("ccby4_named",)),
    ("CC-BY-4.0", ("ccby4_short",)),
    ("CC-BY-SA-4.0", ("ccbysa4_named",)),
    ("CC-BY-SA-4.0", ("ccbysa4_short",)),
    ("CC0-1.0", ("cc0_named",)),
    ("CC0-1.0", ("cc0_waived",)),
    ("AGPL-3.0-or-later", ("agpl_free",)),
    ("LGPL-2.1-or-later", ("lgpl_free",)),
    ("MPL-2.0", ("mpl_copy",)),
    ("MPL-2.0", ("mpl_named",)),
    ("ISC", ("isc_granted",)),
    ("ISC", ("isc_named",)),
    ("Unlicense", ("unlicense_free",)),
    ("BSD-3-Clause", ("bsd3_named",)),
)

WRAPPED = r"\n\s*\n|[.!?;:][)\"']*(?=\s|$)"


@dataclass(frozen=True)
class LicenseScan:
    sentences: tuple[tuple[str, str], ...] = tuple(SENTENCES.items())
    rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES


def normalised(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def known_sentences(p: LicenseScan) -> dict[str, str]:
    """Normalised sentence to identifier. A sentence that splits is known by its parts, joined: the last part names it."""
    out: dict[str, str] = {}
    for name, text in p.sentences:
        parts = [normalised(x) for x in re.split(WRAPPED, text)]
        parts = [x for x in parts if x]
        for k, x in enumerate(parts):
            out.setdefault(x, name if k == len(parts) - 1 else f"{name}.{k}")
    return out


def run_of(sentence: str, p: LicenseScan) -> list[str]:
    """The identifiers that a known sentence gives, in order; sentences may share parts."""
    known = known_sentences(p)
    return [known[x] for part in re.split(WRAPPED, dict(p.sentences)[sentence]) if (x := normalised(part))]


def anchors(known: dict[str, str]) -> list[str]:
    """Words of which any known sentence holds one: each one's longest."""
    return sorted({max(s.split(), key=lambda w: (len(w), w)) for s in known})


def identifiers(text: Column, known: dict[str, str]) -> Column:
    """The identifiers of the known sentences of a text, in its order, by lines and wrapped.

    Every line is a part of one wrapped sentence, so that sentence by sentence
    the readings are merged.  Where its lines together say all of a known
    wrapped sentence, the reading that finds more in the whole text names it.
    """
    clean = lambda s: F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " "))
    is_known = lambda s: s.isin(*known)
    both = F.transform(F.split(F.lower(text), WRAPPED, -1), lambda s: F.struct(F.filter(F.array(clean(s)), is_known).alias("wrapped"), F.filter(F.transform(F.split(s, r"\n", -1), clean), is_known).alias("lines")))
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))

    def merged(all_: Column) -> Column:
        wrapped_more = F.size(F.flatten(F.transform(all_, lambda s: s["wrapped"]))) > F.size(F.flatten(F.transform(all_, lambda s: s["lines"])))
        use_lines = lambda s: (F.size(s["wrapped"]) == 0) | (~wrapped_more & (F.array_join(s["lines"], " ") == F.get(s["wrapped"], F.lit(0))))
        return F.flatten(F.transform(all_, lambda s: F.when(use_lines(s), s["lines"]).otherwise(s["wrapped"])))

    # the sentences found are bound to a variable, so that the text is split once
    found = F.flatten(F.transform(F.array(F.filter(both, lambda s: (F.size(s["wrapped"]) > 0) | (F.size(s["lines"]) > 0))), merged))
    return F.transform(found, lambda s: F.element_at(table, s))


def matches(ids: Column, p: LicenseScan) -> Column:
    """array<struct<license, n>> of the rules that the identifier sequence fulfils."""
    rules = F.array(*(F.struct(F.lit(license_).alias("license"), F.lit("".join(f"<{i}>" for name in names for i in run_of(name, p))).alias("run")) for license_, names in p.rules))
    line = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    none = F.array().cast("array<struct<license:string,n:bigint>>")

    def step(acc: Column, r: Column) -> Column:
        left = F.replace(acc["left"], r["run"], F.lit("|"))
        n = ((F.length(acc["left"]) - F.length(left)) / (F.length(r["run"]) - 1)).cast("long")
        return F.struct(left.alias("left"), F.when(n > 0, F.concat(acc["found"], F.array(F.struct(r["license"].alias("license"), n.alias("n"))))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(rules, F.struct(line.alias("left"), none.alias("found")), step, lambda acc: acc["found"])


def scan(docs: DataFrame, params: LicenseScan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentences (identifiers in order), matches (license and count) for every row.

    ``sentences`` are those found by lines and in wrapped text, merged; the
    matches are of all of them.
    """
    p = params or LicenseScan()
    known = known_sentences(p)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    low = F.lower("text")
    some = F.lit(False)
    for word in anchors(known):
        some = some | F.contains(low, F.lit(word))
    none = F.array().cast("array<string>")
    best = src.select("doc_id", F.when(some, identifiers(F.col("text"), known)).otherwise(none).alias("sentences"))
    return best.select("doc_id", "sentences", F.when(F.size("sentences") > 0, matches(F.col("sentences"), p)).otherwise(F.array().cast("array<struct<license:string,n:bigint>>")).alias("matches"))
