"""Licence scan: lines and paragraphs compared to licence templates, in Spark expressions only.

A text is cut into units: every line, and every paragraph (between blank lines) of several lines. A unit is
normalised (A-Z lowered, everything but ASCII letters, digits and non-ASCII characters is a space) and becomes the
set of its word bigrams. Its score for a template is the Dice coefficient 2|A & B| / (|A| + |B|) of the two sets.
A score of `threshold` t needs sizes within a factor of (2 - t) / t, so templates outside those bounds are never
compared, and units outside the bounds of all templates are dropped before any comparison.

Nulls, empty texts and units of one word match nothing (score 0, no licence). Ties go to the smaller template name.
Repeated rows are scanned alike. Whole texts are read and nothing is shuffled. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnsift.llm.common import ascii_lower

#: Common licence notices and paragraphs, by SPDX identifier and part.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0 disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the "
    "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
    "implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT notice": "Licensed under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0 full": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 full": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
    "License.",
    "CC-BY-SA-4.0 full": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

_NOT_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    """The bigram set of each template, normalised as units are. The table must be small: it becomes a literal."""
    grams = {}
    for name, text in templates.items():
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in lowered).split()
        grams[name] = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
    return {name: g for name, g in grams.items() if g}


def _bigrams(words: Column) -> Column:
    pairs = F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.array_distinct(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def scan_licenses(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] | None = None,
    threshold: float = 0.8,
) -> DataFrame:
    """`doc_id`, license (best template or null), score (its Dice coefficient, else 0), and all matches.

    matches holds (unit, license, score) for each unit that reaches the threshold with its best template; unit
    counts the lines of the text from 0, then its paragraphs of several lines.
    """
    table = template_bigrams(TEMPLATES if templates is None else templates)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = [len(g) for g in table.values()] or [0]
    known = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams"))
            for name, g in table.items()
        ]
    ) if table else F.expr("cast(array() as array<struct<name:string,n:int,grams:array<string>>>)")
    body = F.coalesce(F.col(text), F.lit(""))
    paragraphs = F.filter(F.split(body, r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    units = F.concat(F.split(body, "\n"), paragraphs)
    words = F.transform(
        units, lambda u: F.filter(F.split(F.regexp_replace(ascii_lower(u), _NOT_WORD, " "), " "), lambda w: w != "")
    )
    numbered = F.transform(words, lambda w, i: F.struct(i.alias("unit"), w.alias("words")))
    fitting = F.filter(numbered, lambda u: F.size(u["words"]) - 1 >= min(sizes) * low)
    sets = F.filter(
        F.transform(fitting, lambda u: F.struct(u["unit"].alias("unit"), _bigrams(u["words"]).alias("grams"))),
        lambda u: F.size(u["grams"]).between(min(sizes) * low, max(sizes) * high),
    )

    def best(unit):
        n = F.size(unit["grams"])
        near = F.filter(known, lambda t: (n >= t["n"] * low) & (n <= t["n"] * high))
        scored = F.transform(
            near,
            lambda t: F.struct(
                (F.size(F.array_intersect(unit["grams"], t["grams"])) * -2.0 / (n + t["n"])).alias("below"),
                t["name"].alias("license"),
            ),
        )
        top = F.array_min(scored)
        return F.struct(unit["unit"].alias("unit"), top["license"].alias("license"), (-top["below"]).alias("score"))

    found = docs.select(
        F.col(doc_id).alias("__doc"),
        F.filter(F.transform(sets, best), lambda m: m["score"] >= threshold).alias("matches"),
    )
    first = F.array_min(F.transform("matches", lambda m: F.struct((-m["score"]).alias("below"), m["license"].alias("name"))))
    return found.select(
        F.col("__doc").alias(doc_id),
        first["name"].alias("license"),
        F.coalesce(-first["below"], F.lit(0.0)).alias("score"),
        "matches",
    )
