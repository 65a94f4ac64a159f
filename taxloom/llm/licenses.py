"""Licence scans: units of a text against licence templates by Dice over word bigrams.

A unit is a line, a paragraph (lines between blank ones) or the whole text, a
template a notice or the whole text of a public licence. Text is normalised
to lower-case words; a unit's set of word bigrams is compared with those of the
templates whose size lets the threshold be reached. Texts that hold none of the
templates' anchor words cannot match and skip all of that: a unit at the
threshold shares at least t / (2 - t) of a template's bigrams, so it holds one
of any larger part of them. Everything is DataFrame expressions.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import cache
from importlib.resources import files
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Letters from which a word is taken for rarer than others.
RARE = 6

#: The wording of public licence notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL-3.0-only": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
    ],
    "GPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0-or-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0-or-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Proprietary": ["All rights reserved."],
}
#: Words that occur in any English text: no anchors if that can be helped.
_COMMON = set("0 1 2 3 4 a all an and any are as at be by can conditions copies copy deal do either file following for free from has holder if in into is it its law may modify name names nor not of on one or other permitted person possible promote purpose released required rights source terms that the there this to under use used version was were with without work writing you your".split())


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of the normalised text, in order."""
    w = re.sub("[^a-z0-9]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


@cache
def full_texts() -> dict[str, list[str]]:
    """The whole texts of public licences, by SPDX identifier, from the package's files."""
    folder = files("taxloom.llm").joinpath("licences")
    return {f.name.removesuffix(".txt"): [f.read_text()] for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def default() -> dict[str, list[str]]:
    """Notices first, then whole texts."""
    names = dict.fromkeys([*TEMPLATES, *full_texts()])
    return {n: [*TEMPLATES.get(n, []), *full_texts().get(n, [])] for n in names}


def templates(spec: dict[str, list[str]]) -> list[tuple[int, str, list[str]]]:
    return [(k, name, bigrams(text)) for k, (name, text) in enumerate((n, t) for n, ts in spec.items() for t in ts)]


def anchors(bases: list[list[str]], threshold: float) -> list[str]:
    """Words of which every unit that matches holds at least one.

    A matching unit lacks so few of a template's bigrams that it holds one of
    any larger part of them: words are chosen until they cover such a part,
    those that are chosen already first, then those in most bigrams, and words
    of any English text last.
    """
    out: set[str] = set()
    for b in bases:
        least = ceil(threshold / (2 - threshold) * len(b) - 1e-9)
        bare, need = {p for p in b if not out & set(p.split())}, len(b) - least + 1
        while len(b) - len(bare) < need:
            counts = Counter(w for p in bare for w in set(p.split()))
            word = min(counts, key=lambda w: (w in _COMMON, len(w) < RARE, -counts[w], -len(w), w))
            out.add(word)
            bare = {p for p in bare if word not in p.split()}
    return sorted(out)


def pattern_of(words: list[str]) -> str:
    """A regular expression for any of the words that shares their beginnings, so that a place is tried once for each letter."""
    if not words:
        return ""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [h + pattern_of(rest) for h, rest in sorted(heads.items())]
    inner = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    if not parts:
        return ""
    return f"(?:{inner})?" if "" in words else inner


def _normal(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(lower, "[^a-z0-9\n]+", " ")


def scan(docs: DataFrame, *, spec: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, license, score and n_matches, a row for each row of docs.

    Of the templates that some unit matches at the threshold, license names the
    one with most bigrams in common (on a tie the higher score, then the first
    listed), score is its Dice coefficient, and n_matches the number of units at
    the threshold; without any, license and score are null. Null and empty
    texts match nothing. Repeated rows and null ids stay rows of their own.
    """
    known = templates(spec or default())
    # One constant of JSON: thousands of bigrams would make a slow plan as literals of their own.
    table = F.from_json(F.lit(json.dumps([{"k": k, "b": b} for k, _, b in known])), "array<struct<k:int,b:array<string>>>")
    names = F.array(*[F.lit(n) for _, n, _ in known])
    sizes = [len(b) for _, _, b in known]
    ratio = threshold / (2 - threshold)
    own = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    pattern = r"(?i)(?<![a-z0-9])" + pattern_of(anchors([b for _, _, b in known], threshold)) + "(?![a-z0-9])"
    maybe = own.select("id", F.when(F.col("text").rlike(pattern), _normal(F.col("text"))).alias("text"))
    lines = F.split("text", "\n")
    paragraphs = F.transform(F.filter(F.split("text", "\n *\n"), lambda p: p.contains("\n")), lambda p: F.translate(p, "\n", " "))
    whole = F.when(F.col("text").contains("\n"), F.array(F.translate("text", "\n", " "))).otherwise(F.expr("cast(array() as array<string>)"))
    units = maybe.select("id", F.when(F.col("text").isNotNull(), F.concat(lines, paragraphs, whole)).alias("units"))
    pairs = lambda u: F.filter(F.split(u, " +"), lambda w: w != "")
    words = units.select("id", F.transform("units", pairs).alias("units"))
    words = words.select("id", F.filter("units", lambda w: F.size(w) >= 2).alias("units"))

    def set_of(w: Column) -> Column:
        return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))

    sets = words.select("id", F.transform("units", set_of).alias("units"))
    sets = sets.select("id", F.filter("units", lambda b: F.size(b).between(ceil(ratio * min(sizes) - 1e-9), int(max(sizes) / ratio + 1e-9))).alias("units"))

    def best(b: Column) -> Column:
        near = F.filter(table, lambda t: (F.size(t["b"]) >= ratio * F.size(b) - 1e-9) & (F.size(b) >= ratio * F.size(t["b"]) - 1e-9))
        both = F.transform(near, lambda t: F.struct(F.size(F.array_intersect(b, t["b"])).alias("common"), (F.size(b) + F.size(t["b"])).alias("sizes"), (-t["k"]).alias("k")))
        dice = lambda m: F.struct(m["common"].alias("common"), (2.0 * m["common"] / m["sizes"]).alias("score"), m["k"].alias("k"))
        return F.array_max(F.filter(F.transform(both, dice), lambda m: m["score"] >= threshold))

    met = sets.select("id", F.filter(F.transform("units", best), lambda m: m.isNotNull()).alias("met"))
    top = met.select("id", F.array_max("met").alias("top"), F.coalesce(F.size("met"), F.lit(0)).alias("n"))
    return top.select(F.col("id").alias(id_col), F.when(F.col("top").isNotNull(), F.element_at(names, 1 - F.col("top.k"))).alias("license"), F.col("top.score").alias("score"), F.greatest("n", F.lit(0)).cast("long").alias("n_matches"))
