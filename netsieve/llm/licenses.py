"""Op 7: license scans by Dice coefficient over word bigrams.

Only column expressions, one row at a time, no shuffle. Units of a text (its
lines, its paragraphs and the whole) are normalised and compared with the templates by
their sets of word bigrams. Two exact bounds prune: a unit of n bigrams reaches
Dice t with a template of m only if t / (2 - t) <= n / m <= (2 - t) / t; and the shared
bigrams must number t * m / (2 - t) at least, so a unit without any word of a set that
touches enough of the template's bigrams can't match.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

DICE = 0.8

#: Public licence notices.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MIT-statement": "Released under the MIT License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
}


def normal_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text: str) -> list[str]:
    words = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def key_words(shelf: list[list[str]], dice: float, shortest: int = 6) -> list[str]:
    """Few words such that every text that reaches ``dice`` with a template holds one of them as a substring.

    For each template words are taken, most bigrams first, until fewer bigrams hold
    none of them than a match must share. Short (frequent) words come last.
    """
    chosen: list[str] = []
    for grams in sorted(shelf, key=len):
        need = dice * len(grams) / (2 - dice)
        left = [g for g in grams if not any(w in part for w in chosen for part in g.split())]
        words = sorted({w for g in grams for w in g.split()})
        while len(left) >= need:
            touch = {w: sum(any(w in part for part in g.split()) for g in left) for w in words}
            word = max(words, key=lambda w: (touch[w] > 0 and len(w) >= shortest, touch[w], w))
            chosen.append(word)
            left = [g for g in left if not any(word in part for part in g.split())]
    return [w for w in chosen if not any(o != w and o in w for o in chosen)]


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda variable is not inlined like a plain expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _unit_grams(unit: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " ")), " ")
    return _with(words, lambda w: F.when(F.size(w) > 1, F.array_distinct(F.zip_with(
        F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.concat_ws(" ", x, y))))
        .otherwise(F.array().cast("array<string>")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
         dice: float = DICE) -> DataFrame:
    """One row per input row: id, license (best template or null), dice (null without one), n_units (units that match).

    Ties go to the template named first. Null and empty texts match nothing; a
    null id stays null; repeated rows repeat; extra columns are not read; an empty
    table gives no rows. Texts are taken whole.
    """
    templates = templates or TEMPLATES
    grams = {name: bigrams(text) for name, text in templates.items()}
    if any(not g for g in grams.values()):
        raise ValueError("a template needs two words")
    words = key_words(list(grams.values()), dice)

    def hinted(t: Column) -> Column:
        low = F.lower(t)
        return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])

    shelf = F.array(*[F.struct(F.lit(-k).alias("order"), F.lit(len(g)).alias("m"),
                               F.lit(math.floor(dice / (2 - dice) * len(g))).alias("least"),
                               F.lit(math.ceil((2 - dice) / dice * len(g))).alias("most"),
                               F.array(*map(F.lit, g)).alias("grams")) for k, g in enumerate(grams.values())])
    names = F.array(*[F.lit(n) for n in grams])

    def dices(got: Column) -> Column:
        near = F.filter(shelf, lambda t: (F.size(got) >= t["least"]) & (F.size(got) <= t["most"]))
        return F.array_max(F.transform(near, lambda t: F.struct(
            (2.0 * F.size(F.array_intersect(got, t["grams"])) / (F.size(got) + t["m"])).alias("dice"), t["order"].alias("order"))))

    def best(unit: Column) -> Column:
        return _with(_unit_grams(unit), dices)

    text = F.col(text_col).cast("string")
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t]*\n"), F.array(text)))
    found = F.filter(F.transform(F.filter(units, hinted), best), lambda b: b["dice"] >= dice)
    rows = docs.select(F.col(id_col).alias(id_col), F.when(hinted(text), found).alias("_found"))
    rows = rows.select(id_col, F.array_max("_found").alias("_best"), F.size("_found").alias("_n"))
    return rows.select(id_col, F.when(F.col("_best").isNotNull(), F.element_at(names, 1 - F.col("_best.order"))).alias("license"),
                       F.col("_best.dice").alias("dice"), F.greatest(F.col("_n"), F.lit(0)).cast("long").alias("n_units"))
