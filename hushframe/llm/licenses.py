"""Licence scans: lines and paragraphs compared to licence templates by the Dice coefficient over word bigrams, natively.

A text's units are its lines, its paragraphs (parts between blank lines) and its sentences (parts between a full stop, an exclamation or a question
mark and white space), so a notice is found on a line of its own, wrapped over lines, or within a longer paragraph. A unit is normalised to lower-case words of a-z and
0-9; its set has every pair of neighbouring words once. With threshold t, a set of a bigrams can reach a template of b only
if t / (2 - t) <= a / b <= (2 - t) / t, which prunes templates by size before any set is compared.

The same bound gives a gate. A unit that reaches a template has more than t / (2 - t) of its bigrams; so if some words touch at least
the rest of the template's bigrams, one of them stands in the unit. Such words are chosen for each template, rather rare than
common ones, and documents without any of them are not split at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Short public notices and paragraphs of public licence texts.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "all-rights-reserved": ["Copyright. All rights reserved.", "All rights reserved. No part of this work may be reproduced without written permission."],
}
#: What stands between sentences.
SENTENCE = r"[.!?]+[ \t\r\n]+"
#: Words that make poor gates.
COMMON = frozenset("the of and to in is or a for any this that with by on at it as be are was you can may not an if one all from no use do so its work part".split())


def bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    return sorted({f"{a} {b}" for a, b in zip(words[:-1], words[1:], strict=True)})


def gate_words(sets: list[list[str]], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every unit that reaches any of the templates has one."""
    chosen: set[str] = set()
    for grams in sets:
        may_lack = len(grams) - threshold / (2 - threshold) * len(grams)
        touched = {g for g in grams if set(g.split()) & chosen}
        words = {w for g in grams for w in g.split()} - chosen
        while len(touched) <= may_lack:
            w = max(words, key=lambda w: (w not in COMMON and len(w) > 1, sum(w in g.split() for g in set(grams) - touched), len(w), w))
            words.discard(w)
            chosen.add(w)
            touched |= {g for g in grams if w in g.split()}
    return sorted(chosen)


def _words(unit: Column) -> Column:
    return F.filter(F.split(F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+"), lambda w: w != "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: id, n_units (different units that reach a template), licenses (sorted, comma-joined), best_license, best_dice.

    Null and empty texts reach none. A unit counts for its best template; of equal ones, the first licence by name. A line that is a
    paragraph or a sentence too is one unit. Repeated rows and null ids are rows as others; other columns are ignored."""
    known = [(name, bigrams(t)) for name, texts in sorted(templates.items()) for t in texts]
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(len(grams)).alias("b"), F.array(*map(F.lit, grams)).alias("grams")) for name, grams in known])
    text = F.coalesce(F.col(text_col), F.lit(""))
    gate = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").rlike("(?<![a-z0-9])(?:" + "|".join(gate_words([g for _, g in known], threshold)) + ")(?![a-z0-9])")
    units = F.array_union(F.array_union(F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n")), F.split(text, SENTENCE))
    low = threshold / (2 - threshold)

    most = lambda m, d: F.when(m.isNull() | (d["dice"] > m["dice"]) | ((d["dice"] == m["dice"]) & (d["name"] < m["name"])), d).otherwise(m)
    none = F.lit(None).cast("struct<dice:double,name:string>")

    def best(grams: Column) -> Column:
        fits = F.filter(table, lambda t: (F.size(grams) >= low * t["b"]) & (F.size(grams) * low <= t["b"]))
        dice = F.transform(fits, lambda t: F.struct((2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["b"])).alias("dice"), t["name"].alias("name")))
        return F.aggregate(F.filter(dice, lambda d: d["dice"] >= threshold), none, most)

    # each step takes the one before as a lambda's variable, so that none is computed twice
    words = F.transform(units, _words)
    one_less = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    grams = F.transform(words, lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, one_less(w)), F.slice(w, 2, one_less(w)), lambda a, b: F.concat(a, F.lit(" "), b))))
    found = F.when(gate, F.filter(F.transform(F.filter(grams, lambda g: F.size(g) > 0), best), lambda b: b.isNotNull()))
    top = F.aggregate("found", none, most)
    rows = docs.select(F.col(id_col), found.alias("found"))
    return rows.select(
        id_col, F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_units"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda b: b["name"]))), ","), F.lit("")).alias("licenses"),
        F.coalesce(top["name"], F.lit("")).alias("best_license"), F.round(F.coalesce(top["dice"], F.lit(0.0)), 6).alias("best_dice"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({quote(name)}, [{', '.join(map(quote, bigrams(t)))}])" for name, texts in sorted(TEMPLATES.items()) for t in texts)
    return rf"""
WITH t(name, g) AS (VALUES {rows}),
u AS (SELECT doc_id, unnest(list_distinct(list_concat(list_concat(string_split(coalesce(text, ''), chr(10)), regexp_split_to_array(coalesce(text, ''), '\n[ \t\r]*\n')), regexp_split_to_array(coalesce(text, ''), '{SENTENCE}')))) AS unit FROM documents),
w AS (SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM u),
g AS (SELECT doc_id, id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
d AS (SELECT doc_id, id, name, 2.0 * len(list_intersect(g.g, t.g)) / (len(g.g) + len(t.g)) AS dice FROM g JOIN t ON len(g.g) BETWEEN len(t.g) / 2.0 AND len(t.g) * 2.0),
b AS (SELECT doc_id, id, max(CAST(dice AS DOUBLE)) AS dice, arg_min(name, (-dice, name)) AS name FROM d WHERE dice >= {THRESHOLD} GROUP BY doc_id, id),
r AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, arg_min(name, (-dice, name)) AS best, max(dice) AS dice FROM b GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_units, coalesce(names, '') AS licenses, coalesce(best, '') AS best_license, round(coalesce(dice, 0.0), 6) AS best_dice
FROM documents LEFT JOIN r USING (doc_id)
"""


ORACLE_SQL = _sql()
