"""Licence scans by the Dice coefficient over word bigrams, in DataFrame functions only.

A unit of text (each line, and the whole text where it has several lines) is normalised: A-Z lower-cased, everything
but ASCII letters and digits a blank. Its distinct word bigrams are compared to those of each template:
Dice = 2 * shared / (unit's + template's). A Dice of at least t needs a unit of between t / (2 - t) and
(2 - t) / t times the template's bigrams, so those bounds pick the candidate templates before any
bigrams are compared, and most units have none. Passages that are wrapped over lines or stand inside longer ones are
windows of consecutive words of the whole text, of up to (2 - t) / t times the template's bigrams, from a bigram of the
template to another; of those that overlap the one that shares most is the match, and it is given, with the line that it
starts in, only where no matching unit that it overlaps shares as much. A Dice of at least t needs t / (2 - t) of the
template's bigrams, so only texts that hold as many are searched. The templates are literals of the plan; there is no shuffle.

Defined results: a null or empty text has no units; a unit of one word has no bigrams and no match; of
templates with one coefficient the first by name is the match; repeated lines and rows, and rows without an id, are judged each;
line 0 is the whole text. Other columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.base import let

THRESHOLD = 0.8
#: Licence notices as they are published, by SPDX identifier and kind. Fixed values.
TEMPLATES: dict[str, str] = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT/notice": "Released under the MIT License.",
    "MIT/notice-licensed": "This project is licensed under the terms of the MIT License.",
    "MIT/text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC/text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
        "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause/notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause/notice": "Licensed under the BSD 3-Clause License.",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0/notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0/notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0/notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0/short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain.",
}


def bigrams_of(text: str) -> list[str]:
    """The distinct word bigrams of a template, sorted."""
    words = re.sub(r"[^a-z0-9]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def normal_words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.regexp_replace(lower, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line, license, dice): the best template of every unit that reaches the threshold; line counts from 1, 0 is the whole text."""
    held = {name: b for name, text in sorted((TEMPLATES if templates is None else templates).items()) if (b := bigrams_of(text))}
    text = F.coalesce(F.col(text_col), F.lit(""))
    empty = docs.select(id_col, F.lit(0).cast("int").alias("line"), F.lit("").alias("license"), F.lit(0.0).alias("dice")).where("false")
    if not held:
        return empty
    near = 1e-9  # a size on a bound itself is inside, however the product is rounded
    least = min(len(b) for b in held.values()) * threshold / (2 - threshold) - near
    most = max(len(b) for b in held.values()) * (2 - threshold) / threshold + near
    lines = F.transform(F.split(text, "\n", -1), lambda x, k: F.struct((k + 1).cast("int").alias("line"), x.alias("t")))
    whole = F.array(F.struct(F.lit(0).cast("int").alias("line"), text.alias("t")))
    units = F.when(F.instr(text, F.lit("\n")) > 0, F.concat(lines, whole)).otherwise(lines)
    strings = lambda x: F.array(*[F.lit(g) for g in x])
    grid = F.array(*[F.struct(F.lit(name).alias("name"), strings(b).alias("b"), F.lit(len(b)).alias("n")) for name, b in held.items()])
    known = strings(sorted({g for b in held.values() for g in b}))

    def best(b: Column) -> Column:
        """The best of the templates whose size fits, or null."""
        fitting = F.filter(grid, lambda t: (F.size(b) >= t["n"] * (threshold / (2 - threshold)) - near) & (F.size(b) <= t["n"] * ((2 - threshold) / threshold) + near))
        scored = F.transform(fitting, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(b, t["b"])) / (F.size(b) + t["n"])).alias("dice"), t["name"].alias("license"), F.size(F.array_intersect(b, t["b"])).alias("shared")))
        return let(scored, lambda s: F.get(F.filter(s, lambda x: (x["dice"] >= threshold) & (x["dice"] == F.array_max(F.transform(s, lambda y: y["dice"])))), F.lit(0)))

    def of_bigrams(b: Column) -> Column:
        return F.when(F.size(b).between(F.lit(least), F.lit(most)) & F.arrays_overlap(b, known), best(b))

    def of_words(w: Column) -> Column:
        pairs = F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
        return F.when(F.size(w) - 1 >= F.lit(least), let(F.array_distinct(pairs), of_bigrams))

    def windows(seen: Column, t: Column) -> Column:
        """For each bigram of the template in the text, the best window that starts there and reaches the threshold.

        seen: (bigram, place of the same bigram before it or -1) of every place. From one start on, a bigram is new in the
        window if it was last seen before the start, so sizes and shared bigrams are running counts.
        """
        need, span = F.ceil(t["n"] * (threshold / (2 - threshold)) - near).cast("int"), F.ceil(t["n"] * ((2 - threshold) / threshold)).cast("int")
        begun = F.struct(F.lit(0).alias("size"), F.lit(0).alias("shared"), F.lit(0.0).alias("dice"), F.lit(0).alias("of"), F.lit(-1).alias("to"))

        def step(s: Column, a: Column, x: Column) -> Column:
            new = (x["prev"] < s).cast("int")

            def grown(b: Column) -> Column:
                better = x["hit"] & (b["now"] >= threshold) & (b["now"] > a["dice"])
                return F.struct(b["size"].alias("size"), b["shared"].alias("shared"), F.when(better, b["now"]).otherwise(a["dice"]).alias("dice"), F.when(better, b["shared"]).otherwise(a["of"]).alias("of"), F.when(better, x["at"]).otherwise(a["to"]).alias("to"))

            size, shared = a["size"] + new, a["shared"] + F.when(x["hit"], new).otherwise(0)
            return let(F.struct(size.alias("size"), shared.alias("shared"), (F.lit(2.0) * shared / (size + t["n"])).alias("now")), grown)

        def starting(places: Column, s: Column) -> Column:
            ended = F.aggregate(F.slice(places, s + 1, span), begun, lambda a, x: step(s, a, x))
            return let(ended, lambda x: F.when(x["to"] >= 0, F.struct(x["of"].alias("shared"), x["dice"].alias("dice"), (-s).alias("from"), x["to"].alias("to"), t["name"].alias("license"))))

        def of_places(places: Column) -> Column:
            hits = F.transform(F.filter(places, lambda x: x["hit"]), lambda x: x["at"])
            # A start is tried only where enough of the template's bigrams follow within the span.
            tried = lambda h: F.filter(h, lambda s, k: F.coalesce(F.get(h, k + need - 1) - s < span, F.lit(False)))
            return F.filter(F.transform(let(hits, tried), lambda s: starting(places, s)), lambda x: x.isNotNull())

        return let(F.transform(seen, lambda x, i: F.struct(i.alias("at"), x["prev"].alias("prev"), F.array_contains(t["b"], x["g"]).alias("hit"))), of_places)

    def passages(seen: Column, fitting: Column) -> Column:
        found = F.sort_array(F.flatten(F.transform(fitting, lambda t: windows(seen, t))), asc=False)
        none = F.slice(found, 1, 0)
        apart = lambda kept, x: ~F.exists(kept, lambda y: (-y["from"] <= x["to"] + 1) & (-x["from"] <= y["to"] + 1))
        return let(found, lambda f: F.aggregate(f, none, lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept)))

    def placed(units_made: Column, lines_of: Column, made: Column) -> Column:
        """Passages with their lines, without those that a matching unit covers as well; lines_of has every word's line."""
        at = lambda i: F.get(lines_of, i)
        over = lambda x, u: (u["line"] == 0) | ((at(-x["from"]) <= u["line"]) & (at(x["to"] + 1) >= u["line"]))
        new = F.filter(made, lambda x: ~F.exists(units_made, lambda u: (u["m"]["shared"] >= x["shared"]) & over(x, u)))
        return F.concat(units_made, F.transform(new, lambda x: F.struct(at(-x["from"]).alias("line"), F.struct(x["dice"].alias("dice"), x["license"].alias("license"), x["shared"].alias("shared")).alias("m"))))

    def last_seen(pairs: Column) -> Column:
        """(bigram, place of the same one before it or -1) in order of place, by sorting twice."""
        near = F.sort_array(F.transform(pairs, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        prev = lambda n: F.transform(n, lambda x, k: F.struct(x["i"].alias("i"), x["g"].alias("g"), F.when((k > 0) & (F.get(n, k - 1)["g"] == x["g"]), F.get(n, k - 1)["i"]).otherwise(F.lit(-1)).alias("prev")))
        return F.transform(F.sort_array(let(near, prev)), lambda x: F.struct(x["g"].alias("g"), x["prev"].alias("prev")))

    def with_passages(units_made: Column) -> Column:
        lines_of = F.flatten(F.transform(F.split(text, "\n", -1), lambda x, k: F.array_repeat((k + 1).cast("int"), F.size(normal_words(x)))))

        def of_pairs(pairs: Column) -> Column:
            held_here = F.array_intersect(pairs, known)
            fitting = let(held_here, lambda h: F.filter(grid, lambda t: (F.size(h) >= t["n"] * (threshold / (2 - threshold)) - near) & (F.size(F.array_intersect(h, t["b"])) >= t["n"] * (threshold / (2 - threshold)) - near)))
            return let(fitting, lambda f: F.when(F.size(f) > 0, let(lines_of, lambda w: let(last_seen(pairs), lambda seen: placed(units_made, w, passages(seen, f))))).otherwise(units_made))

        return let(normal_words(text), lambda w: F.when(F.size(w) - 1 >= F.lit(least), let(F.transform(F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))), of_pairs)).otherwise(units_made))

    # Each step's value is bound once by `let`; an explode keeps the optimizer from writing it into filters again.
    matches = F.filter(F.transform(units, lambda u: F.struct(u["line"].alias("line"), let(normal_words(u["t"]), of_words).alias("m"))), lambda r: r["m"].isNotNull())
    return docs.select(F.col(id_col), F.explode(let(matches, with_passages)).alias("r")).select(id_col, F.col("r.line").alias("line"), F.col("r.m.license").alias("license"), F.col("r.m.dice").alias("dice"))


def oracle(threshold: float = THRESHOLD) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in TEMPLATES.items())
    words = "list_filter(string_split(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
WITH t(name, t) AS (VALUES {rows}),
tw AS (SELECT name, {words.format("t")} AS w FROM t),
tb AS (SELECT DISTINCT name, w[i] || ' ' || w[i + 1] AS g FROM (SELECT name, w, unnest(range(1, len(w))) AS i FROM tw)),
tn AS (SELECT name, count(*) AS n FROM tb GROUP BY name),
l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
      UNION ALL SELECT doc_id, 0, text FROM documents WHERE contains(text, chr(10))),
lw AS (SELECT doc_id, line, {words.format("t")} AS w FROM l),
lb AS (SELECT DISTINCT doc_id, line, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, line, w, unnest(range(1, len(w))) AS i FROM lw)),
ln AS (SELECT doc_id, line, count(*) AS n FROM lb GROUP BY ALL),
s AS (SELECT doc_id, line, name, count(*) AS shared FROM lb JOIN tb USING (g) GROUP BY ALL),
d AS (SELECT s.doc_id, s.line, name, 2.0::DOUBLE * shared / (ln.n + tn.n) AS dice FROM s JOIN ln ON s.doc_id = ln.doc_id AND s.line = ln.line JOIN tn USING (name)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, name) AS k FROM d WHERE dice >= {threshold})
SELECT doc_id, line::INTEGER AS line, name AS license, dice FROM r WHERE k = 1
"""
