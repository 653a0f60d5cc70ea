"""Operator 7: licence scan by the Dice coefficient over word bigrams, in DataFrame functions only.

The lines, the runs of one to four paragraphs and the whole of a text are its segments. A segment is normalised to lower-case
words ``[a-z0-9]+`` and compared, as the set of its word bigrams A, to each licence template B by
2 |A n B| / (|A| + |B|). A coefficient of t or more needs t / (2 - t) <= |A| / |B| <= (2 - t) / t, which
prunes the templates by size before any bigrams are compared. It needs, too, more than
t / (2 - t) of the template's bigrams, so a few words that together touch the rest of them must be in
the text; documents without any such word are not split up at all. Both bounds are exact. All of it
is one projection: no shuffle, no row is touched twice.

Defined results: null and empty texts have no segments and no licences; a segment of fewer than two
words has no bigrams and matches nothing; templates that tie are all reported; a null doc_id is kept;
repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
#: Paragraphs of the longest of the templates, in their usual layout.
MOST_PARAGRAPHS = 4
#: Public licence texts and the notices by which works refer to them.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
        more details.""",
    "agpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General
        Public License for more details.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
        OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "lgpl-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
        later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License
        for more details.""",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "mit-notice": "Released under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
}


def bigrams_of(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(size: int, least: float) -> tuple[int, int]:
    """Least and greatest number of bigrams a segment can have and reach ``least``."""
    return int(-(-size * least // (2 - least))), int(size * (2 - least) / least)


def needed_words(templates: dict[str, list[str]], least: float) -> list[str]:
    """Words of which any segment like some template has one.

    A segment like a template lacks at most (1 - t / (2 - t)) of its bigrams; words that together
    are in more bigrams than that can't all be missing. Long words are taken first.
    """
    chosen: list[str] = []
    for bigrams in templates.values():
        lacking = len(bigrams) - size_bounds(len(bigrams), least)[0]
        left = [set(b.split()) for b in bigrams if not set(b.split()) & set(chosen)]
        while len(bigrams) - len(left) <= lacking:
            counts = Counter(w for pair in left for w in pair if len(w) > 4) or Counter(w for pair in left for w in pair)
            word = max(counts, key=lambda w: (counts[w] * len(w), w))
            chosen.append(word)
            left = [pair for pair in left if word not in pair]
    return sorted(chosen)


def segment_matches(text: Column, templates: dict[str, list[str]], least: float) -> Column:
    """array<struct<licence, dice, segment>> of the segments of a text."""
    low = F.lower(text)
    seen = F.lit(False)
    for word in needed_words(templates, least):
        seen = seen | F.contains(low, F.lit(word))
    paragraphs = F.split(low, "\n[ \t\r]*\n")

    def runs(all_: Column) -> Column:
        # Each length is the one before with one paragraph more: a walk for each length, none for each paragraph.
        longer, several = all_, [all_]
        for k in range(2, MOST_PARAGRAPHS + 1):
            longer = F.zip_with(longer, F.slice(all_, k, F.size(all_)), lambda run, more: F.concat(run, F.lit("\n"), more))
            several.append(longer)
        return F.concat(*several)

    def needed(segment: Column) -> Column:
        return F.coalesce(segment.rlike("|".join(needed_words(templates, least))), F.lit(False))

    parts = F.array_distinct(F.filter(F.concat(F.split(low, "\n"), F.get(F.transform(F.array(paragraphs), runs), F.lit(0)), F.array(low)), needed))
    nothing = F.array().cast("array<struct<licence: string, dice: double, segment: string>>")

    def words(segment: Column) -> Column:
        return F.filter(F.split(segment, "[^a-z0-9]+"), lambda w: w != "")

    def with_bigrams(segment: Column) -> Column:
        w = words(segment)
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.struct(segment.alias("segment"), F.array_distinct(pairs).alias("bigrams"))

    def compared(s: Column) -> Column:
        found = []
        for name, bigrams in templates.items():
            low_, high = size_bounds(len(bigrams), least)
            n = F.size(s["bigrams"])
            shared = F.size(F.array_intersect(s["bigrams"], F.array(*map(F.lit, bigrams))))
            dice = F.when(n.between(low_, high), 2.0 * shared / (n + len(bigrams)))
            found.append(F.struct(F.lit(name).alias("licence"), dice.alias("dice"), s["segment"].alias("segment")))
        return F.filter(F.array(*found), lambda f: f["dice"] >= least)

    matches = F.flatten(F.transform(F.transform(parts, with_bigrams), compared))
    return F.when(text.isNotNull() & seen, matches).otherwise(nothing)


def scan_licences(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """``keep`` and matches: licence, dice and the (lower-cased) segment of each segment like a template."""
    sets = {name: bigrams_of(text) for name, text in (templates or TEMPLATES).items()}
    sets = {name: b for name, b in sets.items() if b}
    return docs.select(*keep, segment_matches(F.col("text"), sets, least).alias("matches"))


def oracle(least: float = LEAST) -> str:
    """The query's rows in DuckDB's SQL, every segment against every template."""
    rows = ", ".join(f"('{name}', [{', '.join(repr(b) for b in bigrams_of(text))}])" for name, text in sorted(TEMPLATES.items()))
    runs = ", ".join(f"list_transform(range(1, greatest(len(p) - {k - 1}, 1) + 1), lambda i: array_to_string(p[i:i + {k - 1}], chr(10)))" for k in range(1, MOST_PARAGRAPHS + 1))
    return f"""
    WITH template(licence, b) AS (VALUES {rows}),
    part AS (
        SELECT DISTINCT rid, segment FROM (
            SELECT rid, unnest(list_concat(string_split(low, chr(10)), {runs}, [low])) AS segment
            FROM (SELECT rid, low, regexp_split_to_array(low, '\\n[ \\t\\r]*\\n') AS p FROM (SELECT row_number() OVER () AS rid, lower(text) AS low FROM documents) WHERE low IS NOT NULL))),
    word AS (SELECT rid, segment, list_filter(regexp_split_to_array(segment, '[^a-z0-9]+'), lambda w: w <> '') AS w FROM part),
    gram AS (SELECT rid, segment, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM word WHERE len(w) > 1),
    hit AS (
        SELECT rid, licence, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM gram, template
        WHERE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) >= {least}),
    best AS (SELECT rid, count(*) AS n_matches, max(dice) AS dice, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM hit GROUP BY rid)
    SELECT d.doc_id, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, round(coalesce(dice, 0), 6) AS best_dice, coalesce(licences, '') AS licences
    FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) d LEFT JOIN best USING (rid)"""
