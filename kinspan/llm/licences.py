"""Licence scan: Dice coefficient of word bigrams between stretches of text and licence templates.

Only DataFrame functions are used.  Texts are normalised to lower-case words, so that wrapped lines, case and
punctuation do not matter.  For ``2x / (m + n)`` to reach ``least``, a stretch must share a least number of
a template's n bigrams; so it shares one of any larger rest of them, and of these the rarest are taken as
the template's anchors.  Only texts with an anchor are looked at, only for its templates, and only
where enough shared bigrams lie within the size bound: of more than ``n (2 - least) / least`` bigrams, even one that holds
the whole template falls short of ``least``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices of public licences, and the operative texts of the shorter ones.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with"
        " the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by"
        " applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language"
        " governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later"
        " version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more"
        " details. You should have received a copy of the GNU General Public License along with this program. If not, see"
        " https://www.gnu.org/licenses/."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the"
        " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
        " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice"
        " and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS"
        " PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF"
        " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT"
        " HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
        " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED"
        " \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF"
        " MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR"
        " CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF"
        " CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS"
        " SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of"
        " conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,"
        " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
        " distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED"
        " WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR"
        " PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,"
        " INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS"
        " OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
        " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF"
        " THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable"
        " for any damages arising from the use of this software. Permission is granted to anyone to use this software for any"
        " purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following"
        " restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original"
        " software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated"
        " but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being"
        " the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,"
        " compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,"
        " commercial or non-commercial, and by any means."
    ),
}


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    flat = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bigrams_of(text: Column) -> Column:
    """Hashes of the pairs of neighbouring words, in order; the place of a pair is that of its first word."""

    def pairs(w: Column) -> Column:
        n = F.size(w)
        hashed = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(w[i], w[i + 1]))
        return F.when(n >= 2, hashed).otherwise(F.array().cast("array<bigint>"))

    return F.coalesce(let(words_of(text), pairs), F.array().cast("array<bigint>"))


def earlier(grams: Column) -> Column:
    """For each place of an array the place before it that has the same value, or -1."""
    ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def back(s: Column) -> Column:
        same = lambda x, k: (k > 0) & (F.get(s, k - 1)["g"] == x["g"])
        pairs = F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), F.when(same(x, k), F.get(s, k - 1)["i"]).otherwise(-1).alias("before")))
        return F.transform(F.array_sort(pairs), lambda x: x["before"])

    return let(ordered, back)


def anchored(templates: list[tuple[str, list[int]]], least: float) -> list[tuple[str, list[int], int, int, list[int]]]:
    """Of each template with its bigrams: the distinct ones, how many bigrams a stretch may have, how many of the distinct ones
    must be shared, and its anchors: one more than may be missing, those in the fewest templates first."""
    seen: dict[int, int] = {}
    for _, grams in templates:
        for g in set(grams):
            seen[g] = seen.get(g, 0) + 1
    out = []
    for name, grams in templates:
        own = list(dict.fromkeys(grams))
        need = max(1, math.ceil(len(own) * least / (2 - least) - 1e-9))
        rare = sorted(own, key=lambda g: (seen[g], g))[: len(own) - need + 1]
        if own:
            out.append((name, own, math.floor(len(grams) * (2 - least) / least + 1e-9), need, rare))
    return out


def scan_licences(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.8,
) -> DataFrame:
    """``id, licence, first_word, n_words, dice``: of each text and template the best stretch of ``least`` or more.

    A stretch begins and ends at bigrams of the template and has at most ``(2 - least) / least`` times as many bigrams as that; of
    equally good ones the first counts, and of those that begin together the shortest.  A text can match several templates, as where one contains
    another, and has a row for each.  Templates are a parameter of bounded size and sent to all executors; their
    bigrams are made by the same expression as those of texts.  Null, empty and one-word texts
    have no bigrams and no rows; rows with equal ids give rows each; further columns are left out; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    given = spark.createDataFrame(list((TEMPLATES if templates is None else templates).items()), "licence string, body string")
    known = anchored([(r[0], r[1]) for r in given.select("licence", bigrams_of(F.col("body"))).collect()], least)
    schema = "licence string, own array<bigint>, bound int, need int, anchors array<bigint>"
    table = spark.createDataFrame(known, schema)
    anchors_of = sorted({g for *_, anchors in known for g in anchors})
    any_anchor = (lambda g: g.isin(anchors_of)) if anchors_of else (lambda g: F.lit(False))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), bigrams_of(F.col(text_col)).alias("grams"))
    rows = rows.withColumn("hits", F.array_distinct(F.filter("grams", any_anchor))).where(F.size("hits") > 0)
    rows = rows.withColumn("earlier", earlier(F.col("grams")))
    # the templates of the anchors: a text is repeated once for each of them, and joined with those by name
    has = lambda anchors: F.arrays_overlap("hits", F.array(*map(F.lit, anchors)))
    several = F.array(*(F.when(has(anchors), F.lit(name)) for name, *_, anchors in known), F.lit(None).cast("string"))
    pairs = rows.select(id_col, "grams", "earlier", F.explode(F.filter(several, lambda x: x.isNotNull())).alias("licence")).join(F.broadcast(table.drop("anchors")), "licence")
    # values that are used at every step are bound to names, so that they are computed once a text and template:
    # ``at``, the places of shared bigrams, and ``f``, those from which on enough of them lie within the bound; distinct bigrams
    # from ``f`` on are those without an earlier one from ``f`` on, and are counted along the stretch
    best = """
        transform(array(transform(grams, g -> array_contains(own, g))), shared ->
        transform(array(filter(sequence(0, size(grams) - 1), i -> shared[i])), at ->
        array_max(transform(
            IF(size(at) < need, array(), filter(sequence(0, size(at) - need), k -> at[k + need - 1] - at[k] < bound)),
            k -> transform(array(at[k]), f -> aggregate(
                sequence(f, least(f + bound, size(grams)) - 1),
                named_struct('all', 0, 'both', 0, 'dice', 0D, 'last', f),
                (s, p) -> transform(
                    array(named_struct('all', s.all + IF(earlier[p] < f, 1, 0), 'both', s.both + IF(earlier[p] < f AND shared[p], 1, 0))),
                    n -> named_struct(
                        'all', n.all, 'both', n.both,
                        'dice', IF(shared[p], greatest(s.dice, 2D * n.both / (n.all + size(own))), s.dice),
                        'last', IF(shared[p] AND 2D * n.both / (n.all + size(own)) > s.dice, p, s.last)
                    )
                )[0],
                s -> named_struct('dice', s.dice, 'before', -f, 'sooner', -s.last)
            ))[0]
        )))[0])[0]
    """
    first, last = -F.col("best.before"), -F.col("best.sooner")
    # taken out by explode, which the filter is not pushed through: each is computed once
    found = pairs.select(id_col, "licence", F.explode(F.filter(F.array(F.expr(best)), lambda b: b["dice"] >= least)).alias("best"))
    return found.select(id_col, "licence", first.alias("first_word"), (last - first + 2).alias("n_words"), F.col("best.dice").alias("dice"))
