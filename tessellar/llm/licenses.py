"""License scans: Dice coefficient over word bigrams against license templates, DataFrame functions only.

Text is normalised (lower case, runs of other characters than letters and digits become one space).
Compared are its lines, the whole text, and windows: for each template, the runs of as many words as it
has, across line breaks, that start with one of its bigrams; so a notice is found wherever it stands and
however it is wrapped. With sets A of a unit and B of a template, 2|A & B| / (|A| + |B|) >= t needs |A|
between t|B|/(2-t) and (2-t)|B|/t: only templates inside these bounds are compared. It also needs
t|B|/(2-t) shared bigrams: a window is looked at only if so many of its places hold one, which takes a
single look at the list of such places; and a set of guard words that leaves fewer bigrams than that
uncovered in every template lets texts without a guard word be passed over without loss.

Null, empty and one-word units have no bigrams and match nothing. Rows are independent: nothing is
shuffled but what was found. Repeated rows of one id are reported once.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellar.llm.common import bound

# License notices and texts, as published by their stewards.
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", _BSD_GRANT),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", _ISC_GRANT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", _MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _MIT_WARRANTY),
    ("ISC", _ISC_GRANT + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_CLAUSES + " " + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_CLAUSES + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)
# Frequent words, which guard nothing.
FREQUENT = frozenset("0 a all also an and any are as at author be both but by can change claim code conditions documentation either event express following for form found free from general have if implied in including into is it later law legal limited list made materials may must name no not of on option or original other out part particular permitted person possible product provided public published purpose related required rights same shall should so source subject substantial such that the their this to under use used version was were will with without work you your 1 2 3 4".split())
DICE = 0.8


def normalise(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def template_bigrams(text: str) -> list[str]:
    words = normalise(text).split(" ")
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def guard_words(templates, dice: float) -> list[str]:
    """Words such that each template, without the bigrams that hold one, keeps too few to reach the threshold."""
    open_ = [(set(b), needed(len(b), dice)) for b in (template_bigrams(t) for _, t in templates)]
    chosen: list[str] = []
    while rest := [(b, need) for b, need in open_ if len(b) >= need]:
        gain = Counter(w for b, _ in rest for x in b for w in set(x.split(" ")))
        word = max(sorted(gain), key=lambda w: (w not in FREQUENT, gain[w], len(w)))
        chosen.append(word)
        open_ = [({x for x in b if word not in x.split(" ")}, need) for b, need in open_]
    return chosen


def needed(bigrams: int, dice: float) -> int:
    """Shared bigrams without which no unit reaches the threshold."""
    return math.ceil(dice * bigrams / (2 - dice) - 1e-9)


def _words(unit: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{Nd}]+", " ")), " "), lambda w: w != "")


def _pairs(words: Column, join) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), join)


def _bigrams(unit: Column) -> Column:
    return bound(_words(unit), lambda w: F.array_distinct(_pairs(w, lambda a, b: F.concat_ws(" ", a, b))))


SLOTS = 1024
WINDOW = "array<struct<line:int,license:string,dice:double>>"


def _lookup(sets: list[tuple[str, list[str]]]) -> Column:
    """The templates of each bigram as a hash table: SLOTS lists of (bigram, template), by the bigram's hash."""
    slots = defaultdict(list)
    for t, (_, bigrams) in enumerate(sets):
        for b in bigrams:
            slots[xxhash.xxh64_intdigest(b.encode(), 42) % SLOTS].append(f"named_struct('b', '{b}', 't', {t})")
    empty = "cast(array() as array<struct<b:string,t:int>>)"
    return F.expr("array(" + ", ".join(f"array({', '.join(slots[k])})" if slots[k] else empty for k in range(SLOTS)) + ")")


def _windows(text: Column, sets: list[tuple[str, list[str]]], lengths: list[int], dice: float) -> Column:
    """(line, license, dice) of each window that reaches the threshold: at each start the templates of highest dice."""
    numbers = [list(x) for x in zip(*((length, len(b), needed(len(b), dice)) for length, (_, b) in zip(lengths, sets, strict=True)), strict=True)]
    length, size, need = (F.array(*map(F.lit, x)) for x in numbers)
    names = F.array(*(F.lit(n) for n, _ in sets))
    lines = F.transform(F.split(text, "\r\n|\r|\n"), lambda x, i: F.transform(_words(x), lambda w: F.struct((i + 1).alias("line"), w.alias("w"))))
    grams = bound(F.flatten(lines), lambda w: _pairs(w, lambda a, b: F.struct(a["line"].alias("line"), F.concat_ws(" ", a["w"], b["w"]).alias("b"))))
    slots = _lookup(sets)

    def places(grams: Column) -> Column:
        """(template, place) of each bigram of a template, sorted."""
        own = lambda g: F.get(slots, F.pmod(F.xxhash64(g["b"]), F.lit(SLOTS)).cast("int"))
        return F.array_sort(F.flatten(F.transform(grams, lambda g, i: F.transform(F.filter(own(g), lambda e: e["b"] == g["b"]), lambda e: F.struct(e["t"].alias("t"), i.alias("at"))))))

    def look(x: Column) -> Column:
        grams, hits = x["grams"], x["hits"]

        def dense(h: Column, j: Column) -> Column:
            return bound(F.get(hits, j + F.get(need, h["t"]) - 1), lambda last: F.coalesce((last["t"] == h["t"]) & (last["at"] < h["at"] + F.get(length, h["t"])), F.lit(False)))

        def scored(c: Column) -> Column:
            h, n = c["h"], F.get(length, c["h"]["t"])
            inside = F.filter(F.slice(hits, c["j"] + 1, n), lambda y: (y["t"] == h["t"]) & (y["at"] < h["at"] + n))
            shared = F.size(F.array_distinct(F.transform(inside, lambda y: F.get(grams, y["at"])["b"])))
            own = F.size(F.array_distinct(F.transform(F.slice(grams, h["at"] + 1, n), lambda g: g["b"])))
            return F.struct(h["at"].alias("at"), F.get(names, h["t"]).alias("license"), (2.0 * shared / (own + F.get(size, h["t"]))).alias("dice"))

        numbered = F.transform(hits, lambda h, j: F.struct(h.alias("h"), j.alias("j")))
        wins = F.array_sort(F.filter(F.transform(F.filter(numbered, lambda c: dense(c["h"], c["j"])), scored), lambda w: w["dice"] >= dice))

        def best(wins: Column) -> Column:
            beaten = lambda w, i: F.exists(F.slice(wins, F.greatest(i - len(sets), F.lit(0)) + 1, 2 * len(sets) + 1), lambda o: (o["at"] == w["at"]) & (o["dice"] > w["dice"]))
            top = F.filter(wins, lambda w, i: ~beaten(w, i))
            return F.transform(top, lambda w: F.struct(F.get(grams, w["at"])["line"].alias("line"), w["license"].alias("license"), w["dice"].alias("dice")))

        return bound(wins, best)

    return bound(bound(grams, lambda g: F.struct(g.alias("grams"), places(g).alias("hits"))), look)


def matches(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, dice: float = DICE) -> DataFrame:
    """A row for each document and license that some unit is nearest to: doc_id, license, dice (best), line (first that a unit starts in, from 1; 0: the whole text)."""
    sets = [(name, template_bigrams(t)) for name, t in templates]
    known = F.expr("array(" + ", ".join(f"named_struct('license', '{name}', 'b', array({', '.join(repr(x) for x in b)}))" for name, b in sets) + ")")
    guard = r"(?iu)(?<![\p{L}\p{Nd}])(?:" + "|".join(map(re.escape, guard_words(templates, dice))) + r")(?![\p{L}\p{Nd}])"
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where(F.col("t").rlike(guard))
    lines = F.transform(F.split("t", "\r\n|\r|\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("unit")))
    whole = F.array(F.struct(F.lit(0).alias("line"), F.col("t").alias("unit")))
    units = F.filter(F.concat(lines, whole), lambda u: u["unit"].rlike(guard))

    def compared(u: Column) -> Column:
        """The templates nearest to a unit, of those that reach the threshold."""
        n = F.size(u["a"])
        fitting = F.filter(known, lambda k: (n * (2 - dice) >= F.size(k["b"]) * dice) & (n * dice <= F.size(k["b"]) * (2 - dice)))
        scored = F.transform(fitting, lambda k: F.struct(u["line"].alias("line"), k["license"].alias("license"), (2.0 * F.size(F.array_intersect(u["a"], k["b"])) / (n + F.size(k["b"]))).alias("dice")))
        return bound(F.filter(scored, lambda s: s["dice"] >= dice), lambda s: F.filter(s, lambda x: x["dice"] == F.array_max(F.transform(s, lambda y: y["dice"]))))

    own = F.flatten(F.transform(F.transform(units, lambda u: F.struct(u["line"].alias("line"), _bigrams(u["unit"]).alias("a"))), compared))
    windows = _windows(F.col("t"), sets, [len(normalise(t).split(" ")) - 1 for _, t in templates], dice)
    hits = docs.select("doc_id", F.explode(F.concat(own, windows)).alias("s"))
    return hits.groupBy("doc_id", F.col("s.license").alias("license")).agg(F.max("s.dice").alias("dice"), F.min("s.line").alias("line"))


def report(df: DataFrame) -> DataFrame:
    return matches(df).select("doc_id", "license", F.round("dice", 6).alias("dice"), "line")
