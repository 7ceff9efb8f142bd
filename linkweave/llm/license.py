"""Licence notices by Dice coefficient over word bigrams. Native functions only."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, let, row_key

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_END = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
_BSD_2 = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_END = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = """This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version."""
_GNU_END = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain."""
_UNLICENSE_MORE = """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""


def _gnu(version: str, name: str = "") -> list[str]:
    first = _GNU.format(colon=":", comma=",", name=name, version=version)
    return [f"This work is licensed under the GNU {name}General Public License, version {version}.", first, f"{first} {_GNU_END.format(name=name)}"]


# Customary notices and short full texts of public licences, by SPDX identifier.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE, f"{_APACHE} {_APACHE_END}"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", _MIT, f"{_MIT} {_MIT_END}"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", f"{_BSD} {_BSD_2}", f"{_BSD} {_BSD_2} {_BSD_END}"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", _BSD, f"{_BSD} {_BSD_2} {_BSD_3}", f"{_BSD} {_BSD_2} {_BSD_3} {_BSD_END}"],
    "ISC": [f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"],
    "0BSD": [f"{_ISC}. {_ISC_END}"],
    "Zlib": [_ZLIB],
    "GPL-3.0": _gnu("3"),
    "GPL-2.0": _gnu("2"),
    "LGPL-3.0": _gnu("3", "Lesser "),
    "LGPL-2.1": _gnu("2.1", "Lesser "),
    "AGPL-3.0": _gnu("3", "Affero "),
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Unlicense": [_UNLICENSE, f"{_UNLICENSE} {_UNLICENSE_MORE}"],
}


def _words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def templates(notices: dict[str, list[str]] = NOTICES) -> list[tuple[str, int, int, str, int]]:
    """(licence, form, size, bigram, count) of each template; size is its number of bigrams."""
    rows = []
    for licence, forms in notices.items():
        for form, text in enumerate(forms):
            w = _words(text)
            pairs = Counter(f"{a} {b}" for a, b in zip(w, w[1:]))
            rows += [(licence, form, len(w) - 1, pair, n) for pair, n in pairs.items()]
    return rows


def size_bounds(size: int, threshold: float = THRESHOLD) -> tuple[float, float]:
    """Sizes of texts that can reach the threshold: 2 min / (a + b) bounds the coefficient."""
    return size * threshold / (2 - threshold), size * (2 - threshold) / threshold


#: Words of the notices that any text may have: key words only where nothing else will do.
_COMMON = frozenset("a all an and any are as at be being but by can do each for from if in into is it its may more must no non nor not of on one or other out see shall so such that the this to under use used was way will with work you your 0 1 2 3 4".split())


def key_words(rows: list[tuple[str, int, int, str, int]], threshold: float = THRESHOLD) -> list[str]:
    """Words, long ones first, of which each unit that matches one of these templates has one at least.

    With s bigrams shared by sizes a >= s and b, 2 s / (a + b) >= t gives s >= b t / (2 - t). So if fewer
    of a template's bigrams than that have none of the words, a match shares one that has. Half the
    last digit that the coefficient is rounded to is taken off the threshold.
    """
    least = threshold - 1e-6
    forms: dict[tuple[str, int], dict[str, int]] = {}
    sizes: dict[tuple[str, int], int] = {}
    for licence, form, size, bigram, n in rows:
        forms.setdefault((licence, form), {})[bigram] = n
        sizes[licence, form] = size
    found: set[str] = set()
    # Templates are done in turn, the shortest first; a word is worth the more, the longer it is and the more it covers of what is asked.
    for at in sorted(forms, key=lambda k: (sizes[k], k)):
        while rest := {b: n for b, n in forms[at].items() if not found & set(b.split())}:
            asked = sum(rest.values()) - least / (2 - least) * sizes[at]
            if asked < 0:
                break
            covers = Counter()
            for bigram, n in rest.items():
                covers.update(dict.fromkeys(bigram.split(), n))
            worth = {w: min(n, math.floor(asked) + 1) * min(len(w), 8) ** 2 / (1000 if w in _COMMON else 1) for w, n in covers.items()}
            found.add(min(worth, key=lambda w: (-worth[w], w)))
    return sorted(found, key=lambda w: (-len(w), w))


def has_word(text: Column, words: list[str]) -> Column:
    """Whether one of the words (a-z, 0-9) stands in the text, A-Z lowered, between anything but ASCII letters and digits.

    The first letters come as one class, which most places of a text fail, then the others by the second
    letter. So a word may also begin with another's first letter, which lets more through, never less.
    """
    seconds: dict[str, list[str]] = {}
    for word in words:
        seconds.setdefault(word[1:2], []).append(word[2:])
    rest = "|".join(f"{second}(?:{'|'.join(dict.fromkeys(ends))})" for second, ends in sorted(seconds.items(), reverse=True))
    return text.rlike(f"(?i)[{''.join(sorted({w[0] for w in words}))}](?<![a-z0-9].)(?:{rest})(?![a-z0-9])")


def normalised(text: Column) -> Column:
    """A-Z lowered; every run of anything but ASCII letters and digits is one space, and where it has line ends, those alone."""
    # What is left is ASCII, where lower() is A-Z's alone.
    clean = F.lower(F.regexp_replace(text, "[^A-Za-z0-9\n]+", " "))
    return F.replace(F.replace(clean, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))


def units(body: Column) -> Column:
    """(unit, line) of a text: 0 is the whole, from 1 on its lines, from -1 down its paragraphs of two lines or more.

    A paragraph is a run of lines with words, and so are two in a row: that takes in a notice
    that is wrapped, and one whose conditions stand in a paragraph of their own.
    """

    def of(clean):
        flat = lambda x: F.trim(F.translate(x, "\n", " "))
        lines = F.transform(F.split(clean, "\n", -1), lambda x, i: F.struct((i + 1).alias("unit"), F.trim(x).alias("line")))
        parts = F.filter(F.split(clean, "\n\n+", -1), lambda x: F.trim(F.translate(x, "\n", " ")) != "")
        each = let(parts, lambda p: F.concat(F.transform(p, lambda x: F.struct(F.contains(F.trim(x, F.lit("\n")), F.lit("\n")).alias("long"), flat(x).alias("line"))), F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.size(p)), lambda x, y: F.struct(F.lit(True).alias("long"), F.concat_ws(" ", flat(x), flat(y)).alias("line")))))
        paragraphs = F.transform(F.filter(F.transform(each, lambda x, i: F.struct((-1 - i).alias("unit"), x["line"].alias("line"), x["long"].alias("long"))), lambda x: x["long"]), lambda x: F.struct(x["unit"].alias("unit"), x["line"].alias("line")))
        return F.concat(F.array(F.struct(F.lit(0).alias("unit"), F.regexp_replace(flat(clean), " +", " ").alias("line"))), lines, paragraphs)

    return let(normalised(body), of)


def licence_matches(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(doc_id, key, unit, licence, dice) of the units of a text that match a licence template.

    Units (:func:`units`) are lines, paragraphs, pairs of paragraphs and the whole text. A notice inside a
    longer line or paragraph is found only as far as that unit's size allows. Other columns are not read.
    Dice is over the multisets of bigrams: twice the shared count over both sizes. A unit
    is compared with a template only if their sizes allow the threshold and they share a bigram,
    for which texts and units without any of :func:`key_words` are passed over: they match nothing. The best
    licence of a unit counts, the first in code-point order of equals. Null and
    empty texts and units of one word have no bigram and no match; repeated rows are one.
    """
    spark = docs.sparkSession
    # The templates are a fixed table of this module, a few hundred rows.
    table = spark.createDataFrame([(*r, *size_bounds(r[2], threshold)) for r in templates()], "licence string, form int, size int, bigram string, n_t int, lo double, hi double")
    least, most = (min(size_bounds(r[2], threshold)[0] for r in templates()), max(size_bounds(r[2], threshold)[1] for r in templates()))
    body, needed = filled(text), key_words(templates(), threshold)
    parts = docs.where(has_word(body, needed)).select("doc_id", row_key(body).alias("key"), F.inline(units(body)).alias("unit", "line"))
    parts = parts.withColumn("size_u", F.length("line") - F.length(F.translate("line", " ", "")))
    parts = parts.where(F.col("size_u").between(least, most) & (F.col("line") != "") & has_word(F.col("line"), needed))
    words = parts.select("doc_id", "key", "unit", "size_u", F.split("line", " ").alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    bigrams = words.select("doc_id", "key", "unit", "size_u", F.explode(pairs).alias("bigram"))
    met = bigrams.join(F.broadcast(table), "bigram").where("size_u between lo and hi")
    counted = met.groupBy("doc_id", "key", "unit", "size_u", "licence", "form", "size", "bigram", "n_t").agg(F.count("*").alias("n_u"))
    dice = F.round(2 * F.sum(F.least("n_u", "n_t")) / (F.col("size_u") + F.col("size")), 6)
    scored = counted.groupBy("doc_id", "key", "unit", "size_u", "licence", "form", "size").agg(dice.alias("dice")).where(F.col("dice") >= threshold)
    # Greatest coefficient, then the first licence.
    ranked = scored.groupBy("doc_id", "key", "unit", "licence").agg(F.max("dice").alias("dice"))
    return ranked.groupBy("doc_id", "key", "unit").agg(F.min(F.struct((-F.col("dice")).alias("d"), "licence")).alias("m")).select("doc_id", "key", "unit", "m.licence", (-F.col("m.d")).alias("dice"))


def op3_license_scan(docs: DataFrame) -> DataFrame:
    return licence_matches(docs).select("doc_id", "unit", "licence", "dice").distinct()


def _sql() -> str:
    rows = ", ".join(f"('{lic}', {form}, {size}, '{pair}', {n}, {size_bounds(size)[0]!r}, {size_bounds(size)[1]!r})" for lic, form, size, pair, n in templates())
    norm = "regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\n]+', ' ', 'g'), ' ?(\n) ?', '\\1', 'g')"
    flat = "trim(replace({}, chr(10), ' '))"
    return f"""
with t(licence, form, size, bigram, n_t, lo, hi) as (values {rows}),
d as (select distinct doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, text, {norm} as clean from d),
q as (select doc_id, text, clean, list_filter(string_split_regex(clean, '\n\n+'), lambda x: {flat.format('x')} <> '') as p from n),
e as (select doc_id, text, unnest(p) as x, generate_subscripts(p, 1) as i, len(p) as m, p from q),
u as (select doc_id, text, 0 as unit, regexp_replace({flat.format('clean')}, ' +', ' ', 'g') as line from n
      union all select doc_id, text, i, trim(line) from
        (select doc_id, text, unnest(string_split(clean, chr(10))) as line, generate_subscripts(string_split(clean, chr(10)), 1) as i from n)
      union all select doc_id, text, -i, {flat.format('x')} from e where contains(trim(x, chr(10)), chr(10))
      union all select doc_id, text, -(m + i), {flat.format('x')} || ' ' || {flat.format('p[i + 1]')} from e where i < m),
w as (select doc_id, text, unit, string_split(line, ' ') as w from u where line <> ''),
b as (select doc_id, text, unit, len(w) - 1 as size_u, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as bigram from w),
c as (select doc_id, text, unit, size_u, licence, form, size, bigram, n_t, count(*) as n_u from b join t using (bigram)
      where size_u between lo and hi group by all),
s as (select doc_id, text, unit, licence, round(2 * sum(least(n_u, n_t)) / (size_u + size), 6) as dice from c group by doc_id, text, unit, size_u, licence, form, size)
select doc_id, unit::int as unit, licence, dice from s where dice >= {THRESHOLD}
qualify row_number() over (partition by doc_id, text, unit order by dice desc, licence) = 1"""


OP3_SQL = _sql()
