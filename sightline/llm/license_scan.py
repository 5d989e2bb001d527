"""Licence scan: units of a text against licence templates, by the Dice coefficient over sets of word bigrams. DataFrame expressions only.

Units of a text are its lines, its sentences (parted by .!?;: and white space), runs of up to RUN paragraphs (parted by empty lines) and the whole; so a notice within a line and a licence of
several paragraphs within a longer text are units of their own. A run begins and ends with a paragraph that has a bigram of some template: another paragraph at an end only lowers
the coefficient. Line ends may be \\n, \\r\\n or \\r. Normalised, a unit is its runs of a-z and 0-9 after A-Z are lower-cased. With sets A and B, Dice = 2|A & B| / (|A| + |B|).

Pruning, none of which loses a match at the threshold t:
- Size: a match needs t / (2 - t) * |B| <= |A| <= (2 - t) / t * |B|; other templates aren't compared with the unit.
- Texts: a match holds at least t / (2 - t) of a template's bigrams, so one of any words that more than the rest of them contain.
  Only texts with such a word are taken apart at all.
No row leaves its task: nothing is shuffled, whatever texts or lines repeat.

Edge cases: a null or empty text, or one without two words in a row, has no match (null license, dice 0.0); of equal coefficients the greatest
template name wins; repeated rows are judged each.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import quoted

THRESHOLD = 0.8
RUN = 8

#: Notices and short texts of public licences, by SPDX name (and the form of the notice).
TEMPLATES = {
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-3-Clause notice": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 long notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense notice": "This is free and unencumbered software released into the public domain.",
}


#: Words that tell nothing of a text's kind; they are the last to decide which texts are taken apart.
COMMON = {"a", "an", "and", "any", "as", "at", "be", "by", "can", "for", "if", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with", "you"}


def bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _rows(templates: dict[str, str], threshold: float) -> list[dict]:
    rows = []
    for name, text in sorted(templates.items()):
        b = bigrams(text)
        rows.append({"name": name, "n": len(b), "lo": math.ceil(threshold / (2 - threshold) * len(b) - 1e-9), "hi": math.floor((2 - threshold) / threshold * len(b) + 1e-9), "b": b})
    return rows


def _signs(rows: list[dict]) -> list[str]:
    """Words of which any text with a match holds one: for each template so many that more of its bigrams have one of them than a match may lack.

    Words that serve for other templates already come first, then those in most bigrams that aren't covered yet; short words are the last choice."""
    signs: list[str] = []
    for r in sorted(rows, key=lambda r: r["n"]):
        open_ = {tuple(x.split()) for x in r["b"] if not set(x.split()) & set(signs)}
        while r["n"] - len(open_) < r["n"] - r["lo"] + 1:
            count: dict[str, int] = {}
            for x in open_:
                for w in set(x):
                    count[w] = count.get(w, 0) + 1
            best = max(count, key=lambda w: (w not in COMMON, len(w) > 6, count[w], len(w), w))
            signs.append(best)
            open_ = {x for x in open_ if best not in x}
    return signs


def _words(unit: str) -> str:
    return f"split(trim(lower(regexp_replace({unit}, '[^A-Za-z0-9]+', ' '))), ' ')"


def _bigrams(words: str) -> str:
    return f"array_distinct(transform(slice({words}, 1, greatest(size({words}) - 1, 0)), (a, i) -> concat(a, ' ', get({words}, i + 1))))"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with matches: array of (unit, license, dice), the best template of each unit that reaches the threshold; license and dice, the best of all; n_matches."""
    rows = _rows(templates or TEMPLATES, threshold)
    own = [c for c in docs.columns if c not in ("matches", "license", "dice", "n_matches")]
    # Columns go by numbers, so none of docs' names meets one of those made here.
    keep = [f"c{n}" for n in range(len(own))]
    known = F.from_json(F.lit(json.dumps(rows)), "array<struct<name:string,n:int,lo:int,hi:int,b:array<string>>>")
    least, most = min(r["lo"] for r in rows), max(r["hi"] for r in rows)
    any_bigram = F.array(*map(F.lit, sorted({b for r in rows for b in r["b"]})))
    d = docs.select(*[F.col(quoted(c)).alias(k) for c, k in zip(own, keep, strict=True)], F.regexp_replace(F.coalesce(F.col(quoted(text)), F.lit("")), "\r\n?", "\n").alias("whole"))
    held = F.arrays_overlap(F.split(F.lower(F.regexp_replace("whole", "[^A-Za-z0-9]+", " ")), " "), F.array(*map(F.lit, _signs(rows))))
    d = d.select(*keep, F.when(held, F.col("whole")).alias("whole"), known.alias("known"), any_bigram.alias("any"))
    d = d.select(*keep, "whole", "known", "any", F.split("whole", "\n[ \t\n]*\n").alias("paragraphs"))
    d = d.select(*keep, "whole", "known", "paragraphs", F.expr(f"transform(transform(paragraphs, p -> {_words('p')}), w -> arrays_overlap({_bigrams('w')}, any))").alias("hit"))
    runs = f"""flatten(transform(filter(sequence(0, size(paragraphs) - 1), i -> hit[i]), i -> transform(filter(sequence(i, least(i + {RUN}, size(paragraphs)) - 1), j -> hit[j]),
        j -> array_join(slice(paragraphs, i + 1, j - i + 1), '\n\n'))))"""
    units = F.array_distinct(F.concat(F.split("whole", "\n"), F.split("whole", "[.!?;:][ \t\n]+"), F.expr(runs), F.array("whole")))
    d = d.select(*keep, "known", F.coalesce(units, F.array().cast("array<string>")).alias("units"))
    d = d.select(*keep, "known", F.expr(f"transform(units, u -> struct(u as unit, {_words('u')} as w))").alias("units"))
    d = d.select(*keep, "known", F.expr(f"transform(units, x -> struct(x.unit as unit, {_bigrams('x.w')} as b))").alias("units"))
    d = d.select(*keep, "known", F.expr(f"filter(units, x -> size(x.b) between {least} and {most})").alias("units"))
    best = "array_max(transform(filter(known, t -> size(x.b) between t.lo and t.hi), t -> struct(2.0D * size(array_intersect(x.b, t.b)) / (size(x.b) + t.n) as dice, t.name as license)))"
    d = d.select(*keep, F.expr(f"transform(units, x -> struct(x.unit as unit, {best} as best))").alias("found"))
    d = d.select(*keep, F.expr(f"transform(filter(found, x -> x.best.dice >= {threshold}D), x -> struct(x.unit as unit, x.best.license as license, x.best.dice as dice))").alias("matches"))
    d = d.select(*keep, "matches", F.expr("array_max(transform(matches, m -> struct(m.dice as dice, m.license as license)))").alias("best"))
    top = F.struct("matches", F.col("best.license").alias("license"), F.coalesce(F.col("best.dice"), F.lit(0.0)).alias("dice"), F.size("matches").cast("long").alias("n_matches"))
    return d.select(*[F.col(k).alias(c) for c, k in zip(own, keep, strict=True)], F.inline(F.array(top)))


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The query over documents as DuckDB SQL: (doc_id, license, dice, n_matches)."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(r['name'])}, {r['n']}, {r['lo']}, {r['hi']}, [{', '.join(map(quote, r['b']))}])" for r in _rows(templates or TEMPLATES, threshold))
    words = lambda u: f"string_split(trim(lower(regexp_replace({u}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
    return f"""
WITH t(name, n, lo, hi, b) AS (VALUES {values}),
y AS (SELECT list_distinct(flatten(list(b))) AS b FROM t),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_replace(coalesce(text, ''), '\r\n?', '\n', 'g') AS text FROM documents),
p AS (SELECT k, regexp_split_to_array(text, '\n[ \t\n]*\n') AS p FROM d),
i AS (SELECT k, p, unnest(range(1, len(p) + 1)) AS i FROM p),
j AS (SELECT k, p, i, {words("p[i]")} AS w FROM i),
h AS (SELECT k, p, i FROM j, y WHERE list_has_any([w[n] || ' ' || w[n + 1] FOR n IN range(1, len(w))], y.b)),
r AS (SELECT a.k, array_to_string(a.p[a.i:b.i], '\n\n') AS unit FROM h a JOIN h b ON a.k = b.k AND b.i BETWEEN a.i AND a.i + {RUN - 1}),
u AS (SELECT DISTINCT k, unnest(list_concat(list_concat(string_split(text, '\n'), regexp_split_to_array(text, '[.!?;:][ \t\n]+')), [text])) AS unit FROM d UNION SELECT k, unit FROM r),
w AS (SELECT k, unit, {words("unit")} AS w FROM u),
g AS (SELECT k, unit, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM w),
s AS (SELECT k, unit, 2.0::DOUBLE * len(list_intersect(g.b, t.b)) / (len(g.b) + t.n) AS dice, t.name AS license FROM g JOIN t ON len(g.b) BETWEEN t.lo AND t.hi),
m AS (SELECT k, unit, max({{'dice': dice, 'license': license}}) AS best FROM s GROUP BY k, unit),
f AS (SELECT k, max(best) AS best, count(*) AS n FROM m WHERE best.dice >= {threshold} GROUP BY k)
SELECT d.doc_id, f.best.license AS license, coalesce(f.best.dice, 0.0::DOUBLE) AS dice, coalesce(f.n, 0) AS n_matches FROM d LEFT JOIN f USING (k)"""
