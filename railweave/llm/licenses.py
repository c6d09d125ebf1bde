"""License notices in texts, by patience alignment with templates."""

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import text_udf

#: Short notices and opening or closing passages of public licences.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All-rights-reserved": "All rights reserved.",
    "BSD-notice": "Released under the BSD License.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0-short-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
TEMPLATES |= {
    "GPL-2.0": TEMPLATES["GPL-3.0"].replace("version 3", "version 2"),
    "LGPL-2.1": TEMPLATES["GPL-3.0"].replace("This program", "This library").replace("General Public", "Lesser General Public").replace("version 3", "version 2.1"),
    "LGPL-3.0": TEMPLATES["GPL-3.0"].replace("This program", "This library").replace("General Public", "Lesser General Public"),
    "AGPL-3.0": TEMPLATES["GPL-3.0"].replace("General Public", "Affero General Public"),
    "BSD-2-Clause": TEMPLATES["BSD-3-Clause"].partition(" Neither")[0],
}
#: Phrases that tell a licence from its kin: each must be aligned word by word, without other words between.
IDENTITY = {
    "MIT-notice": ["mit"], "BSD-notice": ["bsd"], "BSD-3-Clause": ["endorse"], "Apache-2.0-notice": ["apache license", "2.0"], "Apache-2.0": ["apache license", "2.0"], "MPL-2.0": ["mozilla public license", "2.0"], "Unlicense": ["public domain"],
    "CC-BY-NC-4.0-notice": ["cc by nc 4.0"], "CC-BY-4.0-short-notice": ["cc by 4.0"], "CC-BY-SA-4.0-short-notice": ["cc by sa 4.0"], "CC-BY-4.0-notice": ["attribution 4.0"], "CC-BY-SA-4.0-notice": ["attribution sharealike 4.0"],
} | {f"{kind}-{version}{form}": [f"{word}general public license", version.removesuffix(".0")] for kind, word, versions in (("GPL", "", ("2.0", "3.0")), ("LGPL", "lesser ", ("2.1", "3.0")), ("AGPL", "affero ", ("3.0",))) for version in versions for form in ("", "-notice")}
#: Words that make a phrase that they precede another one.
KIN = frozenset(("lesser", "library", "affero"))
#: Templates that are part of another: not reported within its text.
PART_OF = {"BSD-2-Clause": "BSD-3-Clause"}

WORD = re.compile(r"[a-z0-9]+(?:[.-][0-9]+)*")
#: Share of a template's words that must be aligned.
COVERAGE = 0.8
#: Common English words, which alone never start an alignment.
COMMON = frozenset("a all an and any any are as at be by can do either for form free from hereby holder if in is it its later law may means met more name names no nor not of on one or other out person persons program purpose sell see so subject that the this to under use used was whom with without work you your".split())


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that increases in both places; pairs come ordered by the first."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        before[k] = last[at - 1] if at else -1
        tails[at : at + 1], last[at : at + 1] = [b], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned word positions of `text` and `template`, increasing in both.

    Equal ends are taken off first; words unique to both sides anchor the rest, the longest
    increasing run of anchors stays, and each gap between anchors is aligned in turn.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(template[c:d], c) if in_template[w] == 1}
        anchors = increasing([(k, place[w]) for k, w in enumerate(text[a:b], a) if in_text[w] == 1 and w in place])
        out += anchors
        ends = [(a - 1, c - 1), *anchors, (b, d)]
        if anchors:
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(ends, ends[1:])]
    return sorted(out)


def identified(pairs: list[tuple[int, int]], text: list[str], template: list[str], phrases: list[list[str]]) -> bool:
    """Whether each phrase is aligned in one piece at one of its places in the template, and no word of KIN precedes it."""
    at = {b: a for a, b in pairs}
    for phrase in phrases:
        places = [k for k in range(len(template) - len(phrase) + 1) if template[k : k + len(phrase)] == phrase]
        whole = [at[k] for k in places if k in at and all(at.get(k + i) == at[k] + i for i in range(len(phrase)))]
        if not whole or any(a and text[a - 1] in KIN for a in whole):
            return False
    return True


class Template:
    """Words of a template, its telling words (not common ones) and the phrases of IDENTITY; own templates have none."""

    def __init__(self, name: str, text: str):
        self.name, self.words = name, words_of(text)
        self.phrases = [p.split() for p in IDENTITY.get(name, ())] if TEMPLATES.get(name) == text else []
        #: Telling words and the first place of each.
        self.telling: dict[str, int] = {}
        for at, w in enumerate(self.words):
            if w not in COMMON:
                self.telling.setdefault(w, at)

    def enough(self, coverage: float) -> int:
        """Distinct telling words that any `coverage` of the template must have: all but those that the other words can be."""
        spare = len(self.words) - math.ceil(coverage * len(self.words) - 1e-9)
        return max(1, len(self.telling) - spare)

    def fit(self, words: list[str], coverage: float) -> list[tuple[int, int]]:
        """Aligned pairs of `words` with the template if they cover it, stand within one and a half times its length and have its phrases, else none."""
        pairs = patience(words, self.words)
        near = len(pairs) >= coverage * len(self.words) - 1e-9 and 2 * (pairs[-1][0] - pairs[0][0]) < 3 * len(self.words)
        return pairs if near and identified(pairs, words, self.words, self.phrases) else []


@lru_cache(maxsize=4)
def _prepared(templates: tuple[tuple[str, str], ...]) -> tuple[list[Template], dict[str, list[int]]]:
    """The templates, and which of them each telling word is of."""
    made, telling = [Template(name, text) for name, text in templates], {}
    for k, t in enumerate(made):
        for w in t.telling:
            telling.setdefault(w, []).append(k)
    return made, telling


def windows(places: list[int], words: list[str], t: Template, enough: int) -> Iterator[tuple[int, int]]:
    """Windows of the text to align with a template of n words: 3n words every n words, that have enough distinct telling words.

    A copy of at most 3n/2 words lies whole in one of them. Each place is looked at three times
    at most, so the work grows with the places and not with their square.
    """
    n, low, high = len(t.words), 0, 0
    for start in sorted({max(0, p // n - d) * n for p in places for d in range(3)}):
        low, high = bisect_left(places, start, low), bisect_left(places, start + 3 * n, high)
        if high - low >= enough and len({words[p] for p in places[low:high]}) >= enough:
            yield start, start + 3 * n


def starts(start: int, end: int, places: list[int], words: list[str], t: Template) -> list[int]:
    """Where copies of the template may begin in a window: at its telling words, as far in front as they stand in the template."""
    at = range(bisect_left(places, start), bisect_left(places, end))
    return sorted({max(start, places[k] - t.telling[words[places[k]]]) for k in at})


def copies(words: list[str], places: list[int], t: Template, coverage: float) -> list[tuple[int, int, int]]:
    """(words aligned, first word, last word) of the copies of a template, which do not overlap.

    A window is aligned as a whole. Where that does not fit, several copies may stand in it,
    of which no word is unique, or words around a copy draw the alignment away; then
    stretches of once and one and a half times the template's length are aligned from the places where it
    may begin.
    """
    found, enough, n = [], t.enough(coverage), len(t.words)
    for start, end in windows(places, words, t, enough):
        start = max(start, found[-1][2] + 1) if found else start
        while start < end:
            pairs = t.fit(words[start:end], coverage)
            if not pairs:
                told = lambda s, size: len({words[p] for p in places[bisect_left(places, s) : bisect_left(places, s + size)]})
                tries = ((s, size) for s in starts(start, end, places, words, t) for size in (n, 3 * n // 2) if told(s, size) >= enough)
                start, pairs = next(((s, p) for s, size in tries if (p := t.fit(words[s : s + size], coverage))), (start, []))
            if not pairs:
                break
            found.append((len(pairs), start + pairs[0][0], start + pairs[-1][0]))
            start = found[-1][2] + 1
    return found


def find(text: str, templates: tuple[tuple[str, str], ...], coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, words aligned, first word, last word) for each copy of a template in the text.

    Words of a template that are not common ones mark places; windows around enough of them
    are aligned. Templates that are part of another are not reported within its copies.
    """
    made, telling = _prepared(templates)
    words = words_of(text)
    marks: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        for k in telling.get(word, ()):
            marks.setdefault(k, []).append(at)
    found = [(made[k].name, n / len(made[k].words), n, first, last) for k, places in marks.items() for n, first, last in copies(words, places, made[k], coverage)]
    wider = {part: [(f[3], f[4]) for f in found if f[0] == whole] for part, whole in PART_OF.items()}
    found = [f for f in found if not any(a <= f[4] and f[3] <= b for a, b in wider.get(f[0], ()))]
    return sorted(found, key=lambda x: (-x[1], -x[2], x[0], x[3]))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, coverage, n_aligned, first_word, last_word, n_licenses, licenses) for each row of `docs`.

    license is the template with the highest coverage, then the most aligned words, then the
    first name; null with coverage 0 and no positions where no template reaches `coverage`.
    licenses has all names found, sorted and joined by commas. Null or empty texts have
    none. Null and repeated ids keep their rows; other columns are not read; an empty table
    gives an empty result. The templates are a parameter and travel with the function.
    """
    given = tuple(sorted((TEMPLATES if templates is None else templates).items()))

    def make():
        def work(texts: list[str]) -> list[tuple]:
            rows = []
            for text in texts:
                found = find(text, given, coverage)
                names = sorted({f[0] for f in found})
                rows.append((*(found[0] if found else (None, 0.0, 0, None, None)), len(names), ",".join(names)))
            return rows

        return work

    fields = {"license": pa.string(), "coverage": pa.float64(), "n_aligned": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "n_licenses": pa.int64(), "licenses": pa.string()}
    told = docs.select(F.col(id_col), text_udf(make, **fields)(F.col(text_col)).alias("l"))
    return told.select(id_col, *(f"l.{c}" for c in fields))
