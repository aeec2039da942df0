"""Licence scans by patience alignment.

Templates are the notices of well-known licences. A text's words and a template's are aligned by patience: words that occur once in both are anchors, the
longest run of anchors that keeps the order (longest increasing subsequence) is fixed, and the gaps between neighbouring anchors, before the first and
after the last are aligned the same way; equal words at a gap's ends match first. Coverage is the share of the template's words that are matched.

Where to align: a template's seeds are its words other than ``COMMON`` ones. A place of a template starts at a seed, spans at most ``STRETCH`` times the template's
words, and must hold enough different seeds for the coverage ``COVER`` to be possible, so texts without licence words cost one look at each word. Where a place is found it is aligned again from its own
first word, until that gains nothing. In a notice of fewer than ``LONG`` words the words that tell licences apart (``VARIANTS`` and numbers) must be the template's own, no more and no fewer; in a longer one all of the template's variants must be matched.
The scan goes on after a place that is found, so a notice that is repeated is counted again.

Defined results: null, empty and unrelated texts give no row. Rows of equal doc_id are scanned each. Templates inside each other (a short notice in a long one) are all reported. Extra columns
are ignored; an empty table gives no row.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

COVER = 0.8
STRETCH = 2.0
LONG = 40
_WORD = re.compile(r"[^\W_]+")

# Public licence notices, words that tell licences apart, and common English words.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "BSD-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code
must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission.""",
    "BSD-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "all-rights-reserved": "All rights reserved",
}
GNU = {"GPL": ("General Public License", ("2", "3")), "LGPL": ("Lesser General Public License", ("2.1", "3")), "AGPL": ("Affero General Public License", ("3",))}
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
SPDX = "Apache-2.0 MIT BSD-2-Clause BSD-3-Clause ISC Zlib MPL-2.0 EPL-2.0 BSL-1.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 CC0-1.0 Unlicense".split()
NOTICES["GPL-2.0-header"] = NOTICES["GPL-header"].replace("version 3", "version 2")
for _name, (_words, _versions) in GNU.items():
    for _v in _versions:
        NOTICES[f"{_name}-{_v}{'' if '.' in _v else '.0'}"] = f"This work is licensed under the GNU {_words}, version {_v}"
for _v in "3.0 4.0".split():
    for _name, _words in CREATIVE.items():
        NOTICES[f"CC-{_name}-{_v}"] = f"Licensed under CC {_name} {_v}"
        NOTICES[f"CC-{_name}-{_v}-notice"] = f"This work is licensed under a Creative Commons {_words} {_v} {'International' if _v == '4.0' else 'Unported'} License"
for _name in SPDX:
    NOTICES[f"{_name}-tag"] = f"SPDX-License-Identifier: {_name}"
VARIANTS = frozenset("""apache mit gpl lgpl agpl bsd isc zlib mpl epl bsl boost mozilla eclipse gnu cc cc0 creative unlicense lesser affero library clause only later sa nc nd sharealike noncommercial
noderivatives noderivs""".split())
COMMON = frozenset("""a an and any are as at be but by for from get has have if in into is it its may must not of on or other shall so such than that the their these this those to under us was will with
without you your 0 1 2 3 4 v""".split())


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def variants_of(words: list[str]) -> list[str]:
    """The words that tell licences apart."""
    return [w for w in words if w in VARIANTS or w.isdigit()]


def _increasing(at: list[int]) -> list[int]:
    """The places of a longest increasing subsequence."""
    ends: list[int] = []
    who: list[int] = []
    before = [-1] * len(at)
    for i, x in enumerate(at):
        k = bisect_left(ends, x)
        if k == len(ends):
            ends.append(x)
            who.append(i)
        else:
            ends[k], who[k] = x, i
        before[i] = who[k - 1] if k else -1
    out, i = [], who[-1] if who else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, in order in both."""
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
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if there[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if here[w] == 1 and w in place]
        run = [anchors[k] for k in _increasing([j for _, j in anchors])]
        if not run:
            continue
        out += run
        for (i, j), (k, m) in zip([(a - 1, c - 1), *run], [*run, (b, d)]):
            if k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


class Scanner:
    """Templates and their seeds."""

    def __init__(self, notices: dict[str, str] = NOTICES, cover: float = COVER):
        self.names = sorted(notices)
        self.words = [words_of(notices[n]) for n in self.names]
        self.cover = cover
        self.seeds: dict[str, list[int]] = defaultdict(list)
        self.need, self.own = [], []
        self.variants = [variants_of(w) for w in self.words]
        for t, words in enumerate(self.words):
            seeds = {w for w in words if w not in COMMON} or set(words)
            self.own.append(seeds)
            self.need.append(max(1, len(seeds) - int((1 - cover) * len(words) + 1e-9)))
            for w in seeds:
                self.seeds[w].append(t)
        self.all = frozenset(self.seeds)

    def scan(self, text: str | None) -> list[tuple[str, int, float, int, int]]:
        """name, places, best coverage, and the best place's first and last character offsets, for each licence found."""
        if not text:
            return []
        words = words_of(text)
        if self.all.isdisjoint(words):
            return []
        have: dict[int, set[str]] = defaultdict(set)
        where: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.all:
                where[w].append(i)
        for w in where:
            for t in self.seeds[w]:
                have[t].add(w)
        out, spans = [], None
        for t in sorted(t for t, ws in have.items() if len(ws) >= self.need[t]):
            found = self._places(words, t, sorted(i for w in self.own[t] for i in where.get(w, ())))
            if found:
                spans = spans or [m.span() for m in _WORD.finditer(text.lower())]
                best = max(found, key=lambda x: (x[0], -x[1]))
                out.append((self.names[t], len(found), best[0], spans[best[1]][0], spans[best[2]][1]))
        return out

    def _own_variants(self, span: list[str], pairs: list[tuple[int, int]], t: int) -> bool:
        """Whether a place of template t has its variants."""
        if len(self.words[t]) < LONG:
            return variants_of(span) == self.variants[t]
        matched = Counter(self.words[t][j] for _, j in pairs)
        return all(matched[w] >= 1 for w in self.variants[t])

    def _places(self, words: list[str], t: int, at: list[int]) -> list[tuple[float, int, int]]:
        template = self.words[t]
        size, lead = int(STRETCH * len(template)) + 3, 0  # lead: the template's words before its first seed
        while lead < len(template) and template[lead] not in self.own[t]:
            lead += 1
        found, k, held, last = [], 0, Counter(), 0
        while k < len(at):
            stop = max(last, k)
            while stop < len(at) and at[stop] < at[k] + size:
                held[words[at[stop]]] += 1
                stop += 1
            last = stop
            step = k + 1
            if len(held) >= self.need[t]:
                low = max(0, at[k] - lead, found[-1][2] + 1 if found else 0)
                pairs = patience(words[low : low + size + lead], template)
                if len(pairs) >= self.cover * len(template) - 1e-9:
                    while pairs[0][0]:  # again from its own first word: the end may have been cut off
                        more = patience(words[low + pairs[0][0] : low + pairs[0][0] + size], template)
                        if len(more) <= len(pairs):
                            break
                        low, pairs = low + pairs[0][0], more
                    if self._own_variants(words[low + pairs[0][0] : low + pairs[-1][0] + 1], pairs, t):
                        found.append((len(pairs) / len(template), low + pairs[0][0], low + pairs[-1][0]))
                        step = bisect_left(at, low + pairs[-1][0] + 1)
                        step = max(step, k + 1)
            for j in range(k, min(step, last)):
                w = words[at[j]]
                held[w] -= 1
                if not held[w]:
                    del held[w]
            k = step
        return found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licence, places, coverage, first, last: a row for each document and licence that its text holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner()
        for b in batches:
            rows = [(i, *x) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in s.scan(text)]
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "licence", "places", "coverage", "first", "last"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, licence string, places int, coverage double, first int, last int")
