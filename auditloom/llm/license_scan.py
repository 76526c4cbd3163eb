"""License scan by patience alignment.

A template's words are aligned with those of a text region: words unique to both sides are anchors,
their longest increasing subsequence fixes the anchors that keep order, and the gaps between anchors
are aligned the same way, down to equal words at a gap's ends. Coverage is the share of the
template's words that were aligned.

Regions lie around the occurrences of a template's key words (its longest words, so many that a match of enough
coverage holds at least one of their places): as far to both sides as the template is long, and half as far again. A match of at least
``least`` coverage is reported and the scan goes on behind it, so a notice that stands twice is found twice; of
matches that overlap, the one with more aligned words stays, then the one of higher coverage.

Cases: null and empty texts have no matches; repeated rows get equal results; texts are scanned whole;
an empty table gives no rows; other columns are not read. Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import ship

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

# Public license notices and texts, (license, notice).
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", MIT_TEXT),
    ("ISC", ISC_TEXT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under Apache 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", APACHE_NOTICE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", GPL_NOTICE.format(name="General Public License", n=2)),
    ("GPL-3.0", GPL_NOTICE.format(name="General Public License", n=3)),
    ("LGPL-2.1", GPL_NOTICE.format(name="Lesser General Public License", n=2.1)),
    ("LGPL-3.0", GPL_NOTICE.format(name="Lesser General Public License", n=3)),
    ("AGPL-3.0", GPL_NOTICE.format(name="Affero General Public License", n=3)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", f"{BSD_HEAD}\n{BSD_TAIL}"),
    ("BSD-3-Clause", f"{BSD_HEAD}\n{BSD_THIRD}\n{BSD_TAIL}"),
    ("reserved", "All rights reserved."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0")),
)


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops, top_at, before = [], [], []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        before.append(top_at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[p], top_at[p] = v, i
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned (place in a, place in b), ascending."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        seen: dict[str, list[int]] = {}
        for k in range(a0, a1):
            seen.setdefault(a[k], [0, 0, k, -1])[0] += 1
        for k in range(b0, b1):
            if b[k] in seen:
                e = seen[b[k]]
                e[1] += 1
                e[3] = k
        anchors = sorted((e[2], e[3]) for e in seen.values() if e[0] == e[1] == 1)
        anchors = [anchors[i] for i in increasing([y for _, y in anchors])]
        if not anchors:
            continue
        x, y = a0, b0
        for p, q in anchors:
            work.append((x, p, y, q))
            out.append((p, q))
            x, y = p + 1, q + 1
        work.append((x, a1, y, b1))
    return sorted(out)


class Template:
    """A notice's words, and its keys for matches that cover ``least`` of it."""

    def __init__(self, license_: str, text: str, least: float):
        self.license, self.words = license_, [w.lower() for w in WORD.findall(text)]
        self.places: dict[str, list[int]] = {}
        for k, w in enumerate(self.words):
            self.places.setdefault(w, []).append(k)
        self.enough = -int(-least * len(self.words) // 1)
        # a match may lack this many places, so keys that have more can't all be missing
        spare = len(self.words) - self.enough
        self.keys: set[str] = set()
        for w in sorted(self.places, key=lambda w: (-len(w), w)):
            self.keys.add(w)
            spare -= len(self.places[w])
            if spare < 0:
                break

    def near(self, pairs: list[tuple[int, int]], key: str, at: int) -> list[tuple[int, int]]:
        """The pairs that stand about where the key's place in the notice puts them; words aligned far from there are chance."""
        slack = max(3, len(self.words) // 4)
        return max(([p for p in pairs if abs(p[1] - at - p[0] + place) <= slack] for place in self.places[key]), key=len)


def scan(text: str | None, templates: list[Template]) -> list[tuple]:
    """(license, start, end, coverage, aligned words) of each match of a whole text, in order."""
    if not text:
        return []
    places = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text)]
    words = [w for _, _, w in places]
    present = set(words)
    found = []
    for t in templates:
        if t.keys.isdisjoint(present) or sum(w in present for w in t.words) < t.enough:
            continue
        n, done = len(t.words), 0
        for k, w in enumerate(words):
            if w not in t.keys or k < done:
                continue
            a, z = max(done, k - n - n // 2), min(len(words), k + n + n // 2 + 1)
            if sum(x in t.places for x in words[a:z]) < t.enough:
                continue
            pairs = t.near(align(t.words, words[a:z]), w, k - a)
            if pairs and len(pairs) >= t.enough:
                first, last = a + pairs[0][1], a + pairs[-1][1]
                found.append((len(pairs), len(pairs) / n, -places[first][0], t.license, places[last][1]))
                done = last + 1
    out: list[tuple] = []
    for n, coverage, start, license_, end in sorted(found, reverse=True):
        if all(end <= s or -start >= e for _, s, e, _, _ in out):
            out.append((license_, -start, end, coverage, n))
    return sorted(out, key=lambda x: x[1])


def scan_licenses(docs: DataFrame, templates=TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, start, end, coverage, n_words): a row for each match."""
    ship(docs.sparkSession)
    texts = tuple(templates)

    def rows(batches):
        held = [Template(*t, least) for t in texts]
        for b in batches:
            out = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for m in scan(t.as_py(), held)]
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "license", "start", "end", "coverage", "n_words"])

    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return plain.mapInArrow(rows, "doc_id long, license string, start long, end long, coverage double, n_words long")
