"""Operator 10 - license scans by patience alignment.

A text and a license template are aligned by words: words unique to both are
anchors, the longest increasing run of them stays, and the gaps between are
aligned again in the same way. Coverage is the share of the template's words that
are aligned. A text is aligned wherever a run of a template's key words, words of which
any notice must hold most, could be a notice, however far the words between stretch it
(up to a template's length at one place); what is left on either side is tried again.
A template's telling words (its name, version or clause) must be among those aligned.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.llm.common import columns_of

COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
MATCHES = "doc_id long, license string, coverage double, start_char long, end_char long"

# Public license notices, as their publishers word them.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT line": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-3 terms": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All rights reserved": "All rights reserved.",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "MIT disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD line": "Released under the BSD License.",
    "BSD-3 endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0 line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-ND-4.0 line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0 line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0 line": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-SA-4.0 sentence": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 sentence": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Boost-1.0 line": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0 line": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
}
# Words of a template that tell it from its kin, longest templates that have none aside.
TELLING = {
    "Apache-2.0 line": "apache 2.0", "Apache-2.0 header": "apache", "MIT line": "mit", "BSD line": "bsd", "GPL-2.0 notice": "2 general", "GPL-3.0 line": "general 3",
    "GPL-3.0 notice": "3 general", "LGPL-2.1 notice": "lesser 2.1", "LGPL-3.0 notice": "lesser 3", "AGPL-3.0 notice": "affero 3", "MPL-2.0 notice": "mozilla",
    "CC-BY-4.0 line": "cc by 4.0", "CC-BY-SA-4.0 line": "cc by-sa 4.0", "CC-BY-NC-4.0 line": "cc by-nc 4.0", "CC-BY-ND-4.0 line": "cc by-nd 4.0", "CC-BY-NC-SA-4.0 line": "cc by-nc-sa 4.0",
    "CC-BY-NC-ND-4.0 line": "cc by-nc-nd 4.0", "CC-BY-4.0 sentence": "attribution 4.0", "CC-BY-SA-4.0 sentence": "attribution-sharealike 4.0", "CC-BY-NC-4.0 sentence": "attribution-noncommercial 4.0",
    "Boost-1.0 line": "boost", "EPL-2.0 line": "eclipse 2.0", "All rights reserved": "all rights reserved",
}


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Lower-cased words (inner dots and hyphens kept) with their places."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs (ascending in the first) that ascends in the second: patience piles."""
    tops: list[int] = []
    held: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect.bisect_left(tops, b)
        back[i] = held[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            held.append(i)
        else:
            tops[k], held[k] = b, i
    out, i = [], held[-1] if held else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of template a and text b."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if nb[b[j]] == 1 and na.get(b[j]) == 1}
        anchors = _rising([(i, place[a[i]]) for i in range(a0, a1) if a[i] in place])
        if not anchors:
            if len(na.keys() & nb.keys()):
                out += _common(a, b, a0, a1, b0, b1)
            continue
        before = (a0 - 1, b0 - 1)
        for at in [*anchors, (a1, b1)]:
            todo.append((before[0] + 1, at[0], before[1] + 1, at[1]))
            before = at
        out += anchors
    return sorted(out)


def _common(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """A longest common subsequence of a gap without anchors (at most a window of text)."""
    n, m = a1 - a0, b1 - b0
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[a0 + i] == b[b0 + j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[a0 + i] == b[b0 + j]:
            out.append((a0 + i, b0 + j))
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def keys_of(template: list[str], coverage: float) -> tuple[set[str], int]:
    """The template's longest words, more of its places than a covering text may lack, and how many of the places it must hold."""
    n, out, held = Counter(template), set(), 0
    lack = len(template) - math.ceil(coverage * len(template) - 1e-9)
    for w in sorted(n, key=lambda w: (-len(w), w)):
        if held > 2 * lack:
            break
        out.add(w)
        held += n[w]
    return out, held - lack


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE, telling: dict[str, str] | None = None):
        self.coverage = coverage
        self.templates = {k: [w for w, _, _ in words_of(t)] for k, t in (templates or TEMPLATES).items()}
        self.keys = {k: keys_of(t, coverage) for k, t in self.templates.items()}
        self.telling = {k: set((telling or TELLING).get(k, "").split()) for k in self.templates}
        self.gate = set().union(*(k for k, _ in self.keys.values()))

    def _runs(self, name: str, plain: list[str], at: list[int]):
        """(first, end) of word places around runs of the key words at ``at`` that may hold the template.

        A run ends where more than two template lengths of words have no key word, and
        where enough of the template has been seen and one of its words comes again
        more often than the template has it: there another copy begins.
        """
        n, (_, need), most = len(self.templates[name]), self.keys[name], Counter(self.templates[name])
        run: list[int] = []
        seen: Counter = Counter()
        for i in [*at, None]:
            ends = i is None or run and (i - run[-1] > 2 * n or sum(seen.values()) >= need and seen[plain[i]] == most[plain[i]])
            if ends:
                if sum((seen & most).values()) >= need:
                    yield max(0, run[0] - 2 * n), min(len(plain), run[-1] + 2 * n + 1)
                run, seen = [], Counter()
            if i is not None:
                run.append(i)
                seen[plain[i]] += 1

    def _found(self, name: str, plain: list[str]):
        """(coverage, first, last) of the notices of one template, left to right."""
        t, (keys, _) = self.templates[name], self.keys[name]
        n, have = len(t), Counter(t)
        at = [i for i, w in enumerate(plain) if w in keys]
        todo = list(self._runs(name, plain, at))
        done = set()
        while todo:
            a, b = todo.pop()
            window = plain[a:b]
            if (a, b) in done or sum((Counter(window) & have).values()) < self.coverage * n:
                continue
            done.add((a, b))
            where = align(t, window)
            if len(where) < self.coverage * n or not self.telling[name] <= {t[i] for i, _ in where}:
                continue
            first, last = a + where[0][1], a + where[-1][1]
            yield len(where) / n, first, last
            todo += [(a, first), (last + 1, b)]

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end) of the notices found, none overlapping a better one."""
        found = words_of(text)
        plain = [w for w, _, _ in found]
        have = set(plain)
        hits = []
        for name, t in self.templates.items():
            if self.telling[name] <= have and sum(w in have for w in t) >= self.coverage * len(t):
                hits += [(got, len(t), name, found[i][1], found[j][2]) for got, i, j in self._found(name, plain)]
        out: list = []
        for got, n, name, a, b in sorted(hits, key=lambda h: (-h[0], -h[1], h[3], h[4] - h[3], h[2])):
            if all(b <= x[2] or a >= x[3] for x in out):
                out.append((name, got, a, b))
        return sorted(out, key=lambda x: x[2])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """MATCHES: one row per notice found in a whole text.

    Of overlapping notices the better covered stays, then the longer template. Null
    and empty texts have none; repeated rows give repeated matches; null ids pass
    through; extra columns are ignored; an empty table gives no rows. Texts without any key word of any template
    are set aside by a JVM-side filter that no match can fail.
    """
    held = docs.sparkSession.sparkContext.broadcast(Scanner(templates, coverage))
    gate = "(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in sorted(held.value.gate)) + ")"

    def run(batches):
        s = held.value
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for m in s.scan(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], [x.split()[0] for x in MATCHES.split(", ")])

    return columns_of(docs, "doc_id", "text").where(F.lower("text").rlike(gate)).mapInArrow(run, MATCHES)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All license notices of all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_licenses": op10_licenses}
ORACLE: dict[str, str] = {}
