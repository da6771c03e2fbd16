"""License scans by patience alignment.

Text and template are aligned as word sequences: words that occur once in both are anchors, the
longest run of anchors that rises in both is kept, and the gaps between them are aligned in the same
way.  The share of the template's words that find a partner is its coverage.

Only windows around a template's rarest words are aligned.  They are chosen so that a text without
any of them can't reach the least coverage, so nothing is missed by that.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rows_of

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
LEAST_COVERAGE = 0.8
SCHEMA = "doc_id long, license string, template string, start long, end long, coverage double, matched long"

# Texts of public licenses.  (license, template, words that must match or, behind a !,
# may not stand in the span, text)
TEMPLATES = [
    ("MIT", "reference", "mit", "Released under the MIT License."),
    ("Apache-2.0", "reference", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "reference", "gnu general public 3", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "reference", "by-nc 4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "reference", "creative commons attribution 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "MIT",
        "text",
        "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "text",
        "",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "notice",
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "notice",
        "gnu 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "BSD-2-Clause",
        "text",
        "",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
]


BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
GNU_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
MIT_GRANT, MIT_END = (t.strip() for t in TEMPLATES[5][3].split("subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."))
ISC_GRANT, ISC_END = (t.strip() for t in TEMPLATES[6][3].split(", provided that the above copyright notice and this permission notice appear in all copies."))


def _gnu_notice(name: str, version: str, thing: str = "program") -> str:
    return f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. This {thing} {GNU_WARRANTY} {name} for more details."


def _full(name: str) -> str:
    return files(__package__).joinpath(f"licenses/{name}.txt").read_text(encoding="utf-8")


def _references() -> list[tuple[str, str, str, str]]:
    out = []
    for lic, name, must, version in (
        ("GPL-2.0", "General Public License", "gnu general public 2", "2"),
        ("LGPL-2.1", "Lesser General Public License", "gnu lesser 2.1", "2.1"),
        ("LGPL-3.0", "Lesser General Public License", "gnu lesser 3", "3"),
        ("AGPL-3.0", "Affero General Public License", "gnu affero 3", "3"),
    ):
        out.append((lic, "reference", must, f"This work is licensed under the GNU {name}, version {version}."))
    for kind, long in (("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"), ("BY", "Attribution")):
        for version, port in (("4.0", "International"), ("3.0", "Unported")):
            if (kind, version) not in (("BY-NC", "4.0"),):
                out.append((f"CC-{kind}-{version}", "reference", f"cc {kind.lower()} {version}", f"Licensed under CC {kind} {version}."))
            if (kind, version) != ("BY", "4.0"):
                out.append((f"CC-{kind}-{version}", "reference", f"creative commons {long.lower()} {version}", f"This work is licensed under a Creative Commons {long} {version} {port} License."))
    for lic, must, name in (("MPL-2.0", "mozilla 2.0", "Mozilla Public License, version 2.0"), ("BSD-3-Clause", "bsd 3-clause", "BSD 3-Clause License"), ("BSD-2-Clause", "bsd 2-clause", "BSD 2-Clause License"), ("CC0-1.0", "cc0 1.0", "CC0 1.0 Universal license")):
        out += [(lic, "reference", must, f"{verb} under the {name}.") for verb in ("Licensed", "Released")]
    out += [("MIT", "reference", "mit", "Licensed under the MIT License."), ("Apache-2.0", "reference", "apache 2.0", "Released under the Apache License, Version 2.0."), ("Unlicense", "reference", "unlicense", "Released under the Unlicense."), ("CC0-1.0", "reference", "cc0 1.0", "Dedicated to the public domain under CC0 1.0.")]
    gnu = ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.2", "GFDL-1.3")
    ids = {f"{g}{end}": g for g in gnu for end in ("", "-only", "-or-later")} | {x: x for x in ("MIT", "MIT-0", "ISC", "0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-1.1", "MPL-2.0", "CC0-1.0", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0", *(f"CC-BY{k}-{v}" for k in ("", "-SA", "-ND", "-NC", "-NC-SA", "-NC-ND") for v in ("3.0", "4.0")))}
    return out + [(lic, "identifier", f"spdx-license-identifier {x.lower()}", f"SPDX-License-Identifier: {x}") for x, lic in ids.items()]


TEMPLATES += [
    ("BSD-2-Clause", "text", "", f"{BSD_CONDITIONS} {BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "text", "neither endorse promote", f"{BSD_CONDITIONS} {BSD_NAMES} {BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "text", "neither endorse promote", f"{BSD_CONDITIONS} {BSD_NAMES}"),
    ("MIT-0", "text", "", f"{MIT_GRANT.removesuffix(',')}. {MIT_END}"),
    ("0BSD", "text", "", f"{ISC_GRANT}. {ISC_END}"),
    ("GPL-2.0", "notice", "gnu 2", _gnu_notice("General Public License", "2")),
    ("LGPL-2.1", "notice", "gnu lesser 2.1", _gnu_notice("Lesser General Public License", "2.1", "library")),
    ("LGPL-3.0", "notice", "gnu lesser 3", _gnu_notice("Lesser General Public License", "3", "library")),
    ("AGPL-3.0", "notice", "gnu affero 3", _gnu_notice("Affero General Public License", "3")),
    ("MPL-2.0", "notice", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    # the whole texts; one word of each tells it from the relatives whose texts aren't here
    *((name, "full", must, _full(name)) for name, must in (("Apache-2.0", ""), ("GPL-1.0", ""), ("GPL-2.0", ""), ("GPL-3.0", "!remotely"), ("LGPL-2.0", ""), ("LGPL-2.1", ""), ("LGPL-3.0", ""), ("MPL-1.1", ""), ("MPL-2.0", ""), ("CC0-1.0", ""), ("CC-BY-SA-4.0", "sharealike !noncommercial"), ("Artistic-1.0-Perl", ""), ("GFDL-1.2", ""), ("GFDL-1.3", ""), ("Unlicense", ""))),
    *_references(),
]


@dataclass(frozen=True)
class Template:
    license: str
    name: str
    words: tuple[str, ...]
    must: frozenset[str]
    never: frozenset[str]
    rare: frozenset[str]
    counts: tuple[tuple[str, int], ...]


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def compiled(templates: list[tuple[str, str, str, str]], least: float = LEAST_COVERAGE) -> list[Template]:
    """With each template's longest, so rarest, words: more of them than may stay without partner."""
    made = [(lic, name, must, tuple(w for w, *_ in words_of(text))) for lic, name, must, text in templates]
    common = Counter(w for *_, words in made for w in set(words))
    out = []
    for lic, name, must, words in made:
        counts, spare, rare = Counter(words), len(words) - least * len(words), []
        for w in sorted(counts, key=lambda w: (-len(w), common[w], counts[w], w)):
            if sum(counts[x] for x in rare) > spare + 1e-9:
                break
            rare.append(w)
        out.append(Template(lic, name, words, frozenset(w for w in must.split() if w[0] != "!"), frozenset(w[1:] for w in must.split() if w[0] == "!"), frozenset(rare), tuple(counts.items())))
    return out


def longest_rise(seq: list[int]) -> list[int]:
    """The places of a longest increasing subsequence."""
    tails, at, before = [], [], [-1] * len(seq)
    for i, v in enumerate(seq):
        k = bisect_left(tails, v)
        if k:
            before[i] = at[k - 1]
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Partners (place in a, place in b), rising in both."""
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
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        both = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        anchors = [both[k] for k in longest_rise([j for _, j in both])]
        if not anchors and not (in_a & in_b):
            continue
        if not anchors:  # only words that repeat: pair the first that both have, then go on behind it
            i = next(i for i in range(a0, a1) if in_b[a[i]])
            j = next(j for j in range(b0, b1) if b[j] == a[i])
            anchors = [(i, j)]
        out += anchors
        left = (a0 - 1, b0 - 1)
        for i, j in [*anchors, (a1, b1)]:
            todo.append((left[0] + 1, i, left[1] + 1, j))
            left = (i, j)
    return sorted(out)


def scan(text: str, templates: list[Template], least: float = LEAST_COVERAGE) -> list[tuple[str, str, int, int, float, int]]:
    """license, template, start, end, coverage and matched words of each license text, by place;
    where spans overlap, the one with more matched words, then coverage, stays."""
    words = words_of(text)
    held = {w for w, *_ in words}
    near = [t for t in templates if len(words) >= least * len(t.words) - 1e-9 and not t.rare.isdisjoint(held)]
    if not near:
        return []
    places: dict[str, list[int]] = {}
    for i, (w, *_) in enumerate(words):
        places.setdefault(w, []).append(i)
    found = []
    counts = Counter(w for w, *_ in words)
    for t in near:
        if sum(min(k, counts[w]) for w, k in t.counts) < least * len(t.words) - 1e-9:
            continue
        n, slack = len(t.words), 2 + len(t.words) // 4
        spots = sorted({h - o for o, w in enumerate(t.words) if w in t.rare for h in places.get(w, ())})
        windows: list[list[int]] = []
        for s in spots:
            a, b = max(0, s - slack), min(len(words), s + n + slack)
            if windows and a <= windows[-1][1] and b - windows[-1][0] <= 2 * n + 2 * slack:
                windows[-1][1] = max(windows[-1][1], b)
            else:
                windows.append([a, b])
        for a, b in windows:
            here = [w for w, *_ in words[a:b]]
            if sum((Counter(here) & Counter(t.words)).values()) < least * n:
                continue
            # in long templates rare words give places everywhere; of those within a step one, with a wider margin, serves for all
            step, tried = (slack // 4, []) if n > 300 else (0, [])
            for s in spots:
                if a - step <= s < b and b - a > n + 2 * slack and not (tried and s - tried[-1] <= step):
                    tried.append(s)
            wide = slack + step
            for shift, part in ((0, here), *(((s - wide) - a, here[max(0, s - wide - a) : s + n + wide - a]) for s in tried)):
                pairs = patience(part, list(t.words))
                if len(pairs) >= least * n - 1e-9 and t.must <= {t.words[j] for _, j in pairs}:
                    base = a + max(0, shift)
                    if t.never and not t.never.isdisjoint(part[pairs[0][0] : pairs[-1][0]]):
                        continue
                    found.append((t.license, t.name, words[base + pairs[0][0]][1], words[base + pairs[-1][0]][2], len(pairs) / n, len(pairs)))
    kept: list[tuple] = []
    for f in sorted(set(found), key=lambda f: (-f[5], -f[4], f[3] - f[2], f[2], f[0], f[1])):
        if not any(f[2] < k[3] and k[2] < f[3] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: (f[2], f[3]))


def find_licenses(docs: DataFrame, templates: list[tuple[str, str, str, str]] = TEMPLATES, *, least: float = LEAST_COVERAGE) -> DataFrame:
    """A row for each license text in ``docs(doc_id, text)``: doc_id, license, template, start, end
    (code points), coverage, matched (words).

    Null and empty texts have none, repeated rows are reported each, other columns are ignored.
    Nothing is shuffled: each task holds the templates, whose number is the caller's choice."""
    known = compiled(templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *f) for i, text in rows_of([batch], "doc_id", "text") if text for f in scan(text, known, least)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "license", "template", "start", "end", "coverage", "matched"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
