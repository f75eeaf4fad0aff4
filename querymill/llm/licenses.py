"""License scan by patience alignment of texts with templates.

Words that occur once in the text and once in the template anchor the alignment; the longest
increasing run of anchors is kept, and the gaps between them are aligned the same way, down to gaps
without such words, where equal words at both edges still count. Coverage is the share of template
words aligned. Templates are aligned only with the stretch of a text around their own words: a text
that holds too few of them, repeats counted, cannot reach the coverage and is passed over.

Licenses of one family differ in a word or a version. Such words are marks: an occurrence must align
every different mark of its template, and neither inside it nor in the version at its end may the
text have a mark that the template lacks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.words import NOT_ALNUM, Words, slices

#: Share of a template's words that a text must hold, in order.
MIN_COVERAGE = 0.8

#: Words that tell licenses apart, and words that a version number follows.
MARKS = (
    "affero", "apache", "boost", "bsd", "cc0", "eclipse", "endorse", "gnu", "isc", "later", "lesser", "library", "mit",
    "mozilla", "mpl", "nc", "nd", "noncommercial", "noderivatives", "noderivs", "sa", "sharealike", "unlicense", "v1", "v2",
    "v3", "v4", "zlib",
)
VERSION_LEADS = (
    "agpl", "apache", "bsd", "by", "cc0", "epl", "gpl", "lgpl", "license", "mpl", "nc", "nd", "noderivatives", "noderivs",
    "noncommercial", "sa", "sharealike", "attribution", "universal", "v", "version",
)
DIGITS = "0123456789"

#: The Creative Commons family.
CC_PARTS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
GNU = {"GPL": ("", ("2.0", "3.0")), "LGPL": ("Lesser ", ("2.1", "3.0")), "AGPL": ("Affero ", ("3.0",))}


def _families() -> dict[str, str]:
    """Lines of the licenses that come in parts and versions."""
    out = {}
    for part, name in CC_PARTS.items():
        for v in CC_VERSIONS:
            out[f"CC-{part}-{v}-line"] = f"Licensed under CC {part} {v}."
            out[f"CC-{part}-{v}-name"] = f"Creative Commons {name} {v} License"
    for short, (kind, versions) in GNU.items():
        for v in versions:
            number = v.removesuffix(".0")
            out[f"{short}-{v}-line"] = f"This work is licensed under the GNU {kind}General Public License, version {number}."
            out[f"{short}-{v}-or-later-line"] = f"This work is licensed under the GNU {kind}General Public License, version {number} or later."
            out[f"{short}-{v}-name"] = f"GNU {kind}General Public License v{v}"
            out[f"{short}-{v}-or-later-header"] = (
                f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General "
                f"Public License as published by the Free Software Foundation, either version {number} of the License, or (at your "
                "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
                "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
                f"{kind}General Public License for more details."
            )
    return out


#: Notices and license texts, by SPDX-like name.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "BSD-3-Clause-line": "Licensed under the BSD 3-Clause License.",
    "BSD-2-Clause-line": "Licensed under the BSD 2-Clause License.",
    "ISC-line": "Released under the ISC License.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "CC0-1.0-line": "Licensed under CC0 1.0 Universal.",
    "EPL-1.0-line": "Licensed under the Eclipse Public License, version 1.0.",
    "EPL-2.0-line": "Licensed under the Eclipse Public License, version 2.0.",
    "BSL-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
    "MPL-1.1-line": "Licensed under the Mozilla Public License, version 1.1.",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, version 2.0.",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "All-rights-reserved": "All rights reserved.",
} | _families()


def read_templates(folder: str) -> dict[str, str]:
    """Templates from the ``*.txt`` files of a folder of the driver, by file name; for whole license texts."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(folder).glob("*.txt"))}


def words_of(text: str) -> list[str]:
    """Lower-cased words of letters and digits."""
    words = Words(pa.array([text]), NOT_ALNUM)
    return [words.text(i).decode() for i in range(len(words.starts))]


def increasing(values: list[int]) -> list[int]:
    """Indices of the longest increasing run of distinct values, by patience piles."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before[i] = top_at[pile - 1] if pile else -1
        tops[pile : pile + 1], top_at[pile : pile + 1] = [v], [i]
    out, at = [], top_at[-1] if top_at else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs (position in text, position in template) of equal words, both ascending."""
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
        once = Counter(template[c:d])
        known = [(i, text[i]) for i in range(a, b) if once.get(text[i]) == 1]
        seen = Counter(w for _, w in known)
        place = {w: i for i, w in enumerate(template[c:d], c)}
        anchors = [(i, place[w]) for i, w in known if seen[w] == 1]
        if not anchors:
            continue
        kept = [anchors[k] for k in increasing([p for _, p in anchors])]
        edges = [(a - 1, c - 1), *kept, (b, d)]
        out += kept
        todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    """Templates as word numbers, and the search for texts that may hold them."""

    def __init__(self, templates: dict[str, str], min_coverage: float):
        self.names = list(templates)
        self.words = [words_of(t) for t in templates.values()]
        self.min_coverage = min_coverage
        vocabulary = sorted({w for ws in self.words for w in ws} | {*MARKS, *VERSION_LEADS, *DIGITS})
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.templates = [[self.number[w] for w in ws] for ws in self.words]
        hashes = Words(pa.array(vocabulary or [""]), NOT_ALNUM).hashes()
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.counts = np.zeros((len(self.names), len(vocabulary)), np.int64)
        for i, t in enumerate(self.templates):
            np.add.at(self.counts[i], t, 1)
        self.need = np.array([int(np.ceil(min_coverage * len(t))) for t in self.templates])
        is_in = lambda chosen: np.isin(vocabulary, list(chosen))
        self.mark, self.lead, self.digit, self.zero = is_in(MARKS), is_in(VERSION_LEADS), is_in(DIGITS), is_in("0")
        self.marks = np.zeros(self.counts.shape, bool)
        for i, text in enumerate(templates.values()):
            ids = np.array(self.templates[i], np.int64)
            self.marks[i, ids[self._marked(ids, np.arange(len(ids)), Words(pa.array([text]), NOT_ALNUM))]] = True

    def _marked(self, ids: np.ndarray, places: np.ndarray, words: Words) -> np.ndarray:
        """Which known words of a batch are marks: names, and the digits of versions but 0.

        The first digit stands next to a word that leads to versions, the second is one character on.
        """
        after = np.zeros(len(ids), bool)
        after[1:] = np.diff(places) == 1
        after &= ~np.isin(places, words.first)
        before = np.roll(ids, 1)
        first = after & self.digit[ids] & self.lead[before]
        second = after & self.digit[ids] & np.roll(first, 1) & (words.starts[places] - words.ends[places - 1] == 1)
        return self.mark[ids] | ((first | second) & ~self.zero[ids])

    def find(self, words: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, template, aligned words, first word, one past the last) of every template found."""
        h = words.hashes()
        if not len(h) or not len(self.names):
            return
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        places = np.flatnonzero(self.hashes[at] == h)
        ids = self.ids[at[places]]
        edges = np.searchsorted(places, words.first)
        marked = self._marked(ids, places, words)
        for doc in np.flatnonzero(np.diff(edges) >= self.need.min()):
            own, own_places = ids[edges[doc] : edges[doc + 1]], places[edges[doc] : edges[doc + 1]]
            held = np.bincount(own, minlength=self.counts.shape[1])
            able = (np.minimum(self.counts, held).sum(1) >= self.need) & ~(self.marks & (held == 0)).any(1)
            for t in np.flatnonzero(able):
                yield from self._occurrences(int(doc), int(t), own, own_places - words.first[doc], marked[edges[doc] : edges[doc + 1]])

    def rows(self, found: list[list[int]]) -> list[dict]:
        """Occurrences as rows; of overlapping ones that with the most words aligned stays."""
        kept: list[list[int]] = []
        for t, n, start, stop in sorted(found, key=lambda x: (-x[1], -x[1] / len(self.templates[x[0]]), x[3] - x[2], x[0])):
            if all(stop <= k[2] or start >= k[3] for k in kept):
                kept.append([t, n, start, stop])
        return [
            {"license": self.names[t], "coverage": n / len(self.templates[t]), "start": a, "stop": b}
            for t, n, a, b in sorted(kept, key=lambda x: x[2])
        ]

    def _occurrences(
        self, doc: int, t: int, ids: np.ndarray, places: np.ndarray, marked: np.ndarray
    ) -> Iterator[tuple[int, int, int, int, int]]:
        """Stretches of up to twice the template's length that reach its coverage, left to right."""
        size, need = len(self.templates[t]), self.need[t]
        foreign = places[marked & ~self.marks[t][ids]]
        inside = np.flatnonzero(self.counts[t][ids] > 0)
        ids, places, at = ids[inside], places[inside], 0
        while at < len(ids):
            pairs = self._aligned(t, ids, places, foreign, at, int(np.searchsorted(places, places[at] + 2 * size)))
            if len(pairs) >= need:
                first, last = at + pairs[0][0], at + pairs[-1][0]
                yield doc, t, len(pairs), int(places[first]), int(places[last]) + 1
                at = last + 1
            else:
                at += 1

    def _aligned(self, t: int, ids: np.ndarray, places: np.ndarray, foreign: np.ndarray, at: int, stop: int) -> list[tuple[int, int]]:
        """The alignment of a stretch if it reaches the coverage and its marks agree, else nothing.

        Where a foreign mark is between aligned words, the stretch is tried again up to that mark.
        """
        template, need = self.templates[t], self.need[t]
        while stop - at >= need:
            held = np.bincount(ids[at:stop], minlength=self.counts.shape[1])
            if np.minimum(self.counts[t], held).sum() < need or (self.marks[t] & (held == 0)).any():
                return []
            pairs = align(ids[at:stop].tolist(), template)
            if len(pairs) < need:
                return []
            first, last = int(places[at + pairs[0][0]]), int(places[at + pairs[-1][0]])
            begin, end = np.searchsorted(foreign, [first, last])
            if begin < end:
                stop = int(np.searchsorted(places, foreign[end - 1]))
                continue
            aligned = np.zeros(len(self.mark), bool)
            aligned[[template[c] for _, c in pairs]] = True
            if (self.marks[t] & ~aligned).any():
                return []
            longer_version = end < len(foreign) and foreign[end] == last + 1 and self.digit[template[pairs[-1][1]]]
            return [] if longer_version else pairs
        return []


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    *,
    min_coverage: float = MIN_COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Templates in each document: the id and an array of found (license, coverage, start, stop).

    Positions are words of letters and digits, the end is exclusive. Of overlapping occurrences the
    one with the most aligned words stays; ties go to the larger coverage, the shorter stretch, the
    template given first. Every document has a row, one without text or words has an empty array.
    Repeated rows are scanned each, other columns are ignored. Templates without words are never found.
    """
    given = {k: v for k, v in (TEMPLATES if templates is None else templates).items() if words_of(v)}
    scanner = Scanner(given, min_coverage)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            for part in slices(batch, 1):
                found = defaultdict(list)
                for doc, *occurrence in scanner.find(Words(part.column(1), NOT_ALNUM)):
                    found[doc].append(occurrence)
                rows = [scanner.rows(found[i]) if i in found else [] for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=[id_col, "found"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, found array<struct<license:string,coverage:double,start:int,stop:int>>"
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(work, schema)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of finds, the distinct licenses, and the largest coverage."""
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"])))
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["coverage"])), F.lit(0.0))
    return scanned.select(
        id_col, F.size("found").cast("long").alias("n_found"), F.array_join(names, ",").alias("licenses"), F.round(best, 6).alias("best_coverage")
    )
