"""License scans: winnowed fingerprints in an inverted index pick candidates, banded alignment confirms them.

Texts and templates are runs of letters, digits and non-ASCII characters, A-Z as a-z. Fingerprints are
hashes of runs of GRAM words. Of each window of a template's fingerprints the smallest goes into the index, and
the windows are as wide as the template allows: a match keeps `least` of its words, so with `edits_of`
words left out, changed or put in (a third of the template's) some run of `sure_run` words is whole, and
every such run holds a chosen fingerprint. A template of few words so keeps all of them, or single words.
All fingerprints of a text are looked up. A place is a candidate where one is found, and where as many
words of the template as a match needs (each as often as the template has it) stand within its length
and twice the band. A match with more edits than those, which is one with many words put in, is found if a
fingerprint survives them.
Around each diagonal of a candidate, those with most words first, the template is aligned inside a
band (+1 for a word that agrees, -1 for one left out, put in or changed), and reported if the words
that agree are `least` of the template's. Words of a match are then taken, and the rest is searched
again, so templates that follow each other closely are found each. Of matches of different templates on
the same words the one with most agreeing words is reported, then that with the best coverage.

Results for odd input: null and empty texts match nothing. Long texts are scanned in pieces that
overlap by twice the longest template and its band, so no match is lost at a seam; a match found in
two pieces is reported once. A text that holds a template several times gives several rows. Rows
that repeat are scanned each. Extra columns are not touched.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import PIECE, mix, words_of

BAND, LEAST = 8, 0.8
GRAM = 2
#: License statements to look for: fixed texts.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Apache-grant": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-text": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-text": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none
    return words_of(data, np.zeros(1, np.int64), _SEPARATOR)


def needed(words: int, least: float) -> int:
    """Words of a template that a match agrees with at least."""
    return max(1, int(np.ceil(least * words - 1e-9)))


def edits_of(words: int) -> int:
    """Words left out, changed or put in that never hide a match of a template."""
    return max(2, words // 3)


def sure_run(words: int, least: float) -> int:
    """The longest run of agreeing words that every match with edits_of(words) edits has."""
    return -(-needed(words, least) // (edits_of(words) + 1))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words."""
    out = words[: max(0, len(words) - size + 1)]
    for k in range(1, size):
        out = mix(out) + words[k : len(words) - size + 1 + k]
    return out


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash in each window, the last of equals; fewer than a window: of all."""
    if not len(hashes):
        return np.empty(0, np.int64)
    window = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


@dataclass
class Index:
    templates: dict[str, str]
    least: float = LEAST
    names: list[str] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        holders: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for name, text in self.templates.items():
            w = _tokens(np.frombuffer(text.encode(), np.uint8))[0]
            run = sure_run(len(w), self.least)
            size = min(GRAM, run)
            hashes = grams(w, size)
            for x in hashes[winnow(hashes, run - size + 1)].tolist():
                holders[size][x].add(len(self.names))
            self.names.append(name)
            self.words.append(w)
        #: For each size of gram the chosen fingerprints, sorted, and the templates that hold each.
        self.prints = {size: (np.array(sorted(h), np.uint64), [sorted(h[x]) for x in sorted(h)]) for size, h in sorted(holders.items())}
        self.keys = np.unique(np.concatenate([np.empty(0, np.uint64), *self.words]))
        self.lists = [w.tolist() for w in self.words]
        self.member = [np.isin(self.keys, w) for w in self.words]
        self.often = [Counter(w) for w in self.lists]
        self.places: list[dict[int, list[int]]] = []
        for w in self.lists:
            at: dict[int, list[int]] = defaultdict(list)
            for i, x in enumerate(w):
                at[x].append(i)
            self.places.append(dict(at))
        self.longest = max((len(t.encode()) for t in self.templates.values()), default=0)

    def picked(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """For each template with a fingerprint in the text where those start, in order."""
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for size, (keys, holders) in self.prints.items():
            hashes = grams(words, size)
            if not len(hashes):
                continue
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            where = np.flatnonzero(keys[at] == hashes)
            codes = at[where]
            for code in np.unique(codes).tolist():
                here = where[codes == code]
                for template in holders[code]:
                    found[template].append(here)
        return {template: np.unique(np.concatenate(found[template])) for template in sorted(found)}

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(template, words that agree, first and last word) of each match."""
        picked = self.picked(words)
        if not picked:
            return
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        where = np.flatnonzero(self.keys[at] == words)
        codes = at[where]
        for template, prints in picked.items():
            m = len(self.words[template])
            need = needed(m, self.least)
            hits = where[self.member[template][codes]]
            if len(hits) < need:
                continue
            near = hits[need - 1 :] - hits[: len(hits) - need + 1] < m + 2 * BAND
            starts = hits[: len(near)]
            held = np.searchsorted(prints, starts + m + 2 * BAND) > np.searchsorted(prints, starts)  # a fingerprint is in the window
            near = np.flatnonzero(near & held)
            if len(near):
                yield from ((template, *match) for match in self._found(template, words, hits, near.tolist(), need))

    def _found(self, template: int, words: np.ndarray, hits: np.ndarray, near: list[int], need: int) -> Iterator[tuple[int, int, int]]:
        """(words that agree, first, last) of each match in the windows that start at hits[near]."""
        often, places, m = self.often[template], self.places[template], len(self.words[template])
        taken = np.zeros(len(words), bool)
        at = hits.tolist()
        tried: set[tuple[int, int, int]] = set()
        for i in near:
            high = bisect_left(at, at[i] + m + 2 * BAND, i)
            while not taken[at[i]]:
                window = [(j, int(words[j])) for j in at[i:high] if not taken[j]]
                if sum(min(n, often[x]) for x, n in Counter(x for _, x in window).items()) < need:
                    break
                diagonals = Counter((j - p) for j, x in window for p in places[x])
                best = None
                for start, _ in sorted(diagonals.items(), key=lambda d: (-d[1], d[0])):
                    # The text that no match has taken, around a word of this diagonal.
                    middle = next(j for j, x in window if j - start in places[x])
                    low, end = max(0, start - BAND), min(len(words), start + m + BAND)
                    full = np.flatnonzero(taken[low:end]) + low
                    cut = int(np.searchsorted(full, middle))
                    low, end = int(full[cut - 1]) + 1 if cut else low, int(full[cut]) if cut < len(full) else end
                    if (start, low, end) in tried:
                        continue
                    tried.add((start, low, end))
                    got = align(self.lists[template], words[low:end].tolist(), start - low)
                    if got is not None and got[1] >= need:
                        best = got[1], low + got[2], low + got[3]
                        break
                if best is None:
                    break
                taken[best[1] : best[2] + 1] = True
                yield best


def align(template: list[int], text: list[int], start: int) -> tuple[int, int, int, int] | None:
    """Best alignment of the template around text[start:] within the band, the first of equals: (score,
    words that agree, first and last text word that agree). Words outside the match cost nothing in the text, -1 in the template."""
    m, low = len(template), start - BAND
    width = 2 * BAND + 1
    none = (-(10**9), 0, 0, 0)
    # Cell (i, b): i template words read, text read up to low + i + b. Values: score, agreeing words, first, last.
    row = [(0, 0, -1, -1) for _ in range(width)]
    for i in range(1, m + 1):
        new = []
        for b in range(width):
            j = low + i + b - 1
            best = none
            s, k, f, e = row[b]
            if 0 <= j < len(text):
                best = (s + 1, k + 1, j if f < 0 else f, j) if template[i - 1] == text[j] else (s - 1, k, f, e)
            if b + 1 < width:
                s, k, f, e = row[b + 1]
                best = max(best, (s - 1, k, f, e))
            if b:
                s, k, f, e = new[b - 1]
                best = max(best, (s - (f >= 0), k, f, e))
            new.append(best)
        row = new
    best = max(row, key=lambda x: (x[0], x[1], -x[3], x[2]))
    return best if best[1] else None


def scan(text: bytes, index: Index) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, words that agree, first and end byte) of each match, in order of place."""
    data = np.frombuffer(text, np.uint8)
    step = PIECE - 4 * (index.longest + 64 * BAND)
    if step <= 0:
        raise ValueError(f"a template is longer than {PIECE // 4} bytes")
    found: dict[tuple[int, int, int], tuple[float, int]] = {}
    for low in range(0, max(len(data), 1), step):
        piece = data[low : low + PIECE]
        words, first, last = _tokens(piece)
        for template, agree, a, b in index.matches(words):
            key = (template, low + int(first[a]), low + int(last[b]) + 1)
            found[key] = max(found.get(key, (0.0, 0)), (agree / len(index.words[template]), agree))
        if low + PIECE >= len(data):
            break
    out: list[tuple[str, float, int, int, int]] = []
    taken: list[tuple[int, int, int]] = []  # apart, but for a word or two at their ends
    for (template, a, b), (coverage, agree) in sorted(found.items(), key=lambda x: (-x[1][1], -x[1][0], x[0])):
        at = bisect_left(taken, (a, 0, 0))
        near = [t for t in taken[max(0, at - 8) : bisect_left(taken, (b, 0, 0), at)] if min(b, t[1]) > max(a, t[0])]
        if all(t[2] != template and 2 * (min(b, t[1]) - max(a, t[0])) <= min(b - a, t[1] - t[0]) for t in near):
            insort(taken, (a, b, template))
            out.append((index.names[template], coverage, agree, a, b))
    return sorted(out, key=lambda x: (x[3], x[0]))


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each match: id, license, coverage, matched_words, span_start, span_end (UTF-8 bytes)."""
    index = Index(templates or TEMPLATES, least)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, *match) for i, text in enumerate(batch.column(1)) for match in scan(text.as_py(), index)]
            which, names, coverage, agree, a, b = zip(*out, strict=True) if out else [()] * 6
            ids = batch.column(0).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(coverage, pa.float64()), pa.array(agree, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["id", "license", "coverage", "matched_words", "span_start", "span_end"])

    return rows.mapInArrow(run, f"id {kind}, license string, coverage double, matched_words int, span_start long, span_end long").withColumnRenamed("id", id_col)
