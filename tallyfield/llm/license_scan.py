"""License scans: winnowed fingerprints in an inverted index pick templates, banded alignment reports the match."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import NON_ALNUM, bytes_of, code_points, grams, sliced, strings, words

#: Notices as their licenses word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software "
        "to the public domain worldwide. This software is distributed without any warranty."
    ),
    "GPL-2.0 notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1 notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
        'COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
        "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND "
        "ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
        "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause name": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
        "by any means."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
GRAM, WINDOW = 3, 2
#: Templates of fewer words are looked up by all their 2-grams, as edits may leave no 3-gram that is picked on both sides.
SHORT, SHORT_GRAM = 12, 2
MIN_COVERAGE = 0.8
#: Words of the templates of one index; a larger set is scanned index by index.
INDEX_WORDS = 1_000_000


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of each window (the rightmost of equals); of fewer hashes the least of all."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(hashes[::-1].argmin())]) if n else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(windows)) + window - 1 - windows[:, ::-1].argmin(axis=1))


def align(template: np.ndarray, passage: np.ndarray, band: int, shift: int = 0) -> list[tuple[int, int]]:
    """Matched (template word, passage word) places of a longest common subsequence within a band.

    The band follows the diagonal that begins at the passage's word ``shift``, ``band`` words to either side, and only
    it is held: a row of 2 * band + 1 cells for each word of the template.
    """
    n, m = len(template), len(passage)
    if not n or not m:
        return []
    width = 2 * band + 1
    first = shift - band  # the cell k of row i is the passage's first i + first + k words
    rows = np.zeros((n + 1, width), np.uint16 if n < 1 << 16 else np.int32)
    padded = np.concatenate((passage[:0], np.zeros(max(0, -first), passage.dtype), passage, np.zeros(max(0, n + first + width - m) + 1, passage.dtype)))
    inside = np.zeros(len(padded), bool)
    inside[max(0, -first) : max(0, -first) + m] = True
    origin = first + max(0, -first)
    for i in range(1, n + 1):
        # Cell k ends in the passage's word i + first + k - 1.
        at = slice(i + origin - 1, i + origin - 1 + width)
        before = rows[i - 1]
        new = before + ((padded[at] == template[i - 1]) & inside[at])
        new[:-1] = np.maximum(new[:-1], before[1:])
        rows[i] = np.maximum.accumulate(new)
    out, i, k = [], n, min(width - 1, m - n - first) if m - n - first >= 0 else -1
    while i and k < 0:  # the passage ends before the band does
        i -= 1
        k = m - i - first
    while i and k >= 0 and i + first + k > 0:
        if k and rows[i, k] == rows[i, k - 1]:
            k -= 1
        elif k + 1 < width and rows[i, k] == rows[i - 1, k + 1]:
            i, k = i - 1, k + 1
        elif rows[i, k] == rows[i - 1, k]:  # at the band's edge
            i -= 1
        else:
            i -= 1
            out.append((i, i + first + k))
    return out[::-1]


class Index:
    """Inverted index from winnowed fingerprints to places in the templates."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = sorted(templates)
        self.words = [words(bytes_of(templates[x].lower()), NON_ALNUM)[2] for x in self.names]
        self.counts = [np.unique(x, return_counts=True) for x in self.words]
        self.at: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, x in enumerate(self.words):
            if len(x) < SHORT:
                for place, h in enumerate(grams(x, SHORT_GRAM).tolist()):
                    self.short.setdefault(h, []).append((k, place))
            else:
                hashes = grams(x, GRAM)
                for place in winnow(hashes).tolist():
                    self.at.setdefault(int(hashes[place]), []).append((k, place))
        self.hashes, self.short_hashes = (np.array(sorted(x), np.uint64) for x in (self.at, self.short))

    @staticmethod
    def _known(known: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Those of the places whose hash is known."""
        if not len(known) or not len(places):
            return places[:0]
        k = np.searchsorted(known, hashes[places])
        k[k == len(known)] = 0
        return places[known[k] == hashes[places]]

    def bound(self, template: int, passage: np.ndarray) -> int:
        """No alignment matches more words: those of the template that stand in the passage, each as often as in both."""
        own, n = self.counts[template]
        at = np.searchsorted(own, passage)
        at[at == len(own)] = 0
        return int(np.minimum(np.bincount(at[own[at] == passage], minlength=len(own)), n).sum())

    def scan(self, text: str, min_coverage: float) -> list[tuple[str, float, int, int, int, bool]]:
        """(template, coverage, words matched, start, end, best) of each match, by start; code points."""
        data = bytes_of(text)
        # ASCII letters are lower-cased in place, so byte offsets stay.
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        starts, ends, hashes = words(low, NON_ALNUM)
        begins: dict[int, set[int]] = {}
        for size, known, index in ((GRAM, self.hashes, self.at), (SHORT_GRAM, self.short_hashes, self.short)):
            prints = grams(hashes, size)
            for place in self._known(known, prints, winnow(prints) if size == GRAM else np.arange(len(prints))).tolist():
                for template, at in index[int(prints[place])]:
                    begins.setdefault(template, set()).add(place - at)
        if not begins:
            return []
        chars = None
        out = []
        for template, found in begins.items():
            own = self.words[template]
            band = max(2, len(own) // 5)
            done = -1
            for begin in sorted(found):
                a, b = max(0, begin - band), min(len(hashes), begin + len(own) + band)
                if begin < done:  # inside what the last match has taken
                    continue
                need = min_coverage * len(own) - 1e-9
                if self.bound(template, hashes[a:b]) < need:
                    continue
                matched = align(own, hashes[a:b], band, begin - a)
                if len(matched) >= need:
                    chars = code_points(data) if chars is None else chars
                    first, last = a + matched[0][1], a + matched[-1][1]
                    out.append((self.names[template], len(matched) / len(own), len(matched), int(chars[starts[first]]), int(chars[ends[last]])))
                    done = last + 1
        return _ranked(sorted(out, key=lambda x: (x[3], x[0])))


def _ranked(found: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int, bool]]:
    """Matches by start, each with whether no match that overlaps it has a higher coverage, or as high a one of more words."""
    best = [True] * len(found)
    open_at: list[int] = []
    for i, x in enumerate(found):
        open_at = [j for j in open_at if found[j][4] > x[3]]
        for j in open_at:
            a, b = found[j][1:3], x[1:3]
            best[i] &= b >= a
            best[j] &= a >= b
        open_at.append(i)
    return [(*x, b) for x, b in zip(found, best, strict=True)]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each place where a template is matched: ``doc_id, license, coverage, n_matched, start, end, best``.

    ``coverage`` is the share of the template's words found in order (at least ``min_coverage``), ``start`` and ``end``
    are code points of the whole text. Templates that both match at a place give a row each, by start and then name,
    as notices of like wording do; ``best`` marks those that no overlapping match beats in coverage, then in words.
    Null and empty texts give no row, very long ones are taken whole; repeated rows give theirs again, a null doc_id stays
    null, and an empty table gives none. Extra columns, whatever their names, play no part. Templates are indexed together
    up to INDEX_WORDS words, and a larger set is scanned index by index.
    """
    blocks: list[dict[str, str]] = [{}]
    size = 0
    for name in sorted(templates):
        n = len(templates[name].split())
        if blocks[-1] and size + n > INDEX_WORDS:
            blocks.append({})
            size = 0
        blocks[-1][name] = templates[name]
        size += n
    return reduce(DataFrame.unionByName, [_scan(docs, Index(x), min_coverage) for x in blocks])


def _scan(docs: DataFrame, index: Index, min_coverage: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sliced(batches):
            found = [(i, *m) for i, text in enumerate(strings(batch, "text")) for m in own.scan(text, min_coverage)]
            at, *rest = zip(*found, strict=True) if found else [()] * 7
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int32())), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))],
                ["doc_id", "license", "coverage", "n_matched", "start", "end", "best"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, coverage double, n_matched bigint, start bigint, end bigint, best boolean")
