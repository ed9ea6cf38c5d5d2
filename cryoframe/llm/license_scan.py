"""License texts in documents: MinHash over overlapping windows, then exact containment.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  A template of p shingles of
five words, n of them different, belongs to the smallest size class L >= ``SLACK`` * p, so that a copy with
words put in, half as many as it has, still fits in L.  Documents are cut into windows of 2L shingles that
start every L shingles; each stretch of L shingles lies whole in some window.  A window that holds 0.8 of a
template has Jaccard similarity s >= 0.8 n / (2L + 0.2 n), at least 0.175 as L < 1.25 ``SLACK`` p and n > 0.9 p.
Bands are single minhashes, ``BANDS`` in number: such a window misses all of them with probability
(1 - s) ** 48, at most 1e-4.  A window is retrieved for the templates with which it shares a band and is
verified by counting the template's shingles in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import documents
from .wordhash import PUNCTUATED, batches_of_text, shingle_hashes, text_bytes, word_hashes, word_spans

WIDTH, BANDS, SLACK = 5, 48, 1.5
_rng = np.random.default_rng(811)
_ADD = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_MULTIPLY = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Public license notices.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}


def shingles_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order and n+1 offsets; rows of fewer than ``WIDTH`` words have none."""
    raw, offsets = text_bytes(column)
    starts, ends, at = word_spans(raw, offsets, PUNCTUATED)
    hashes, shingle_at = shingle_hashes(word_hashes(raw, starts, ends), at, WIDTH)
    short = np.diff(at) < WIDTH
    keep = np.repeat(~short, np.diff(shingle_at))
    return hashes[keep], np.concatenate([[0], np.cumsum(np.where(short, 0, np.diff(shingle_at)))])


def class_of(positions: int) -> int:
    """The smallest size class for a template of so many shingles; classes grow by a quarter."""
    size = 1
    while size < SLACK * positions:
        size = max(size + 1, int(size * 1.25))
    return size


def size_class(template: str) -> int:
    return class_of(len(shingles_of(pa.array([template]))[0]))


class Templates:
    """Shingle sets of templates, and for each size class the minhashes that retrieve them."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.names = sorted(texts)
        hashes, at = shingles_of(pa.array([texts[n] for n in self.names], pa.string()))
        self.sets = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(self.names))]
        self.classes: dict[int, list[int]] = {}
        for i, own in enumerate(self.sets):
            if len(own):
                self.classes.setdefault(class_of(int(at[i + 1] - at[i])), []).append(i)
        self.every = np.unique(np.concatenate([s for s in self.sets if len(s)] or [np.zeros(0, np.uint64)]))
        self.marks = {
            size: [np.array([((self.sets[i] ^ _ADD[k]) * _MULTIPLY[k]).min() for i in own], np.uint64) for k in range(BANDS)]
            for size, own in self.classes.items()
        }

    def find(self, hashes: np.ndarray, at: np.ndarray, least: float) -> dict[tuple[int, int], tuple[float, int]]:
        """(row, template) -> (largest containment, first shingle of that window within the row)."""
        best: dict[tuple[int, int], tuple[float, int]] = {}
        counts = np.diff(at)
        if not len(hashes):
            return best
        windows = {}
        for size in self.classes:
            blocks = -(-counts // size)
            row = np.repeat(np.arange(len(counts)), blocks)
            start = at[row] + (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * size
            windows[size] = row, start, np.concatenate([row[1:] == row[:-1], [False]])
        candidates: dict[int, set[tuple[int, int]]] = {size: set() for size in self.classes}
        for k in range(BANDS):
            mixed = (hashes ^ _ADD[k]) * _MULTIPLY[k]
            for size, own in self.classes.items():
                _, start, paired = windows[size]
                least_in = np.minimum.reduceat(mixed, start)
                window = least_in.copy()
                window[paired] = np.minimum(least_in[paired], least_in[1:][paired[:-1]])
                for j, mark in enumerate(self.marks[size][k]):
                    candidates[size].update((int(w), own[j]) for w in np.flatnonzero(window == mark))
        for size, found in candidates.items():
            row, start, _ = windows[size]
            for w, i in sorted(found):
                stretch = hashes[start[w] : min(start[w] + 2 * size, at[row[w] + 1])]
                share = np.isin(self.sets[i], stretch, assume_unique=False).sum() / len(self.sets[i])
                key = (int(row[w]), i)
                if share >= least and share > best.get(key, (0.0, 0))[0]:
                    best[key] = (float(share), int(start[w] - at[row[w]]))
        return best


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """One row per document and template found: ``doc_id, license, containment, window_start``.

    ``containment`` is the largest share, at least ``least``, of the template's distinct shingles in one
    window, and ``window_start`` the number of the word at which the first such window starts.  Null and empty
    texts and texts of fewer than five words hold nothing, nor do templates of fewer words match
    anything.  Very long texts are searched whole.  Rows that repeat a doc_id, or have none, each give
    their own rows.  An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in batches:
            for a, b in batches_of_text(batch.column(1)):
                part = batch.slice(a, b - a)
                found = sorted(known.find(*shingles_of(part.column(1)), least).items())
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array([r for (r, _), _ in found], pa.int64())),
                        pa.array([known.names[i] for (_, i), _ in found], pa.string()),
                        pa.array([c for _, (c, _) in found], pa.float64()),
                        pa.array([s for _, (_, s) in found], pa.int64()),
                    ],
                    names=["doc_id", "license", "containment", "window_start"],
                )

    return documents(docs).mapInArrow(run, "doc_id long, license string, containment double, window_start long")
