"""License scans: winnowed fingerprints pick candidates, banded alignment reports what matches."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domloom.llm.text import TOKEN

# Short notices, and the notices of common public licenses.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Words per fingerprint, and fingerprints per window: any run of ``GRAM + WINDOW - 1`` words
#: that a text shares with a template has a fingerprint in the index.
GRAM, WINDOW = 3, 3

#: Words that an alignment may drift from where its fingerprints stand.
BAND = 16

#: Share of a template's words that must be found in order.
MIN_COVERAGE = 0.8

MATCH, MISS, GAP = 2, -1, -1

#: Stands for the words of a match in further alignments; no word has this number.
TAKEN = -1
BASE = np.uint64(0x9E3779B97F4A7C15)

RESULT = (
    "doc_id bigint, license string, coverage double, matched_words bigint, template_words bigint, "
    "start bigint, end bigint, spans array<struct<start:bigint,end:bigint>>"
)
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int64()),
    ("template_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("spans", pa.list_(_SPAN)),
])


def license_scan(
    docs: DataFrame, templates: Mapping[str, str] | None = None, min_coverage: float = MIN_COVERAGE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per place where a document holds a template: matched coverage, the characters from
    first to last matched word, and the spans of matched runs.

    Templates, a parameter of fixed size, are winnowed into an inverted index of fingerprints.
    Every run of ``GRAM`` words of the whole text is looked up; hits of a template that lie close
    together on neighbouring diagonals are one candidate, which a local alignment within a band
    of those diagonals then settles. The words of a match are taken and the rest of the candidate is
    aligned again, until too little matches, so notices that follow each other closely give a row
    each. Overlapping places of one template are reported once, the best first. Documents are
    neither shuffled nor copied.

    Null and empty texts match nothing. Rows that repeat are reported each. Other columns are
    ignored. An empty table, and a template without words, give no rows.
    """
    given = list((TEMPLATES if templates is None else templates).items())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(given)
        for batch in batches:
            found = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for match in index.matches(text or "", min_coverage):
                    found.append({"doc_id": doc_id, **match})
            yield pa.RecordBatch.from_pylist(found, _ARROW)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, RESULT)


@dataclass(frozen=True)
class _Template:
    name: str
    words: np.ndarray


class TemplateIndex:
    def __init__(self, templates: Sequence[tuple[str, str]]):
        self.numbers: dict[str, int] = {}
        self.templates = []
        entries: list[tuple[int, int, int]] = []
        for name, text in templates:
            words = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in map(str.lower, TOKEN.findall(text))], dtype=np.int64)
            if not len(words):
                continue
            for place, value in winnow(gram_hashes(words, min(GRAM, len(words)))):
                entries.append((value, len(self.templates), place))
            self.templates.append(_Template(name, words))
        entries.sort()
        self.hashes = np.array([e[0] for e in entries], dtype=np.uint64)
        self.owners = np.array([e[1] for e in entries], dtype=np.int64)
        self.places = np.array([e[2] for e in entries], dtype=np.int64)
        self.grams = sorted({min(GRAM, len(t.words)) for t in self.templates})

    def matches(self, text: str, min_coverage: float) -> Iterator[dict]:
        # Lower-casing can change the length of a text and split words, so it comes after the cut.
        tokens = TOKEN.findall(text.lower()) if text.isascii() else [t.lower() for t in TOKEN.findall(text)]
        number = self.numbers.get
        words = np.fromiter((number(t, 0) for t in tokens), dtype=np.int64, count=len(tokens))
        offsets: list[tuple[int, int]] | None = None
        before, left = -1, words
        for owner, low, high, first, last in self._candidates(words):
            template = self.templates[owner]
            begin = max(0, low - BAND)
            end = high + len(template.words) + BAND
            if owner != before:
                before, left = owner, words
            while pairs := align(template.words, left[begin:end], first - begin - BAND, last - begin + BAND):
                if len(pairs) < min_coverage * len(template.words):
                    break
                at = [begin + j for _, j in pairs]
                # Bands of neighbouring candidates overlap, so taken words hold for all of them.
                left = words.copy() if left is words else left
                left[at[0] : at[-1] + 1] = TAKEN
                offsets = offsets or [m.span() for m in TOKEN.finditer(text)]
                runs = np.split(np.array(at), np.flatnonzero(np.diff(at) != 1) + 1)
                yield {
                    "license": template.name, "coverage": len(pairs) / len(template.words), "matched_words": len(pairs),
                    "template_words": len(template.words), "start": offsets[at[0]][0], "end": offsets[at[-1]][1],
                    "spans": [{"start": offsets[r[0]][0], "end": offsets[r[-1]][1]} for r in runs],
                }

    def _candidates(self, words: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Template, first and last word of the place, and its lowest and highest diagonal."""
        for gram in self.grams:
            if len(words) < gram:
                continue
            known = np.concatenate([[0], np.cumsum(words > 0)])
            at = np.flatnonzero(known[gram:] - known[:-gram] == gram)
            wanted = np.zeros(len(at), dtype=np.uint64)
            for j in range(gram):
                wanted = wanted * BASE + words[at + j].astype(np.uint64)
            low = np.searchsorted(self.hashes, wanted, "left")
            count = np.searchsorted(self.hashes, wanted, "right") - low
            hits: dict[int, list[tuple[int, int]]] = {}
            for d, lo, n in zip(at[count > 0], low[count > 0], count[count > 0]):
                for row in range(lo, lo + n):
                    owner = int(self.owners[row])
                    if min(GRAM, len(self.templates[owner].words)) == gram:
                        hits.setdefault(owner, []).append((int(d) - int(self.places[row]), int(d)))
            for owner, places in sorted(hits.items()):
                yield from self._places(owner, sorted(places))

    def _places(self, owner: int, hits: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        """Hits on neighbouring diagonals, no template length apart, make one place."""
        length = len(self.templates[owner].words)
        open_places: list[list[int]] = []  # first diagonal, last diagonal
        for diagonal, _ in hits:
            if open_places and diagonal - open_places[-1][1] <= BAND and diagonal - open_places[-1][0] <= max(BAND, length // 2):
                open_places[-1][1] = diagonal
            else:
                open_places.append([diagonal, diagonal])
        for first, last in open_places:
            yield owner, max(0, first), last, first, last


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    count = max(0, len(words) - gram + 1)
    hashes = np.zeros(count, dtype=np.uint64)
    for j in range(gram):
        hashes = hashes * BASE + words[j : j + count].astype(np.uint64)
    return hashes


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """``(place, hash)`` of the least hash of each window, the rightmost of equals."""
    mixed = hashes * np.uint64(0xD6E8FEB86659FD93)
    chosen = set()
    for begin in range(max(1, len(hashes) - window + 1)):
        part = mixed[begin : begin + window]
        chosen.add(begin + len(part) - 1 - int(np.argmin(part[::-1])))
    return [(p, int(hashes[p])) for p in sorted(chosen)]


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Matched pairs ``(template place, word place)`` of the best local alignment whose diagonals,
    word place less template place, lie between ``low`` and ``high``."""
    width = high - low + 1
    steps = np.arange(width)
    above = np.zeros(width, dtype=np.int64)
    choices = np.zeros((len(template), width), dtype=np.int8)
    best, end = 0, None
    for i, word in enumerate(template):
        at = i + low + steps
        inside = (at >= 0) & (at < len(words))
        same = inside & (words[np.clip(at, 0, max(0, len(words) - 1))] == word) if len(words) else inside
        diagonal = np.where(inside, above + np.where(same, MATCH, MISS), 0)
        skipped = np.concatenate([above[1:], [0]]) + GAP
        score = np.maximum(np.maximum(diagonal, skipped), 0)
        # Gaps in the template: the best score to the left, less the way from there.
        reached = np.maximum.accumulate(score - GAP * steps) + GAP * steps
        row = np.where(inside, np.maximum(score, reached), 0)
        choices[i] = np.select([row == 0, inside & (row == diagonal), row == skipped], [0, np.where(same, 1, 2), 3], 4)
        if len(row) and row.max() > best:
            best, end = int(row.max()), (i, int(row.argmax()))
        above = row
    pairs = []
    while end is not None:
        i, k = end
        choice = choices[i, k] if i >= 0 and 0 <= k < width else 0
        if choice == 0:
            break
        if choice == 1:
            pairs.append((i, i + low + k))
        end = (i - 1, k) if choice in (1, 2) else (i - 1, k + 1) if choice == 3 else (i, k - 1)
    return pairs[::-1]
