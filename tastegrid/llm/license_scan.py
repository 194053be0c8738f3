"""License notices in texts: winnowed fingerprints of known notices form an inverted index that picks candidates, and a
banded alignment of each candidate gives its matched coverage and its span.

Words are runs of letters and digits in lower case. A notice's n-grams are hashed and winnowed (the smallest hash of every
window is kept), so any five words in common with a notice share at least one fingerprint with it. The notices are a fixed,
small list that goes to every task; a document stays in its task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

NGRAM, WINDOW = 3, 3
#: Words by which a copy may be shifted against the notice.
BAND = 8
#: Share of a notice that may be missing or changed, less one word: short notices must be whole.
SLACK = 0.25
#: Of a notice with at least so many words a part is reported too, from this share of it on.
LONG, PART = 24, 0.4

# Names and the wording of public license notices.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": (
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at"
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
}

_WORDS = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def _gram_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of word numbers."""
    out = np.zeros(max(0, len(words) - NGRAM + 1), dtype=np.uint64)
    for k in range(NGRAM):
        out = (out + words[k : k + len(out)].astype(np.uint64) + np.uint64(1)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def winnow(words: np.ndarray) -> list[tuple[int, int]]:
    """``hash, place`` of the smallest hash of every window of n-grams, the last of equal ones; of all, if they are fewer."""
    h = _gram_hashes(words)
    if len(h) <= WINDOW:
        return list({int(x): (int(x), i) for i, x in enumerate(h)}.values()) if len(h) < WINDOW else [(int(h.min()), int(len(h) - 1 - h[::-1].argmin()))]
    w = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    at = np.unique(np.arange(len(w)) + WINDOW - 1 - w[:, ::-1].argmin(axis=1))
    return [(int(h[i]), int(i)) for i in at]


class Index:
    """The notices as word numbers, and from each fingerprint to its places in them."""

    def __init__(self, notices: dict[str, str]):
        self.names = list(notices)
        self.numbers: dict[str, int] = {}
        self.words = [np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(t)], dtype=np.int64) for t in notices.values()]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, own in enumerate(self.words):
            for h, at in winnow(own):
                self.places[h].append((n, at))

    def candidates(self, words: np.ndarray) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """``notice, groups``: the fingerprints on about one diagonal are a group ``(start, first place, last place)``, where start
        is where the notice would begin and the places are those in the notice."""
        known = np.flatnonzero(words)
        if len(known) < NGRAM:
            return []
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1):  # no n-gram with an unknown word is in a notice
            for h, at in winnow(words[run]) if len(run) >= NGRAM else ():
                for n, place in self.places.get(h, ()):
                    found[n].append((int(run[0]) + at - place, place))
        out = []
        for n, seeds in found.items():
            seeds.sort()
            groups = [[seeds[0]]]
            for s in seeds[1:]:
                if s[0] - groups[-1][-1][0] > min(BAND, len(self.words[n]) // 2):
                    groups.append([])
                groups[-1].append(s)
            out.append((n, [(g[len(g) // 2][0], min(p for _, p in g), max(p for _, p in g)) for g in groups]))
        return out


def chains(groups: list[tuple[int, int, int]], size: int) -> list[list[tuple[int, int, int]]]:
    """Groups that follow each other in the notice and in the text, with no more text in between than the notice has words:
    a copy into which text was put, or out of which a part was taken. Only chains of two and more."""
    out: list[list[tuple[int, int, int]]] = []
    for g in sorted(groups, key=lambda g: (g[0] + g[1], g)):
        for chain in out[:-4:-1]:  # other groups may lie between two of a chain, seldom many
            start, _, last = chain[-1]
            if g[1] > last and 0 < g[0] + g[1] - start - last <= size:
                chain.append(g)
                break
        else:
            out.append([g])
    return [c for c in out if len(c) > 1]


def chained(notice: np.ndarray, words: np.ndarray, chain: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """The matched ``(notice place, text place)`` of each part of the notice, a part aligned on its own group's diagonal. The
    cut between two parts lies where the later one's words begin to match without a gap."""
    cuts = [0]
    for (_, _, last), (start, first, _) in zip(chain, chain[1:]):
        cut = first
        while cut > last + NGRAM and 0 < start + cut <= len(words) and words[start + cut - 1] == notice[cut - 1]:
            cut -= 1
        cuts.append(cut)
    out = []
    begins = [0, *(start + cut for (start, _, _), cut in zip(chain[1:], cuts[1:])), len(words)]  # a part has its own stretch of the text
    for k, ((start, _, _), a, b) in enumerate(zip(chain, cuts, [*cuts[1:], len(notice)])):
        low = begins[k]
        out.append([(a + i, low + at) for i, at in matched(notice[a:b], words[low : begins[k + 1]], start + a - low)])
    return out


def densest(pairs: list[tuple[int, int]]) -> tuple[int, int]:
    """First and after the last of the matched words of the part of a notice with most matched beyond missing words."""
    best, at, low, floor = (0, 0, 0), 0, 0, 0
    for k, (place, _) in enumerate(pairs):
        before = 2 * k - place  # matched so far less missing so far, but for a constant
        if k == 0 or before < floor:
            floor, low = before, k
        if before + 1 - floor > best[0]:
            best = (before + 1 - floor, low, k + 1)
    return best[1:]


def matched(notice: np.ndarray, words: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Most words of ``notice`` in order in ``words`` within ``BAND`` of the diagonal from ``start``, as ``(notice place, text
    place)``. A row of the band at a time; fewer skipped words win ties, then the diagonal itself."""
    if not len(notice):
        return []
    width = 2 * BAND + 1
    d = np.arange(width)
    score = np.zeros(width)
    back = np.zeros((len(notice), width), dtype=np.int8)
    skip = 1e-3
    for i, w in enumerate(notice):
        j = start + i + d - BAND
        inside = (j >= 0) & (j < len(words))
        same = inside & (words[np.clip(j, 0, max(len(words) - 1, 0))] == w)
        diagonal = score + np.where(same, 1.0, -skip)
        above = np.r_[score[1:], -np.inf] - skip  # the notice's word is missing
        best = np.maximum(diagonal, above)
        run = np.maximum.accumulate(best + skip * d) - skip * d  # words of the text in between
        back[i] = np.where(run > best + 1e-12, 2, np.where(diagonal >= above, 0, 1)) + np.where(same & (diagonal >= best), 4, 0)
        score = run
    ties = np.flatnonzero(score >= score.max() - 1e-9)
    i, k = len(notice) - 1, int(ties[np.abs(ties - BAND).argmin()])
    out = []
    while i >= 0 and 0 <= k < width:
        step = back[i, k]
        if step & 3 == 2:
            k -= 1
        elif step & 3 == 1:
            i, k = i - 1, k + 1
        else:
            if step & 4:
                out.append((i, start + i + k - BAND))
            i -= 1
    return out[::-1]


def align(notice: np.ndarray, words: np.ndarray, start: int) -> tuple[int, int, int]:
    """Number of matched words, the places of the first and after the last of them in the text."""
    pairs = matched(notice, words, start)
    return (len(pairs), pairs[0][1], pairs[-1][1] + 1) if pairs else (0, -1, -1)


def scan(text: str | None, index: Index) -> list[tuple[str, float, int, int, int]]:
    """``license, coverage, matched words, start, end`` (code points) of the notices in a text, in order, without overlap:
    the one with more matched words stays. A notice is reported where all but a few of its words are, in one piece or in
    pieces that follow each other; of a long one also a part, without the matched words that lie apart from it. A span goes from the first matched word to the last; text
    between two pieces is in it, but other notices may stand there."""
    if not text:
        return []
    get = index.numbers.get
    words = np.fromiter((get(w, 0) for w in words_of(text)), dtype=np.int64)
    rows = []
    for n, groups in index.candidates(words):
        notice = index.words[n]
        size = len(notice)
        ways = [[matched(notice, words, start)] for start, _, _ in groups]
        ways += [chained(notice, words, chain) for chain in chains(groups, size)]
        for parts in ways:
            count = sum(map(len, parts))
            if not count or size - count > max(0, int(SLACK * size) - 1):
                if size < LONG or count < PART * size:
                    continue
                pairs = [p for part in parts for p in part]
                a, b = densest(pairs)
                count = b - a
                if count < PART * size:
                    continue
                parts = [[p for p in part if pairs[a] <= p <= pairs[b - 1]] for part in parts]
            rows.append((count, size, index.names[n], [(part[0][1], part[-1][1] + 1) for part in parts if part]))
    if not rows:
        return []
    # lower-casing can change the length of a text, so the spans come from the words as written
    spans = [m.span() for m in _WORDS.finditer(text)]
    if len(spans) != len(words):
        spans = [m.span() for m in _WORDS.finditer(text.lower())]
    taken: list[tuple[int, int]] = []
    out = []
    for count, size, name, parts in sorted(rows, key=lambda r: (-r[0], r[1], r[2], r[3])):
        if all(end <= a or first >= b for a, b in taken for first, end in parts):
            taken.extend(parts)
            out.append((name, round(count / size, 6), count, spans[parts[0][0]][0], spans[parts[-1][1] - 1][1]))
    return sorted(out, key=lambda r: (r[3], r[0]))


def license_spans(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, license, coverage, matched_words, start, end``: a row for every notice found in a document.

    ``notices`` maps names to wordings (:data:`NOTICES` by default). Null and empty texts have none; a notice that stands
    in a text several times has several rows; repeated rows and null ids are documents like any other. Extra columns are
    ignored; an empty table gives an empty one.
    """
    wordings = dict(NOTICES if notices is None else notices)
    kept = docs.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(wordings)
        for b in batches:
            rows = [(at, *r) for at, text in enumerate(b.column(1).to_pylist()) for r in scan(text, index)]
            at, name, coverage, count, start, end = zip(*rows) if rows else ((),) * 6
            kinds = ((name, pa.string()), (coverage, pa.float64()), (count, pa.int64()), (start, pa.int64()), (end, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in kinds)], names=["doc_id", "license", "coverage", "matched_words", "start", "end"])

    return kept.mapInArrow(run, f"doc_id {kind}, license string, coverage double, matched_words long, start long, end long")
