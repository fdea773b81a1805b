"""Licence scan: runs of words against licence templates by the Dice coefficient over word bigrams.

Texts are brought to a normal form: lower case, words only, spelling variants
made alike, copyright lines and comment signs left out. A run of consecutive
words matches a template when twice the number of shared bigrams (with their
counts) is at least ``LEAST`` of the two sizes together. That can only hold
when the sizes are within a fixed ratio and the run shares a fixed part of the
template, so the bigrams of the text pick the templates to compare. Runs may
begin and end inside a line.

Licences of one family share most of their words. A match also needs the
template's words for family and version, and no such word that the template
lacks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LEAST = 0.8

_word = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_copyright = re.compile(r"^\W*(?:copyright|\(c\)|©)[\W_]*(?:\(c\)|©|[0-9]{4}|<year>|\[yyyy\])", re.I)
# Words of a line that is only a copyright notice, at most.
COPYRIGHT_WORDS = 25
# Spelling variants.
ALIKE = {"licence": "license", "licenced": "licensed", "licences": "licenses", "sublicence": "sublicense", "noncommercial": "nc", "http": "https", "v2": "2", "v3": "3", "1.0": "1", "2.0": "2", "3.0": "3", "4.0": "4"}
# Words that tell licences of one family apart, and words for the family and version that a match must have where the template has them.
MARKS = frozenset("lesser affero nc sa nd sharealike noderivatives noderivs endorse".split())
FAMILIES = frozenset("mit apache gnu mozilla mpl bsd isc cc creative attribution gpl agpl lgpl library".split())
# Templates of more bigrams than this are full texts: they name their relatives, and may lack their ends.
FULL = 400
# Words too common to tell a licence from other text.
COMMON = frozenset("a an and any are as at be by each for from he in is it no not of on or shall she such that the their this to under was which with you your".split())

# Notices and short licence texts, by SPDX id.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

HEADER = """This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {family} as published by the Free Software Foundation{either} version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {family} for more details."""
GNU = {
    "GPL-1.0": ("General Public License", "1"), "GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"),
    "LGPL-2.0": ("Library General Public License", "2"), "LGPL-2.1": ("Lesser General Public License", "2.1"), "LGPL-3.0": ("Lesser General Public License", "3"),
    "AGPL-3.0": ("Affero General Public License", "3"),
}
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def relatives() -> list[tuple[str, str]]:
    """Notices of all versions in the GNU, Apache, Mozilla and Creative Commons families."""
    out = [(i, HEADER.format(what=what, sep=";", family=f, either="; either", version=v)) for i, (f, v) in GNU.items() for what in ("program", "library")]
    out += [(i, f"This {what} is licensed under the GNU {f}, version {v}.") for i, (f, v) in GNU.items() for what in ("work", "program")]
    out += [("Apache-1.1", "Licensed under the Apache License, Version 1.1."), ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."), ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/")]
    for k, name in CREATIVE.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            kind = "International" if v == "4.0" else "Unported" if v == "3.0" else "Generic"
            out += [(f"CC-{k}-{v}", f"Licensed under CC {k} {v}."), (f"CC-{k}-{v}", f"This work is licensed under a Creative Commons {name} {v} {kind} License.")]
    return out


@cache
def all_templates() -> tuple[tuple[str, str], ...]:
    """The notices and short texts above, those of their relatives, and the full texts beside this file."""
    full = [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    return tuple(dict.fromkeys((*TEMPLATES, *relatives(), *full)))


def normal_words(text: str) -> list[str]:
    return [ALIKE.get(w, w) for w in _word.findall(text.lower())]


def words_of(text: str) -> tuple[list[str], list[int]]:
    """A text's words in normal form without those of copyright lines, and the line of each."""
    words, lines = [], []
    for i, x in enumerate(text.split("\n")):
        # A long line that begins with a copyright sign holds more than the notice of it.
        found = normal_words(x)
        if _copyright.match(x) and len(found) <= COPYRIGHT_WORDS:
            continue
        words += found
        lines += [i] * len(found)
    return words, lines


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


class Library:
    """Templates sorted by size, and the words without which no run of lines can match."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        made = sorted(((sum(b.values()), name, b) for name, b in ((name, bigrams(words_of(text)[0])) for name, text in templates)), key=lambda t: t[:2])
        self.least, self.made = least, made
        self.ids: dict[tuple[str, str], int] = {}
        self.counts, self.needed, self.holders = [], [], {}
        for at, (_, name, b) in enumerate(made):
            for pair in b:
                self.ids.setdefault(pair, len(self.ids))
                self.holders.setdefault(self.ids[pair], []).append(at)
            words = {w for pair in b for w in pair}
            number = re.search(r"-([0-9.]+)$", name)
            version = {ALIKE.get(number[1], number[1].removesuffix(".0"))} if number else set()
            self.needed.append((words & (FAMILIES | version | (MARKS if sum(b.values()) <= FULL else frozenset())), MARKS - words))
        for _, _, b in made:
            count = np.zeros(len(self.ids) + 1, dtype=np.int64)  # the last is for bigrams of no template
            for pair, c in b.items():
                count[self.ids[pair]] = c
            self.counts.append(count)
        self.watched = frozenset().union(MARKS, *(x for x, _ in self.needed))
        self.first = [self.ids[next(iter(b))] for _, _, b in made]
        self.sizes = [n for n, _, _ in made]
        self.telling: set[str] = set()
        for n, name, b in made:
            # A match shares at least least / (2 - least) of the template, so one of these words is in it.
            own = sum(c for pair, c in b.items() if not COMMON.issuperset(pair))
            if own <= n * (1 - least / (2 - least)):
                raise ValueError(f"a template of {name} has too few telling words")
            self.telling |= {w for pair in b for w in pair} - COMMON
        self.lowest = self.sizes[0] * least / (2 - least)
        self.highest = self.sizes[-1] * (2 - least) / least

    def best(self, run: Counter, size: int) -> tuple[float, str] | None:
        """Greatest coefficient among the templates whose size allows a match; the first name among equals. Words for family and version don't count here."""
        a = bisect_left(self.sizes, size * self.least / (2 - self.least) - 1e-9)
        b = bisect_right(self.sizes, size * (2 - self.least) / self.least + 1e-9)
        found = None
        for n, name, t in self.made[a:b]:
            score = 2 * sum(min(c, t[pair]) for pair, c in run.items() if pair in t) / (n + size)
            if score >= self.least and (found is None or (-score, name) < (-found[0], found[1])):
                found = score, name
        return found

    def _runs(self, at: int, pairs: np.ndarray, words: list[str], places: dict[str, list[int]]) -> list[tuple[int, float, int, int]]:
        """(shared bigrams, coefficient, first word, last word) of runs that match template ``at``, best first and without overlap."""
        n, count, least = self.made[at][0], self.counts[at], self.least
        needed, barred = self.needed[at]
        if not all(places[w] for w in needed):
            return []

        def after(w: str, i: int) -> int:
            """Place of the first ``w`` from word ``i``."""
            k = bisect_left(places[w], i)
            return places[w][k] if k < len(places[w]) else len(words)

        hit = count[pairs] > 0
        before = np.concatenate([[0], np.cumsum(hit)])
        width = int(n * (2 - least) / least + 1e-9)
        # A longer run is better when it begins one hit earlier: runs begin where hits do, or where the template does.
        starts = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]) | (pairs == self.first[at]))
        ends = np.minimum(starts + width, len(pairs))
        starts = starts[before[ends] - before[starts] >= n * least / (2 - least) - 1e-9]
        found = []
        for i in starts.tolist():
            part = pairs[i : i + width]
            # The k-th time of a bigram in the run counts if the template has it k times.
            order = np.argsort(part, kind="stable")
            new = np.concatenate([[True], part[order][1:] != part[order][:-1]])
            rank = np.empty(len(part), dtype=np.int64)
            rank[order] = np.arange(len(part)) - np.maximum.accumulate(np.where(new, np.arange(len(part)), 0))
            shared = np.cumsum(rank < count[part])
            score = 2 * shared / (n + np.arange(1, len(part) + 1))
            # The best end whose words are right: the needed ones are in the run, the barred ones are not.
            from_, to = max((after(w, i) for w in needed), default=0) - i - 1, min((after(w, i) for w in barred), default=len(words)) - i - 1
            score[: max(from_, 0)] = 0
            score[max(to, 0) :] = 0
            j = int(score.argmax())
            if score[j] >= least:
                found.append((int(shared[j]), float(score[j]), i, i + j + 1))
        out: list[tuple[int, float, int, int]] = []
        for x in sorted(found, key=lambda x: (-x[1], -x[0], x[2])):
            if all(x[3] < c or x[2] > d for _, _, c, d in out):
                out.append(x)
        return out

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(licence, first line, last line, coefficient) of the best runs that don't overlap, in their order.

        Of runs that overlap the one with most shared bigrams stays: a notice inside a full text is part of it.
        """
        words, lines = words_of(text or "")
        get, other = self.ids.get, len(self.ids)
        pairs = np.fromiter((get(x, other) for x in zip(words, words[1:])), dtype=np.int64, count=max(len(words) - 1, 0))
        times = np.bincount(pairs, minlength=other + 1)
        there = np.flatnonzero(times[:other]).tolist()
        if not there:
            return []
        places: dict[str, list[int]] = {w: [] for w in self.watched}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        near = Counter(at for x in there for at in self.holders[x])
        found = []
        for at, kinds in near.items():
            n, name, b = self.made[at]
            # A match shares at least least / (2 - least) of the template.
            if kinds >= (n * self.least / (2 - self.least) - 1e-9) - (n - len(b)) and np.minimum(times[:other], self.counts[at][:other]).sum() >= n * self.least / (2 - self.least) - 1e-9:
                found += [(-shared, -score, name, i, j) for shared, score, i, j in self._runs(at, pairs, words, places)]
        taken: list[tuple[int, int, str, float]] = []
        for _, score, name, i, j in sorted(found):
            if all(j < a or i > b for a, b, _, _ in taken):
                taken.append((i, j, name, -score))
        return [(name, lines[i], lines[j], score) for i, j, name, score in sorted(taken)]


@cache
def library(templates: tuple[tuple[str, str], ...] | None = None, least: float = LEAST) -> Library:
    return Library(templates or all_templates(), least)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] | None = None, least: float = LEAST) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``license``, ``score``, ``n_matches`` and ``matches``.

    ``license`` and ``score`` are those of the best match, null and 0 without
    one; among equals the first line's wins. ``matches`` lists
    ``licence:first line:last line`` in the text's order, lines from 0, joined by commas.
    ``templates`` are all known ones by default.
    Whole texts are read. Null and empty texts match nothing; every row is
    kept, repeated ones and null ids too; other columns are ignored.
    """

    templates = templates or all_templates()

    @F.pandas_udf("license string, score double, n_matches long, matches string")
    def of(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lib = library(templates, least)
        for s in series:
            rows = []
            for text in s:
                found = lib.scan(text)
                top = min(found, key=lambda t: (-t[3], t[1]), default=(None, 0, 0, 0.0))
                rows.append((top[0], top[3], len(found), ",".join(f"{n}:{i}:{j}" for n, i, j, _ in found)))
            yield pd.DataFrame(rows, columns=["license", "score", "n_matches", "matches"])

    return docs.select("doc_id", of("text").alias("m")).select("doc_id", "m.*")
