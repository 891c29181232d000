"""License scans by patience alignment.

A text's words are looked up in the templates' vocabulary. From each word of a
template two stretches are aligned, one a quarter longer than the template and
one 1 / ``density`` times as long: common ends are matched first, then words
that occur once in both sides anchor the alignment along their longest
increasing subsequence, and the gaps between anchors are aligned in the same
way. The coverage is the share of the template's words that are matched; of the
two alignments the one with more matched words (then the shorter) stands. A
notice whose words make less than ``density`` of the stretch that they span is
none, by definition: words spread so thin are ordinary prose. Stretches that
hold too few of the template's words, each counted as often as the template has
it at most, cannot reach the coverage and are passed over, so nothing is missed
by that. After a find the search goes on behind it, so repeated notices are all
found; of finds that overlap the one with more matched words (then the better
coverage) stays.

Defined results: a null, empty or word-free text has no finds; templates
without words are ignored; of equal finds the template that sorts first wins;
rows are independent; no documents give no rows. Columns other than the two
that are named are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import map_texts

COVERAGE, DENSITY = 0.8, 0.5
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

# fixed values: public license notices
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-line": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (ordered by the first) that increases in the second, by patience sorting (of equally long ones, the one whose places come first)."""
    tops: list[int] = []
    cards: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back[i] = cards[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(y)
            cards.append(i)
        else:
            tops[pile], cards[pile] = y, i
    out, i = [], cards[-1] if cards else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two sequences, by patience alignment."""
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
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = _increasing([(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in at_b])
        if not anchors:
            continue
        out.extend(anchors)
        for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            todo.append((i + 1, i2, j + 1, j2))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, density: float = DENSITY):
        self.coverage, self.density = coverage, density
        self.vocabulary: dict[bytes, int] = {}
        self.templates = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for name, t in sorted(templates.items()) if (ws := words(t.encode()))]
        size = len(self.vocabulary)
        self.member = np.zeros((len(self.templates), size + 1), bool)
        self.need = []
        for row, (_, ids) in zip(self.member, self.templates, strict=True):
            row[ids] = True
            count = Counter(ids)
            # distinct words without which the coverage cannot be reached
            lost = len(ids) - int(-(-len(ids) * coverage // 1))
            spare, kept = 0, len(count)
            for n in sorted(count.values()):
                spare += n
                if spare > lost:
                    break
                kept -= 1
            self.need.append(kept)

    def scan(self, text: bytes) -> list[tuple[str, int, int, float]]:
        ws = words(text)
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in ws], np.int64)
        seen = np.zeros(self.member.shape[1], bool)
        seen[ids] = True
        seen[-1] = False
        enough = (self.member & seen).sum(axis=1)
        found = []
        for t in np.flatnonzero(enough >= self.need).tolist():
            found += self._find(ids, t)
        found.sort(key=lambda f: (-f[4], -f[3], f[1], f[0]))
        taken = np.zeros(len(ws) + 1, bool)
        out = []
        for name, start, end, share, _ in found:
            if not taken[start:end].any():
                taken[start:end] = True
                out.append((name, start, end, share))
        return sorted(out, key=lambda f: (f[1], f[0]))

    def _starts(self, ids: np.ndarray, t: int, width: int, least: int) -> np.ndarray:
        """Places from which ``width`` words hold enough of the template's words, each counted as often as the template has it at most."""
        count = Counter(self.templates[t][1])
        ends = np.minimum(np.arange(len(ids)) + width, len(ids))
        plain = np.r_[0, np.cumsum(self.member[t][ids])]
        rough = np.flatnonzero((plain[ends] - plain[:-1] >= least) & self.member[t][ids])
        if not len(rough):
            return rough
        held = np.zeros(len(rough), np.int64)
        for w, most in count.items():
            at = np.flatnonzero(ids == w)
            held += np.minimum(np.searchsorted(at, ends[rough]) - np.searchsorted(at, rough), most)
        return rough[held >= least]

    def _find(self, ids: np.ndarray, t: int) -> list[tuple[str, int, int, float, int]]:
        name, own = self.templates[t]
        least = int(-(-len(own) * self.coverage // 1))
        near, wide = len(own) + max(3, len(own) // 4), int(-(-len(own) // self.density))
        first = set(own[: len(own) - least + 1])  # an alignment that starts with a later word is too short
        out, behind = [], 0
        for start in self._starts(ids, t, max(near, wide), least).tolist():
            if start < behind or int(ids[start]) not in first:
                continue
            best: tuple = ()
            for width in sorted({near, max(near, wide)}):
                pairs = align(own, ids[start : start + width].tolist())
                if len(pairs) >= least and pairs[0][1] == 0 and len(pairs) >= self.density * (pairs[-1][1] + 1):
                    best = max(best, (len(pairs), -pairs[-1][1]))
            if best:
                behind = start - best[1] + 1
                out.append((name, start, behind, best[0] / len(own), best[0]))
        return out


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE, density: float = DENSITY) -> DataFrame:
    """One row per document: id, n_licenses, license (of best coverage), coverage, finds (template, start, end in words, coverage)."""
    given = templates if templates is not None else TEMPLATES

    def rows_of(texts: list[bytes]) -> Iterable[tuple]:
        scanner = Scanner(given, coverage, density)
        for t in texts:
            finds = scanner.scan(t)
            yield ([{"template": n, "start": a, "end": b, "coverage": round(c, 6)} for n, a, b, c in finds],)

    found = map_texts(docs, id_col, text_col, [("finds", "array<struct<template:string,start:bigint,end:bigint,coverage:double>>")], rows_of)
    best = F.get(F.array_sort(F.transform("finds", lambda f: F.struct((-f["coverage"]).alias("c"), f["start"].alias("s"), f["template"].alias("t")))), F.lit(0))
    some = F.size("finds") > 0
    return found.select(id_col, F.size("finds").cast("bigint").alias("n_licenses"), F.when(some, best["t"]).alias("license"), F.when(some, -best["c"]).alias("coverage"), "finds")
