"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textvec import U, Words, chunks, mix64
from .util import text_of

#: Words in a shingle; least share of a template's shingles that a window must hold.
SHINGLE, CONTAINMENT = 2, 0.8
#: Hash functions in a band, and bands. A window as long as its template which holds 0.8 of its shingles has a similarity of 2/3 at
#: least (0.8 / 1.2), so a window goes unseen with a probability of (1 - (2/3)^ROWS)^BANDS, 2e-8 here; even at a similarity of 1/2
#: it is 1e-4. Windows begin at every word, so each passage has several chances.
ROWS, BANDS = 2, 32
_SIEVE = (1 << 16) - 1
OUT = "doc_id long, license string, word_start long, n_words long, containment double"

_GNU = (
    "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
    "Software Foundation{sign} either version {version} of the License, or (at your option) any later version."
)
_WARRANTY = (
    "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not "
    "limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."
)
_CC = "This work is licensed under a Creative Commons {name} International License."


def _gnu(what: str, name: str, version: str, colon: str = ":", sign: str = ",") -> str:
    return _GNU.format(what=what, name=name, version=version, colon=colon, sign=sign)


#: Notices, and the standard texts or their telling paragraphs. A family's name may stand more than once. Long texts (GPL, Apache, MPL, EPL and Creative
#: Commons themselves) are known by the notices that files bear and by their openings.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", _CC.format(name="Attribution 4.0")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, '
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A '
        "PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ),
    ("BSD", _WARRANTY),
    (
        "BSD-2-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
        "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
    ),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at",
    ),
    (
        "Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
        "under the License.",
    ),
    ("GPL-3.0", _gnu("program", "General Public License", "3")),
    ("GPL-2.0", _gnu("program", "General Public License", "2", ";", ";")),
    ("LGPL-2.1", _gnu("library", "Lesser General Public License", "2.1", ";", ";")),
    ("LGPL-3.0", _gnu("library", "Lesser General Public License", "3")),
    ("AGPL-3.0", _gnu("program", "Affero General Public License", "3")),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software',
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-SA-4.0", _CC.format(name="Attribution-ShareAlike 4.0")),
    ("CC-BY-NC-4.0", _CC.format(name="Attribution-NonCommercial 4.0")),
    ("CC-BY-ND-4.0", _CC.format(name="Attribution-NoDerivatives 4.0")),
    ("CC-BY-NC-SA-4.0", _CC.format(name="Attribution-NonCommercial-ShareAlike 4.0")),
    ("CC-BY-NC-ND-4.0", _CC.format(name="Attribution-NonCommercial-NoDerivatives 4.0")),
    ("CC-BY-SA-3.0", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("ODbL-1.0", "This database is made available under the Open Database License"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("Artistic-2.0", "You may distribute under the terms of either the GNU General Public License or the Artistic License"),
    ("Public-Domain", "This work has been released into the public domain by its author"),
)


def _shingles(words: Words) -> np.ndarray:
    """A hash for the shingle that begins at each word; those that cross texts are garbage."""
    return words.grams(SHINGLE)[0]


@functools.cache
def _seeds() -> np.ndarray:
    return mix64(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def _minhash(shingles: np.ndarray, seed: np.uint64, width: int) -> np.ndarray:
    """Least hash of each window of ``width`` shingles, by doubling."""
    h = (shingles ^ seed) * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    have = 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


class Templates:
    """Templates with, for each number of shingles, a sorted table of band values. Cost doesn't grow with the number of templates but with
    the anchors found: a window that holds CONTAINMENT of a template's shingles lacks few of them, so of so many and one more it holds one. These anchors are the
    shingles that fewest templates have; they stand in one sorted table."""

    def __init__(self, templates=TEMPLATES):
        self.names = [n for n, _ in templates]
        self.widths: dict[int, list[int]] = {}
        self.sets, rows = [], []
        for k, (_, text) in enumerate(templates):
            s = _shingles(Words([text]))
            if len(s) == 0:
                raise ValueError(f"a template needs {SHINGLE} words")
            self.sets.append(np.unique(s))
            rows.append(s)
            self.widths.setdefault(len(s), []).append(k)
        self.width_of = np.array([len(s) for s in rows], np.int64)
        every, shared = np.unique(np.concatenate(self.sets), return_counts=True) if self.sets else (np.zeros(0, np.uint64), np.zeros(0, int))
        anchors = []
        for s in self.sets:
            need = int(np.ceil(CONTAINMENT * len(s) - 1e-9))
            anchors.append(s[np.lexsort((s, shared[np.searchsorted(every, s)]))[: len(s) - need + 1]])
        of = np.repeat(np.arange(len(anchors)), [len(a) for a in anchors])
        flat = np.concatenate(anchors) if anchors else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.anchors, self.anchored = flat[order], of[order]
        self.sieve = np.zeros(_SIEVE + 1, bool)
        self.sieve[(self.anchors & U(_SIEVE)).astype(np.int64)] = True
        #: by width: of each band, sorted values and their templates
        self.bands = {w: [self._band(ks, rows, b) for b in range(BANDS)] for w, ks in self.widths.items()}

    def _band(self, ks: list[int], rows: list[np.ndarray], band: int) -> tuple[np.ndarray, np.ndarray]:
        seeds = _seeds()[band * ROWS : (band + 1) * ROWS]
        values = np.array([self._value([_minhash(rows[k], s, len(rows[k]))[:1] for s in seeds])[0] for k in ks], np.uint64)
        order = np.argsort(values, kind="stable")
        return values[order], np.array(ks)[order]

    @staticmethod
    def _value(hashes: list[np.ndarray]) -> np.ndarray:
        out = hashes[0]
        for h in hashes[1:]:
            out = out * U(0xD6E8FEB86659FD93) + h
        return out

    @staticmethod
    def _equal(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places (of values, of the sorted table) with equal numbers."""
        lo, hi = np.searchsorted(table, values), np.searchsorted(table, values, side="right")
        n = hi - lo
        return np.repeat(np.arange(len(values)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)

    def anchors_in(self, shingles: np.ndarray) -> dict[int, np.ndarray]:
        """By width: places of anchors of templates of that width."""
        hit = np.flatnonzero(self.sieve[(shingles & U(_SIEVE)).astype(np.int64)])
        at, of = self._equal(self.anchors, shingles[hit])
        if not len(at):
            return {}
        place, width = hit[at], self.width_of[self.anchored[of]]
        return {int(w): np.unique(place[width == w]) for w in np.unique(width)}

    def retrieve(self, shingles: np.ndarray, width: int, hit: np.ndarray) -> dict[int, np.ndarray]:
        """Windows, by their first shingle, that hold an anchor and share a band with a template of this width."""
        last = len(shingles) - width
        begin, end = np.maximum(hit - width + 1, 0), np.minimum(hit, last) + 1  # windows that hold the hit
        fresh = np.concatenate([[True], begin[1:] > end[:-1]])
        begin, end = begin[fresh], end[np.concatenate([fresh[1:], [True]])]
        some = end > begin
        begin, end = begin[some], end[some]
        if not len(begin):
            return {}
        size = end - begin + width - 1
        at0 = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(at0 - begin, size)
        real = place < np.repeat(end, size)
        part = shingles[place]
        found: dict[int, list] = {}
        for band, (values, ks) in enumerate(self.bands[width]):
            got = self._value([_minhash(part, s, width) for s in _seeds()[band * ROWS : (band + 1) * ROWS]])
            at, of = self._equal(values, got)
            good = real[at]
            at, of = at[good], ks[of[good]]
            for k in np.unique(of):
                found.setdefault(int(k), []).append(place[at[of == k]])
        return {k: np.unique(np.concatenate(at)) for k, at in found.items()}

    def contained(self, shingles: np.ndarray, starts: np.ndarray, k: int, width: int) -> np.ndarray:
        """Share of the template's shingles in each window; windows with too few hits, repeated ones counted, are left at 0."""
        s = self.sets[k]
        lo, hi = int(starts[0]), int(starts[-1]) + width
        part = shingles[lo:hi]
        at = np.minimum(np.searchsorted(s, part), len(s) - 1)
        seen = np.concatenate([[0], np.cumsum(s[at] == part)])
        out = np.zeros(len(starts))
        enough = np.flatnonzero(seen[starts - lo + width] - seen[starts - lo] >= CONTAINMENT * len(s) - 1e-9)
        for i in enough:
            out[i] = len(np.intersect1d(shingles[starts[i] : starts[i] + width], s)) / len(s)
        return out


def best_windows(starts: np.ndarray, shares: np.ndarray, width: int) -> list[tuple[int, float]]:
    """Of matching windows that overlap, one after another, the one that holds most; of equal ones the first."""
    out: list[tuple[int, float]] = []
    last = None
    for s, c in zip(starts.tolist(), shares.tolist()):
        if last is not None and s - last < width + SHINGLE - 1:
            if c > out[-1][1] + 1e-12:
                out[-1] = (s, c)
        else:
            out.append((s, c))
        last = s
    return out


def _scan(texts: list, templates: Templates) -> list[tuple[int, int, int, int, float]]:
    """(text number, template, first word, words, containment)"""
    words = Words(texts)
    shingles = _shingles(words)
    # the shingle that crosses texts becomes one that no template has, so windows over two texts match no better than their parts
    shingles = shingles.copy()
    cross = words.first[1:-1] - 1
    shingles[cross[(cross >= 0) & (cross < len(shingles))]] = U(0)
    rows = []
    for width, hit in templates.anchors_in(shingles).items():
        if len(shingles) < width:
            continue
        for k, at in templates.retrieve(shingles, width, hit).items():
            owner = np.searchsorted(words.first, at, side="right") - 1
            inside = at + width + SHINGLE - 1 <= words.first[owner + 1]
            at, owner = at[inside], owner[inside]
            if not len(at):
                continue
            shares = templates.contained(shingles, at, k, width)
            good = shares >= CONTAINMENT - 1e-12
            at, owner, shares = at[good], owner[good], shares[good]
            for d in np.unique(owner):
                own = owner == d
                rows += [(int(d), k, int(a - words.first[d]), width + SHINGLE - 1, c) for a, c in best_windows(at[own], shares[own], width)]
    return rows


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, word_start, n_words, containment): where a document holds a license template.

    Words are lower-cased runs of letters and digits, a shingle is SHINGLE of them in a row, and a window is as long as
    the template and begins at any word of the text. Windows that share a MinHash band with the template are verified: one matches
    if it holds CONTAINMENT of the template's distinct shingles. Of matching windows that overlap, the fullest is returned (the
    first of equal ones), once for each template, so a text may match two templates at one place. Null and empty texts, and those shorter than a
    template, don't match it. Each row of docs is judged by itself: repeated rows repeat their matches; a null doc_id is carried along.
    Only the templates travel to the tasks; documents are never shuffled."""
    held: list[Templates] = []

    def run(batches):
        if not held:
            held.append(Templates(templates))
        for b in batches:
            ids, texts, rows = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for lo, hi in chunks(texts):
                rows += [(ids[lo + d], held[0].names[k], *rest) for d, k, *rest in _scan(texts[lo:hi], held[0])]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, OUT)
