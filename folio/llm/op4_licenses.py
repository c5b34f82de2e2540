"""License scans: winnowed fingerprints pick candidates, banded alignment confirms.

Templates are cut into words and hashed in runs of K words; of each WINDOW
consecutive runs the least hash is kept, in an inverted index from hash to
template and place. A text's runs that are in the index are hits; a text that
shares K + WINDOW - 1 words in a row with a template has one. A hit where the whole
template stands word for word is a match at once. The other hits on one template
whose diagonals are close together make a region, and in each region the template is
aligned with the text in a band about the hits' diagonals (words match or not; local
alignment, matches +2, others -1), and again with what is left of it. A region's
diagonals reach as far as SPREAD, or half the template, so the work grows with the
number of hits and not with its square. A row is given for each alignment in which
at least LEAST of the template's words match: how many, their share, and the span.

Words are runs of ASCII letters and digits and of non-ASCII characters, without
regard to A-Z's case. The index is made of the given templates alone, so it is of
fixed size. Null and empty texts have no matches. Repeated rows have theirs
repeated; rows with null ids keep them. Spans are in characters, end excluded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import plain, read, tune

K, WINDOW = 3, 2
#: Words by which the band reaches to either side of the hits' diagonals.
BAND = 8
#: Words by which the diagonals of a region's hits differ, at most (half a template's words if that is more).
SPREAD = 32
#: Least share of a template's words that match.
LEAST = 0.7

# Statements and opening clauses of public licenses.
TEMPLATES = {
    "MIT-statement": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "All-rights-reserved": "All rights reserved.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

SCHEMA = "doc_id long, template string, matched int, template_words int, coverage double, start long, end long"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BLANK = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().translate(_BLANK).split()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Index(NamedTuple):
    """words: number of each template word, from 1; runs: sorted codes of the kept runs; places: those with (template, place), by run."""

    names: list[str]
    templates: list[np.ndarray]
    words: _Vocabulary
    runs: np.ndarray
    places: list[list[tuple[int, int]]]


def _codes(ids: np.ndarray, base: int) -> np.ndarray:
    """Numbers of the runs of K words; 0 where a word is unknown."""
    n = max(0, len(ids) - K + 1)
    code, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(K):
        part = ids[k : k + n]
        code, known = code * base + part, known & (part > 0)
    return np.where(known, code, 0)


def winnowed(codes: np.ndarray) -> list[int]:
    """Places of the kept runs: the least hash of each window, the last of equals."""
    h = [zlib.crc32(int(c).to_bytes(8, "little")) for c in codes]
    spans = [range(a, min(a + WINDOW, len(h))) for a in range(max(1, len(h) - WINDOW + 1))] if h else []
    return sorted({min(s, key=lambda i: (h[i], -i)) for s in spans})


def build(templates: Mapping[str, str]) -> Index:
    names, lists = list(templates), [words_of(t) for t in templates.values()]
    vocabulary = _Vocabulary({w: k for k, w in enumerate(sorted({w for x in lists for w in x}), 1)})
    ids = [np.array([vocabulary[w] for w in x], np.int64) for x in lists]
    found: dict[int, list[tuple[int, int]]] = {}
    for t, x in enumerate(ids):
        codes = _codes(x, len(vocabulary) + 1)
        for q in winnowed(codes):
            found.setdefault(int(codes[q]), []).append((t, q))
    runs = sorted(found)
    return Index(names, ids, vocabulary, np.array(runs, np.int64), [found[r] for r in runs])


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with text place minus template place from low to high: matches, first and last place in the text (excluded); the earliest of equals."""
    width = high - low + 1
    score, match, start = [0] * (width + 2), [0] * (width + 2), [-1] * (width + 2)
    best = (0, 0, 0, 0)
    for q, word in enumerate(template.tolist()):
        new, newm, news = [0] * (width + 2), [0] * (width + 2), [-1] * (width + 2)
        for d in range(1, width + 1):
            p = q + low + d - 1
            if not 0 <= p < len(text):
                continue
            same = word == text[p]
            s = score[d] + (2 if same else -1)
            m, a = match[d] + same, start[d] if score[d] > 0 else p
            if score[d] <= 0:
                s, m = (2 if same else -1), int(same)
            for other, om, oa in ((score[d + 1], match[d + 1], start[d + 1]), (new[d - 1], newm[d - 1], news[d - 1])):
                if other - 1 > s:
                    s, m, a = other - 1, om, oa
            if s > 0:
                new[d], newm[d], news[d] = s, m, a
                if s > best[0]:
                    best = (s, m, a, p + 1)
        score, match, start = new, newm, news
    return best[1:]


def scan(text: str, index: Index, least: float = LEAST) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, last word excluded) of each region that matches well enough."""
    ids = np.fromiter(map(index.words.__getitem__, words_of(text)), np.int64)
    codes = _codes(ids, len(index.words) + 1)
    at = np.searchsorted(index.runs, codes)
    at[at == len(index.runs)] = 0
    hits: dict[int, list[tuple[int, int]]] = {}
    for p in np.flatnonzero((codes > 0) & (index.runs[at] == codes)).tolist() if len(index.runs) else ():
        for t, q in index.places[at[p]]:
            hits.setdefault(t, []).append((p, p - q))
    out = []
    for t, found in sorted(hits.items()):
        template = index.templates[t]
        size, reach = len(template), max(SPREAD, len(template) // 2)
        free, rest, end = ids.copy(), [], -1
        for p, d in found:  # in the order of the text
            if d >= max(0, end) and d + size <= len(ids) and (ids[d : d + size] == template).all():
                out.append((t, size, d, d + size))
                free[d : d + size], end = 0, d + size
            elif p >= end:
                rest.append((p, d))
        regions: list[list[tuple[int, int]]] = []
        for p, d in sorted(rest, key=lambda x: (x[1], x[0])):  # of like diagonals
            if regions and d - regions[-1][-1][1] <= 2 * BAND and d - regions[-1][0][1] <= reach:
                regions[-1].append((p, d))
            else:
                regions.append([(p, d)])
        for r in regions:
            while r:  # a region can hold the template several times: what is found is taken out
                low, high = r[0][1] - BAND, r[-1][1] + BAND
                first = max(0, low)
                matched, a, b = align(template, free[first : high + size + 1].tolist(), low - first, high - first)
                a, b = a + first, b + first
                if matched >= least * size:
                    out.append((t, matched, a, b))
                    free[a:b] = 0
                # the best score may be too few matches, and another place in the region have enough
                left = [(p, d) for p, d in r if not a <= p < b and free[p]]
                r = left if len(left) < len(r) else r[1:]
    return out


def find_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, *, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, template, matched, template_words, coverage, start, end): a row for each place where a template is found."""
    tune(docs.sparkSession)
    index = build(templates)

    def run(batches):
        for b in batches:
            rows, texts = [], b.column("text")
            for k, doc_id in enumerate(b.column("doc_id").to_pylist()):
                text = texts[k].as_py()
                if found := scan(text, index, least):
                    raw = text.encode()
                    spans = [m.span() for m in _WORD.finditer(raw.lower())]
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # before each byte
                    for t, matched, first, last in found:
                        start, end = int(chars[spans[first][0]]), int(chars[spans[last - 1][1]])
                        size = len(index.templates[t])
                        rows.append((doc_id, index.names[t], matched, size, matched / size, start, end))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=["doc_id", "template", "matched", "template_words", "coverage", "start", "end"])

    return plain(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(read(spark, sf_dir, "documents"))
