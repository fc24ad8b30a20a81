"""Operator 8, license scans by winnowed fingerprints and banded alignment.

Templates are word sequences. Of each template's hashed ``GRAM``-word sequences, the least in every
window of ``WINNOW`` is kept in an inverted index; a text that shares ``GRAM + WINNOW - 1`` words in
a row with a template thus shares one of them. A text's sequences are looked up (only those of words
that templates have); hits of one template on nearby diagonals make a candidate, and the template is
aligned with the text around them, inside a band of ``BAND`` diagonals on either side, for the most
matched words in order. A candidate counts if the matched words cover enough of the template and lie
close together, and if every number of the template (its version) is among them; of overlapping ones
the one with more matched words stays.

Defined cases: null and empty texts have no match; very long texts are read whole, in time that grows
with their length; a template repeated in a text is reported each time; ties between overlapping matches go to the greater coverage, then to the license's name;
repeated rows give repeated results; an empty table gives no row; other columns stay. Spans count
code points, ends exclusive.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, extended, prepare, table
from .decontaminate import words_of

GRAM = 3
WINNOW = 2
BAND = 6
#: The least share of a template's words that must match, and of the text's words between the first and the last match.
COVERAGE = 0.8
DENSITY = 0.7

# Names (SPDX) and public notices of licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("rights-reserved", "All rights reserved."),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Match(NamedTuple):
    license: str
    #: Words of the text, end exclusive.
    first: int
    last: int
    matched: int
    coverage: float


def align(template: np.ndarray, text: np.ndarray, band: int = BAND) -> tuple[int, int, int]:
    """The most words of the template found in order in the text, with the first and last of those places.

    ``text[band + i]`` faces ``template[i]``; only places within ``band`` of the facing one are tried.
    Each cell holds the best chain (matched, minus its first place, its last place) up to there.
    """
    width = 2 * band + 1
    none = (0, 0, -1)
    row = [none] * (width + 1)
    best = none
    for i, word in enumerate(template.tolist()):
        # A step down the template moves the band one place on: the cell before the band's edge is gone.
        before, row = row, [none] * (width + 1)
        left = none
        for k in range(width):
            place = i + k
            cell = max(left, before[k + 1] if k + 1 <= width else none)
            if place < len(text) and text[place] == word:
                chain = before[k]
                grown = (chain[0] + 1, chain[1], place) if chain[0] else (1, -place, place)
                cell = max(cell, grown)
            row[k] = left = cell
        best = max(best, left)
    return best[0], -best[1], best[2]


class Scanner:
    """The templates, their index, and the search of a text."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.names = [name for name, _ in templates]
        words = [words_of(text.encode()) for _, text in templates]
        self.ids: dict[bytes, int] = {}
        for sequence in words:
            for word in sequence:
                self.ids.setdefault(word, len(self.ids) + 1)
        self.sequences = [np.array([self.ids[w] for w in sequence], dtype=np.int64) for sequence in words]
        self.numbers = [{self.ids[w] for w in sequence if w.isdigit()} for sequence in words]
        self.base = len(self.ids) + 1
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, sequence in enumerate(self.sequences):
            for key, place in self._winnowed(sequence):
                self.index.setdefault(key, []).append((t, place))
        self.keys = np.array(sorted(self.index), dtype=np.int64)

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(max(0, len(ids) - GRAM + 1), dtype=np.int64)
        for k in range(GRAM):
            out = out * self.base + ids[k : len(ids) - GRAM + 1 + k]
        return out

    def _winnowed(self, ids: np.ndarray) -> list[tuple[int, int]]:
        grams = self._grams(ids).tolist()
        order = [zlib.crc32(str(g).encode()) for g in grams]
        kept = set()
        for start in range(max(1, len(grams) - WINNOW + 1)):
            window = range(start, min(start + WINNOW, len(grams)))
            # The rightmost least, as winnowing has it.
            kept.add(min(window, key=lambda i: (order[i], -i)))
        return [(grams[i], i) for i in sorted(kept)]

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Template and diagonal of groups of hits."""
        if len(ids) < GRAM:
            return []
        known = ids > 0
        whole = known[: len(ids) - GRAM + 1].copy()
        for k in range(1, GRAM):
            whole &= known[k : len(ids) - GRAM + 1 + k]
        places = np.flatnonzero(whole)
        if not len(places):
            return []
        grams = np.zeros(len(places), dtype=np.int64)
        for k in range(GRAM):
            grams = grams * self.base + ids[places + k]
        at = np.searchsorted(self.keys, grams)
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == grams
        found = sorted({(t, place - start) for place, gram in zip(places[hit].tolist(), grams[hit].tolist(), strict=True) for t, start in self.index[gram]})
        out: list[tuple[int, int]] = []
        for t, diagonal in found:
            # Diagonals within half a band of the last candidate's are seen by its alignment.
            if not out or out[-1][0] != t or diagonal - out[-1][1] > BAND // 2:
                out.append((t, diagonal))
        return out

    def matches(self, words: list[bytes]) -> list[Match]:
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        found = []
        for t, diagonal in self.candidates(ids):
            template = self.sequences[t]
            start = diagonal - BAND
            window = ids[max(0, start) : max(0, diagonal + len(template) + BAND)]
            window = np.concatenate([np.zeros(max(0, -start), dtype=np.int64), window])
            matched, first, last = align(template, window)
            coverage = matched / len(template)
            close = coverage >= COVERAGE and matched >= DENSITY * (last - first + 1)
            if close and self.numbers[t].issubset(window[first : last + 1].tolist()):
                found.append(Match(self.names[t], start + first, start + last + 1, matched, coverage))
        found.sort(key=lambda m: (-m.matched, -m.coverage, m.license, m.first))
        kept: list[Match] = []
        taken = np.zeros(len(words), dtype=bool)
        for match in found:
            place = taken[match.first : match.last]
            if not place.any():
                kept.append(match)
                place[:] = True
        return sorted(kept, key=lambda m: m.first)


@functools.lru_cache(maxsize=2)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """Add ``licenses``, an array of (license, start, end, coverage), to the rows; other columns stay."""
    prepare(docs.sparkSession)
    docs = docs.drop("licenses")
    k = docs.columns.index(text)
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(templates)
        for batch in bounded(batches, k):
            out = []
            for text in batch.column(k).to_pylist():
                rows = []
                if text and (found := own.matches(words_of(text.encode("utf-8", "surrogatepass")))):
                    places = [m.span() for m in _WORD.finditer(text)]
                    rows = [{"license": m.license, "start": places[m.first][0], "end": places[m.last - 1][1], "coverage": round(m.coverage, 6)} for m in found]
                out.append(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "licenses"])

    return docs.mapInArrow(run, extended(docs, "licenses array<struct<license:string,start:int,end:int,coverage:double>>"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("licenses", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"),
        F.array_join(F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"])), ",").alias("spans"),
    )


QUERIES = {"op8_license_scan": op8_license_scan}
