"""License scans: MinHash bands over text windows retrieve templates, shingle containment verifies them.

Texts are lower-cased, ASCII punctuation counts as white space, and runs of words (shingles) are hashed: five
words, or two for templates of fewer than LONG_WORDS, which have too few of five. Windows of shingles overlap,
so that at least one lies wholly inside any occurrence of a template that is long enough for them; templates are
cut into windows at every offset, so that it meets one in line. A window's ROWS * BANDS min-hashes collide with
those of a template's window of Jaccard similarity J in some band with probability 1 - (1 - J**ROWS)**BANDS:
over 0.997 at J = 0.67, which a containment of 0.8 leaves in windows of equal length; equal windows always
collide. Each retrieved place is then verified: the share of the template's shingles that the text holds there.
Of places of one license that lie in each other only the widest is given.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import map_rows, utf8

#: Words of a shingle, and of that of templates with fewer than LONG_WORDS words.
SHINGLE_WORDS, SHORT_WORDS = 5, 2
LONG_WORDS = 9
CONTAINMENT = 0.8
ROWS, BANDS = 2, 10
#: For each size of shingles: shingles of a window, between the starts of two, and the fewest of a template that uses them.
WINDOWS = {SHORT_WORDS: ((1, 1, 1), (2, 1, 2), (4, 1, 4)), SHINGLE_WORDS: ((4, 2, 5), (32, 16, 47))}
SEED = 5
#: Shingles whose min-hashes are computed at once, and words whose hashes a worker remembers.
STEP = 1 << 15
REMEMBERED = 400_000
#: Words of texts that are scanned together, and bits of the table that tells most keys from known ones.
GROUP_WORDS = 1 << 17
SLOT_BITS = 18

# Names, notices and opening passages of licenses, by license and form.
TEMPLATES = {
    "all-rights-reserved:notice": "All rights reserved.",
    "MIT:name": "MIT License",
    "MIT:tag": "SPDX-License-Identifier: MIT",
    "Apache-2.0:name": "Apache License, Version 2.0",
    "Apache-2.0:short name": "Apache License 2.0",
    "Apache-2.0:tag": "SPDX-License-Identifier: Apache-2.0",
    "GPL-2.0:name": "GNU General Public License, version 2",
    "GPL-2.0:short name": "GNU GPL v2",
    "GPL-2.0:tag": "SPDX-License-Identifier: GPL-2.0",
    "GPL-3.0:name": "GNU General Public License, version 3",
    "GPL-3.0:short name": "GNU GPL v3",
    "GPL-3.0:tag": "SPDX-License-Identifier: GPL-3.0",
    "GPL-3.0:line": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1:name": "GNU Lesser General Public License, version 2.1",
    "LGPL-2.1:tag": "SPDX-License-Identifier: LGPL-2.1",
    "LGPL-3.0:name": "GNU Lesser General Public License, version 3",
    "LGPL-3.0:tag": "SPDX-License-Identifier: LGPL-3.0",
    "AGPL-3.0:name": "GNU Affero General Public License, version 3",
    "AGPL-3.0:tag": "SPDX-License-Identifier: AGPL-3.0",
    "BSD-2-Clause:name": "BSD 2-Clause License",
    "BSD-2-Clause:other name": "Simplified BSD License",
    "BSD-2-Clause:tag": "SPDX-License-Identifier: BSD-2-Clause",
    "BSD-3-Clause:name": "BSD 3-Clause License",
    "BSD-3-Clause:other name": "New BSD License",
    "BSD-3-Clause:tag": "SPDX-License-Identifier: BSD-3-Clause",
    "ISC:name": "ISC License",
    "ISC:tag": "SPDX-License-Identifier: ISC",
    "MPL-2.0:name": "Mozilla Public License, version 2.0",
    "MPL-2.0:short name": "Mozilla Public License 2.0",
    "MPL-2.0:tag": "SPDX-License-Identifier: MPL-2.0",
    "EPL-2.0:name": "Eclipse Public License 2.0",
    "EPL-2.0:long name": "Eclipse Public License, version 2.0",
    "EPL-2.0:tag": "SPDX-License-Identifier: EPL-2.0",
    "Unlicense:tag": "SPDX-License-Identifier: Unlicense",
    "Zlib:name": "zlib License",
    "BSL-1.0:name": "Boost Software License, version 1.0",
    "CC0-1.0:name": "CC0 1.0 Universal",
    "CC0-1.0:tag": "SPDX-License-Identifier: CC0-1.0",
    "CC-BY-4.0:code": "CC BY 4.0",
    "CC-BY-SA-4.0:code": "CC BY-SA 4.0",
    "CC-BY-NC-4.0:code": "CC BY-NC 4.0",
    "CC-BY-ND-4.0:code": "CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0:code": "CC BY-NC-SA 4.0",
    "CC-BY-4.0:name": "Creative Commons Attribution 4.0 International",
    "CC-BY-SA-4.0:name": "Creative Commons Attribution-ShareAlike 4.0 International",
    "CC-BY-NC-4.0:name": "Creative Commons Attribution-NonCommercial 4.0 International",
    "CC-BY-4.0:line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0:line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0:line": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MIT:text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "BSD-2-Clause:text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause:third clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "Apache-2.0:notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-2.0:notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0:notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1:notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0:notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC:text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0:notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0:notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/"
    ),
    "Unlicense:text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib:text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ),
    "BSL-1.0:text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software'
    ),
}

_SPACES = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words in lower case; both spellings of license count as one."""
    return utf8(text).lower().translate(_SPACES).replace(b"licenc", b"licens").split()


class _Words(dict):
    """Hashes of words, remembered up to REMEMBERED."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


_WORDS = _Words()


def hashes_of(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, parts), np.uint64, len(parts))


def shingles(own: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all runs of size words, repeats included: sums of the words' hashes times powers of an odd number, mixed."""
    n = len(own) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += own[k : k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


@lru_cache(maxsize=1)
def _factors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 31, (BANDS, ROWS, 2), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def band_keys(hashes: np.ndarray, windows: list[tuple[int, int]], filler: np.ndarray | None = None) -> list[np.ndarray]:
    """For each (size, stride), sizes being rising powers of two: (BANDS, windows) keys of its windows.

    Min-hashes have 32 bits; a band's key holds those of its two rows. filler marks places that no min-hash takes.
    """
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    counts = [max(0, (len(low) - size) // stride + 1) for size, stride in windows]
    out = [np.zeros((BANDS, n), np.uint64) for n in counts]
    for band in range(BANDS):
        for row in range(ROWS):
            mul, add = _factors()[band, row]
            x = low * mul
            x ^= x >> np.uint32(15)
            x *= add
            if filler is not None:
                x[filler] = 0xFFFFFFFF
            width = 1
            for (size, stride), keys, n in zip(windows, out, counts, strict=True):
                while width < size and n:  # minima over windows, doubled until they are as long as wanted
                    x = np.minimum(x[: len(x) - width], x[width:])
                    width *= 2
                keys[band] = (keys[band] << np.uint64(32)) | x[::stride][:n]
    return out


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


class Scanner:
    """The index of the templates; finds their places in texts."""

    def __init__(self, templates: dict[str, str] | None = None):
        given = TEMPLATES if templates is None else templates
        self.names = list(given)
        parts = [words(given[n]) for n in self.names]
        if any(len(p) < SHORT_WORDS for p in parts):
            raise ValueError(f"a template needs {SHORT_WORDS} words or more")
        self.lengths = [len(p) for p in parts]
        self.sizes = [SHINGLE_WORDS if n >= LONG_WORDS else SHORT_WORDS for n in self.lengths]
        self.sets = [np.unique(shingles(hashes_of(p), size)) for p, size in zip(parts, self.sizes, strict=True)]
        self.tables: dict[int, list[dict[int, set[int]]]] = {size: [defaultdict(set) for _ in w] for size, w in WINDOWS.items()}
        for i, (p, size) in enumerate(zip(parts, self.sizes, strict=True)):
            runs = shingles(hashes_of(p), size)
            at = max(w for w, (_, _, least) in enumerate(WINDOWS[size]) if len(runs) >= least)
            for key in band_keys(runs, [(WINDOWS[size][at][0], 1)])[0].ravel().tolist():
                self.tables[size][at][key].add(i)
        #: Which slots of a small table hold a known key; most keys fall into none.
        self.slots = {size: [np.zeros(1 << SLOT_BITS, bool) for _ in tables] for size, tables in self.tables.items()}
        for size, tables in self.tables.items():
            for slots, table in zip(self.slots[size], tables, strict=True):
                slots[_slots(np.array(list(table), np.uint64))] = True

    def candidates(self, texts: list[np.ndarray], size: int = SHINGLE_WORDS) -> list[dict[int, list[int]]]:
        """Of each text, given as its shingles: where windows start that collide with each template with shingles of that size.

        Texts are put together with filler between them, so that no window spans two and each starts where windows do.
        """
        found: list[dict[int, set[int]]] = [defaultdict(set) for _ in texts]
        used = [w for w in range(len(WINDOWS[size])) if self.tables[size][w]]
        if not used:
            return [{} for _ in texts]
        longest, grid = max(WINDOWS[size][w][0] for w in used), max(stride for _, stride, _ in WINDOWS[size])
        lengths = np.array([len(t) for t in texts])
        rooms = -(-(lengths + longest) // grid) * grid
        starts = np.cumsum(rooms) - rooms
        whole, filler = np.zeros(int(rooms.sum()), np.uint64), np.ones(int(rooms.sum()), bool)
        for t, at in zip(texts, starts.tolist(), strict=True):
            whole[at : at + len(t)] = t
            filler[at : at + len(t)] = False
        for first in range(0, len(whole), STEP):  # a multiple of all strides
            part = slice(first, first + STEP + longest - 1)
            for w, keys in zip(used, band_keys(whole[part], [WINDOWS[size][w][:2] for w in used], filler[part]), strict=True):
                bands, at = np.nonzero(self.slots[size][w][_slots(keys)])
                table, stride = self.tables[size][w], WINDOWS[size][w][1]
                for band, k in zip(bands.tolist(), at.tolist(), strict=True):
                    for i in table.get(int(keys[band, k]), ()):
                        place = first + k * stride
                        text = int(np.searchsorted(starts, place, "right")) - 1
                        found[text][i].add(place - int(starts[text]))
        return [{i: sorted(s) for i, s in f.items()} for f in found]

    def verified(self, runs: np.ndarray, i: int, starts: list[int] | None) -> list[tuple[str, float, int, int]]:
        """The places of a template that hold enough of its shingles, near a start; everywhere where starts is none."""
        size, out = self.sizes[i], []
        hits = np.flatnonzero(np.isin(runs, self.sets[i]))
        if not len(hits):
            return out
        # places are runs of hits without a gap of half a template; adjoining copies are one place
        for place in np.split(hits, np.flatnonzero(np.diff(hits) > max(size, self.lengths[i] // 2)) + 1):
            share = len(np.unique(runs[place])) / len(self.sets[i])
            if share >= CONTAINMENT and (starts is None or any(place[0] - self.lengths[i] <= at <= place[-1] for at in starts)):
                out.append((self.names[i], round(share, 6), int(place[0]), int(place[-1]) + size))
        return out

    def many(self, texts: list[str | None], exhaustive: bool = False) -> list[list[tuple[str, float, int, int]]]:
        """(name, containment, first word, end word) of each verified place of each text, by place.

        exhaustive: verifies every template everywhere, without retrieval; for tests.
        """
        out: list[list[tuple[str, float, int, int]]] = []
        group: list[np.ndarray] = []
        room = GROUP_WORDS
        for text in texts:
            group.append(hashes_of(words(text)))
            room -= len(group[-1])
            if room <= 0:
                out += self._group(group, exhaustive)
                group, room = [], GROUP_WORDS
        return out + self._group(group, exhaustive)

    def scan(self, text: str | None, exhaustive: bool = False) -> list[tuple[str, float, int, int]]:
        return self.many([text], exhaustive)[0]

    def _group(self, group: list[np.ndarray], exhaustive: bool) -> list[list[tuple[str, float, int, int]]]:
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in group]
        for size in WINDOWS:
            runs = [shingles(own, size) for own in group]
            every = {i: None for i, s in enumerate(self.sizes) if s == size}
            asked = [every] * len(runs) if exhaustive else self.candidates(runs, size)
            for rows, own, found in zip(out, runs, asked, strict=True):
                for i, starts in found.items():
                    rows += self.verified(own, i, starts)
        return [_widest(rows) for rows in out]


def _widest(rows: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
    """The rows without those of a license that lie in another one of it."""
    widest: dict[str, list[tuple[str, float, int, int]]] = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[2], -r[3], r[0])):  # what lies in a place comes after it
        kept = widest[row[0].split(":")[0]]
        if not kept or row[3] > kept[-1][3]:
            kept.append(row)
    return sorted((r for kept in widest.values() for r in kept), key=lambda r: (r[2], r[3], r[0]))


def _scan(templates: dict[str, str] | None):
    scanner = Scanner(templates)

    def step(ids: list, texts: list) -> list[tuple]:
        return [(i, name.split(":")[0], name.partition(":")[2] or None, *rest) for i, found in zip(ids, scanner.many(texts), strict=True) for name, *rest in found]

    return step


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, form, containment, start_word, end_word): one row for each verified place.

    Templates are named license:form. Words are counted with punctuation as white space; end_word is exclusive.
    Texts without a license, null and empty ones among them, give no row; long texts are scanned whole, in steps.
    Null ids and repeated rows are each scanned; places that tie are ordered by name. Other columns, whatever
    their names, are not read. An empty table, or no templates, gives an empty result. The templates travel with
    the function; nothing is shuffled. A template needs two words or more.
    """
    Scanner(templates)  # raises here rather than in a task
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, license string, form string, containment double, start_word long, end_word long"
    return map_rows(picked, ["doc_id", "text"], _scan, schema, (templates,))
