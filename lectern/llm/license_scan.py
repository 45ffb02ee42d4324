"""License scans by conditional compression.

Every template is looked for by its words, anywhere in a text and whatever the line breaks. A
wording with few differing words holds one of some pieces of its template unchanged; a window of
the template's size around each such piece is a candidate. Each candidate is compressed alone and
with its template as zstandard raw dictionary, and candidates are ranked by the bytes saved,
relative to the template's own size. In this order an alignment finds each one's span and the
exact words in which it differs. Of inexact wordings over the same words the best ranked one
stays; no floor and no cap leaves a candidate unconfirmed.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import blocks
from .workers import hold, mapped

#: Wordings of public licenses. Angle brackets hold what each work fills in.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD": (
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "proprietary": ("All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}

CUES = re.compile(rb"licen[sc]e|copyright|redistribut|warrant|permission|all rights reserved|public domain|proprietary", re.IGNORECASE)
_WORDS = re.compile(r"[^\W_]+")
#: A line near a cue joins its block if at least this share of its words is in the templates.
KINDRED = 0.7
#: Most differing words, as a share of the template's words, in a confirmed span.
TOLERANCE = 0.1
_STRETCH = 128


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


class Templates:
    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.all = [(name, part, text, words(text)) for name, texts in templates.items() for part, text in enumerate(texts)]
        self.known = {w for *_, ws in self.all for w in ws}
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        parameters = zstandard.ZstdCompressionParameters.from_level(9, format=zstandard.FORMAT_ZSTD1_MAGICLESS, **plain)
        self.alone = zstandard.ZstdCompressor(compression_params=parameters)
        self.given = [zstandard.ZstdCompressor(compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, _, text, _ in self.all]
        self.sizes = [len(self.alone.compress(text.lower().encode())) for _, _, text, _ in self.all]
        self.most = [int(TOLERANCE * len(ws)) for *_, ws in self.all]
        #: One piece more than words may differ, so that one of them is in the span unchanged: (template, first word, text).
        self.pieces = []
        for k, (*_, ws) in enumerate(self.all):
            cuts = [len(ws) * i // (self.most[k] + 1) for i in range(self.most[k] + 2)]
            self.pieces += [(k, a, f" {' '.join(ws[a:b])} ") for a, b in zip(cuts, cuts[1:], strict=False)]
        #: Words one of which every piece holds.
        self.gates = sorted({max(piece.split(), key=len) for _, _, piece in self.pieces})
        self.reduction = lru_cache(maxsize=20_000)(self._reduction)
        self.aligned = lru_cache(maxsize=20_000)(self._aligned)

    def _reduction(self, k: int, span: str) -> float:
        data = span.lower().encode()
        return 1 - len(self.given[k].compress(data)) / len(self.alone.compress(data))

    def gain(self, k: int, window: str) -> float:
        """Bytes that template ``k`` saves in a candidate window, relative to the template's own size."""
        data = window.lower().encode()
        return (len(self.alone.compress(data)) - len(self.given[k].compress(data))) / self.sizes[k]

    def _aligned(self, k: int, said: tuple[str, ...]) -> tuple[int, int, tuple[str, ...]] | None:
        """First and end word in ``said`` of the closest wording of template ``k``, and the differing words: '-' those it lacks, '+' others in it. Equally close ones: the earliest end, then the latest start. None if too many differ."""
        template = self.all[k][3]
        n = len(template)
        # cost[j]: fewest differing words between the template's first j words and some stretch that ends here, with minus its start.
        rows = [[(j, 0) for j in range(n + 1)]]
        for i, w in enumerate(said, 1):
            above, row = rows[-1], [(0, -i)]
            for j in range(1, n + 1):
                best = min((above[j][0] + 1, above[j][1]), (row[j - 1][0] + 1, row[j - 1][1]))
                if template[j - 1] == w:
                    best = min(best, above[j - 1])
                row.append(best)
            rows.append(row)
        end = min(range(len(rows)), key=lambda i: (rows[i][n][0], i))
        if rows[end][n][0] > self.most[k]:
            return None
        i, j, wrong = end, n, []
        while j:
            here = rows[i][j]
            if i and template[j - 1] == said[i - 1] and rows[i - 1][j - 1] == here:
                i, j = i - 1, j - 1
            elif (rows[i][j - 1][0] + 1, rows[i][j - 1][1]) == here:
                j -= 1
                wrong.append(f"-{template[j]}")
            else:
                i -= 1
                wrong.append(f"+{said[i]}")
        return i, end, tuple(wrong[::-1])

    def found(self, text: str) -> list[tuple[str, float, str, int, int]]:
        """License, reduction, differing words, start and end in code points of every template's wordings, by start.

        Wordings of one template do not overlap: closer ones first. One with differing words is left out
        where an exact or better ranked one of another template has more than half of its words, so that
        an LGPL notice is not also a GPL notice with a word too many.
        """
        low = text.lower()
        if not any(g in low for g in self.gates):
            return []
        places = [(m[0].lower(), m.start(), m.end()) for m in _WORDS.finditer(text)]
        said = [w for w, _, _ in places]
        line = f" {' '.join(said)} "
        windows = set()
        for k, first, piece in self.pieces:
            n, most = len(self.all[k][3]), self.most[k]
            at, counted, word = line.find(piece), 0, 0
            while at >= 0:
                word += line.count(" ", counted, at)
                counted = at
                windows.add((k, max(0, word - first - most), min(len(said), word - first + n + most)))
                at = line.find(piece, at + 1)
        ranked = sorted((-self.gain(k, text[places[a][1] : places[b - 1][2]]), k, a, b) for k, a, b in windows)
        hits: dict[tuple[float, int, int, int, tuple[str, ...]], float] = {}
        for low, k, a, b in ranked:
            if match := self.aligned(k, tuple(said[a:b])):
                hits.setdefault((len(match[2]) / len(self.all[k][3]), k, a + match[0], a + match[1], match[2]), low)
        single = _apart(sorted(hits), lambda s, hit: s[1] == hit[1])
        order = sorted(single, key=lambda hit: (hit[0] > 0, hits[hit], hit))
        sound = _apart(order, lambda s, hit: hit[0] > 0 and (s[0] == 0 or hits[s] < hits[hit]), share=2)
        out = []
        for _, k, a, b, wrong in sorted(sound, key=lambda s: (s[2], s[1])):
            start, end = places[a][1], places[b - 1][2]
            out.append((self.all[k][0], self.reduction(k, text[start:end]), " ".join(wrong), start, end))
        return out


def _apart(hits: list, clash: Callable[..., bool], share: int | None = None) -> list:
    """The hits, in order, without those that clash with a former one over some of their words, or with ``share`` over more than that part of them."""
    out, near = [], defaultdict(list)  # near: the same by stretches of words
    for hit in hits:
        _, _, a, b, _ = hit
        stretches = range(a // _STRETCH, b // _STRETCH + 1)
        shared = [(s, min(b, s[3]) - max(a, s[2])) for q in stretches for s in near[q]]
        if not any(n * (share or b - a + 1) > b - a and clash(s, hit) for s, n in shared):
            out.append(hit)
            for q in stretches:
                near[q].append(hit)
    return out


def candidate_blocks(text: bytes, known: set[str]) -> list[tuple[int, int]]:
    """Byte spans of blocks that may hold notices, also of licenses without a template: runs of lines with a cue or, next to one, of kindred words."""
    if not CUES.search(text):
        return []
    ends = [m.start() for m in re.finditer(b"\n", text)] + [len(text)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    cued = np.unique(np.searchsorted(ends, [m.start() for m in CUES.finditer(text)])).tolist()
    has_cue = set(cued)

    def kindred(k: int) -> bool:
        own = words(text[starts[k] : ends[k]].decode(errors="replace"))
        return bool(own) and sum(w in known for w in own) >= KINDRED * len(own)

    out: list[tuple[int, int]] = []
    done = -1
    for k in cued:
        if k <= done:
            continue
        first = last = k
        while first - 1 > done and kindred(first - 1):
            first -= 1
        while last + 1 < len(ends) and (last + 1 in has_cue or kindred(last + 1)):
            last += 1
        done = last
        out.append((starts[first], ends[last]))
    return out


def compiled() -> Templates:
    return hold("licenses", None, lambda: Templates(TEMPLATES))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key, n_blocks, n_confirmed, license, reduction, differences, spans``.

    ``n_blocks`` counts candidate blocks, ``n_confirmed`` confirmed wordings of templates.
    ``license`` is the one of largest reduction ('' without one), ``reduction`` its share of bytes
    saved, ``differences`` its differing words, ``spans`` all confirmed wordings as
    license:start:end in code points. Null and empty texts hold none; equal reductions go by
    start, then by the order of templates. Rows are independent; other columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_blocks", "n_confirmed", "license", "reduction", "differences", "spans"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = compiled()
        for batch in batches:
            rows = []
            for block in blocks(batch.column(1)):
                for d in range(len(block)):
                    data = block.text(d)
                    sound = templates.found(data.decode())
                    best = max(sound, key=lambda x: x[1], default=("", 0.0, "", 0, 0))
                    spans = ",".join([f"{name}:{a}:{b}" for name, _, _, a, b in sound])
                    rows.append((len(candidate_blocks(data, templates.known)), len(sound), best[0], round(best[1], 6), best[2], spans))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    return mapped(docs.select(F.col(key), F.col(text).cast("string")), run, f"`{key}` {kind}, n_blocks long, n_confirmed long, license string, reduction double, differences string, spans string", "licenses")
