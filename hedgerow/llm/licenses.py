"""License scans by conditional compression.

Blocks of words around a cue (license, copyright, ...) are compressed alone and once with each template as a raw Zstandard dictionary.
Templates are ranked by the bytes they save and, in that order, aligned with the block word by word; a match stands only if the wording
differs in at most ``TOLERANCE`` of the template's words and never in a word with a digit. The first that stands wins, unless one ranked lower fits the
same place with fewer differences. Its words are then taken out of the block, which is scanned again until no template stands. A notice of the GNU family that
goes on "or any later version" is reported as ``-or-later``.

Defined cases: null and empty texts have no match; repeated rows are scanned row by row; an empty table gives an empty
result; other columns are ignored; a text of any length is scanned whole, in blocks.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship

#: Short notices by SPDX identifier. A name may have several wordings.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain under CC0 1.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-2.1", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
CUE = r"(?i)licen[cs]|copyright|spdx|warrant|redistribut|public[\W_]+domain|permission|mozilla|\bCC0?\b"
#: Words on either side of a cue, and differing words as a share of the template.
AROUND, TOLERANCE = 24, 0.1
_LATER = re.compile(r"(?i)[\s,(]+or[\s,(]+(?:at\s+your\s+option[\s,)]+)?(?:any\s+)?later(?:\s+versions?)?\b")
_WORD = re.compile(r"[^\W_]+(?:[.\-'/][^\W_]+)*")


@functools.cache
def _engines():
    import zstandard

    plain = zstandard.ZstdCompressor(level=19)
    kinds = [zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in TEMPLATES]
    words = [_WORD.findall(t.lower()) for _, t in TEMPLATES]
    return plain, [zstandard.ZstdCompressor(level=19, dict_data=k) for k in kinds], words


def wording(template: list[str], block: list[str]) -> tuple[int, int, int] | None:
    """(first word, end, differences) of the template's best place in the block; null if it stands nowhere.

    Differences are the template's words that are missing or the words too many, whichever are more. Every place is tried:
    ``row[k]`` is the least number of missing words among the template's first k, against the place's words so far.
    """
    m = len(template)
    most = int(TOLERANCE * m)
    fixed = [any(c.isdigit() for c in w) for w in template]
    lacking = Counter(template) - Counter(block)
    if sum(lacking.values()) > most or any(c.isdigit() for w in lacking for c in w):
        return None
    firsts, never, best = set(template[: most + 1]), m + 1, None
    for i, word in enumerate(block):
        if word not in firsts:
            continue
        row = [0]
        for k in range(m):
            row.append(row[k] + 1 if not fixed[k] and row[k] < most else never)
        for j, w in enumerate(block[i : i + m + most], 1):
            now = [0 if j <= most else never]
            for k in range(1, m + 1):
                v = row[k]
                if template[k - 1] == w:
                    v = min(v, row[k - 1])
                if not fixed[k - 1]:
                    v = min(v, now[k - 1] + 1)
                now.append(v if max(v, j - k + v) <= most else never)
            row = now
            if min(row) == never:
                break
            if row[m] < never:
                found = max(row[m], j - m + row[m]), row[m], j, i
                best = min(best or found, found)
    return best and (best[3], best[3] + best[2], best[0])


def scan(text: str) -> list[tuple[str, int, int, int, int]]:
    """(license, first character, end, differing words, bytes saved) of each notice in the text."""
    found = []
    words = list(_WORD.finditer(text))
    cues = re.compile(CUE)
    starts, ends = [m.start() for m in words], [m.end() for m in words]
    near = {i for i, m in enumerate(words) if cues.search(m[0])}
    for m in cues.finditer(text):  # a cue may have several words
        near.update(range(bisect.bisect_right(ends, m.start()), bisect.bisect_left(starts, m.end())))
    near = sorted(near)
    blocks: list[list[int]] = []
    for i in near:
        a, b = max(0, i - AROUND), min(len(words), i + AROUND + 1)
        if blocks and a <= blocks[-1][1]:
            blocks[-1][1] = b
        else:
            blocks.append([a, b])
    plain, engines, templates = _engines()
    todo = blocks[::-1]
    while todo:
        a, b = todo.pop()
        if b - a < 2 or not any(a <= i < b for i in near):
            continue
        raw = text[words[a].start() : words[b - 1].end()].lower().encode()
        size = len(plain.compress(raw))
        saved = [size - len(e.compress(raw)) for e in engines]
        block = [m[0].lower() for m in words[a:b]]
        best = None
        for k in sorted(range(len(saved)), key=lambda k: -saved[k]):
            at = wording(templates[k], block)
            if at and (best is None or (at[2] < best[1][2] and at[0] < best[1][1] and best[1][0] < at[1])):
                best = k, at
        if best:
            k, (begin, end, differences) = best
            name, last = TEMPLATES[k][0], words[a + end - 1].end()
            later = _LATER.match(text, last) if "GPL" in name else None
            found.append((name + "-or-later" * bool(later), words[a + begin].start(), later.end() if later else last, differences, saved[k]))
            todo += [[a + end, b], [a, a + begin]]
    return sorted(found, key=lambda x: x[1])


def notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each notice found: doc_id, license, start, end (characters), differences (words), saved (bytes)."""
    ship(docs.sparkSession)
    names = ("license", "start", "end", "differences", "saved")

    def run(batches):
        for batch in batches:
            rows = [(i, *x) for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True) for x in scan(t)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "license" else pa.int64()) for k, c in zip(("doc_id", *names), columns, strict=True)], ["doc_id", *names])

    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.where(text.rlike(CUE)).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, license string, start long, end long, differences long, saved long")
