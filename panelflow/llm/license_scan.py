"""License scans by patience alignment.

The words of a text meet the words of each template: words that occur once in
both are anchors, the longest increasing subsequence of their places is kept,
and the gaps between anchors are aligned the same way.  Coverage is the share of
the template's words so matched, in order.

A text may hold several notices, so the alignment runs in regions.  A notice
takes up to its template's length and ``SLACK`` of it twice; regions are wider by
a step and begin at every step, so each such notice lies whole in one.  Those
that cannot reach the coverage are left out: as it lets few of the template's
words be missing, one of the longest words that together occur more often than
that (the seeds) is in every notice, and so are enough of its words in any
order.  All other regions are aligned, each also without its end, where a second
notice may begin.  If the words before or behind a gap of more than ``SLACK`` reach
the coverage alone, only they are the find.  Of overlapping finds of one template the best stays.

Defined results: null and empty texts have no finds; so has a template without
words.  Repeated rows are scanned each; further columns are ignored unless
carried; empty tables give no finds.  Whole texts are scanned, however long.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
SLACK = 0.3
_WORD = re.compile(r"[^\W_]+")

#: Public notices of common licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "all-rights-reserved": ["All rights reserved"],
}


def words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words and their spans in the text."""
    found = list(_WORD.finditer(text))
    return [m.group().lower() for m in found], [m.span() for m in found]


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(template: list[str], text: list[str]) -> list[tuple[int, int]]:
    """Matched (template, text) places, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(template), 0, len(text))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and template[a] == text[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once = {w for w, n in Counter(template[a:b]).items() if n == 1}
        seen = Counter(text[c:d])
        once = {w for w in once if seen[w] == 1}
        at = {w: i for i, w in enumerate(text[c:d], c) if w in once}
        anchors = [(i, at[w]) for i, w in enumerate(template[a:b], a) if w in once]
        anchors = [anchors[i] for i in increasing([j for _, j in anchors])]
        if not anchors:
            continue
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        out += anchors
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    def __init__(self, license: str, text: str) -> None:
        self.license = license
        self.words, _ = words(text)
        self.counts = Counter(self.words)
        self.step = max(1, max(2, int(SLACK * len(self.words))) // 2)
        self.width = len(self.words) + 2 * max(2, int(SLACK * len(self.words))) + self.step

    def seeds(self, least: float) -> list[str]:
        """The longest words, one of which is in every notice with the coverage ``least``."""
        spare = len(self.words) - math.ceil(least * len(self.words))
        out = []
        for w in sorted(self.counts, key=lambda w: (-len(w), w)):
            if spare < 0:
                break
            out.append(w)
            spare -= self.counts[w]
        return out

    def shared(self, counts: Counter) -> int:
        """Words of the template that a text with these words can match at most."""
        return sum(min(n, counts[w]) for w, n in self.counts.items() if w in counts)


def finds(text: str | None, templates: list[Template], least: float = COVERAGE,
          seeds: list[list[str]] | None = None) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, start, end, matched words) of every notice in the text; ``seeds`` of each template, if they are at hand."""
    if not text:
        return []
    low = text.lower()
    seeds = [t.seeds(least) for t in templates] if seeds is None else seeds
    likely = [(t, own) for t, own in zip(templates, seeds) if t.words and any(k in low for k in own)]
    if not likely:
        return []
    ws, spans = words(text)
    counts = Counter(ws)
    likely = [(t, own) for t, own in likely if t.shared(counts) >= least * len(t.words)]
    places: dict[str, list[int]] = {}
    wanted = {k for _, own in likely for k in own}
    for i, w in enumerate(ws):
        if w in wanted:
            places.setdefault(w, []).append(i)
    out = []
    for t, keys in likely:
        size = len(t.words)
        starts = {k * t.step for w in keys for p in places.get(w, ()) for k in range(max(0, (p - t.width) // t.step + 1), p // t.step + 1)}
        tried = set()
        own = []
        for s in sorted(starts):
            if t.shared(Counter(ws[s : s + t.width])) < least * size:
                continue
            for lo, hi in ((s, min(len(ws), s + t.width)), (s, min(len(ws), s + size + 2 * t.step))):
                while lo < hi and ws[lo] not in t.counts:
                    lo += 1
                while lo < hi and ws[hi - 1] not in t.counts:
                    hi -= 1
                if (lo, hi) in tried:
                    continue
                tried.add((lo, hi))
                got = patience(t.words, ws[lo:hi])
                cuts = [i for i in range(1, len(got)) if got[i][1] - got[i - 1][1] > 2 * t.step + 1]
                core = max((got[i:k] for i, k in zip([0, *cuts], [*cuts, len(got)])), key=len)
                got = core if len(core) >= least * size else got
                if got and len(got) >= least * size:
                    own.append((len(got) / size, len(got), lo + got[0][1], lo + got[-1][1]))
        used: list[tuple[int, int]] = []
        for cover, n, a, b in sorted(own, key=lambda x: (-x[0], x[3] - x[2], x[2])):
            if all(b < c or a > d for c, d in used):
                used.append((a, b))
                out.append((t.license, cover, spans[a][0], spans[b][1], n))
    return sorted(out, key=lambda x: (x[2], x[0], x[3]))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, carry: list[str] | None = None, least: float = COVERAGE,
         text_col: str = "text") -> DataFrame:
    """Columns ``carry`` with license, coverage, start, end (code points) and matched words; one row per notice."""
    known = [Template(name, t) for name, ts in (templates or TEMPLATES).items() for t in ts]
    seeds = [t.seeds(least) for t in known]
    carry = ["doc_id"] if carry is None else carry
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text_col).cast("string").alias("text__"))
    kinds = (("license", "string", pa.string()), ("coverage", "double", pa.float64()), ("start", "long", pa.int64()),
             ("end", "long", pa.int64()), ("matched", "long", pa.int64()))
    schema = rows.drop("text__").schema
    for name, kind, _ in kinds:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            at, out = [], []
            for i, text in enumerate(batch.column(last).to_pylist()):
                got = finds(text, known, least, seeds)
                at += [i] * len(got)
                out += got
            columns = list(zip(*out)) or [()] * len(kinds)
            taken = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(last)]
            yield pa.RecordBatch.from_arrays([*taken, *[pa.array(c, kind) for c, (_, _, kind) in zip(columns, kinds)]], names=[*carry, *[k[0] for k in kinds]])

    return rows.mapInArrow(run, schema)
