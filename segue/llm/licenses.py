"""License scans by patience alignment against notice texts.

Words are runs of letters and digits, lower-cased. Within a stretch of a text
where a notice may stand, words that occur once in the stretch and once in the
notice are anchors; the longest increasing subsequence of their places is kept,
and the gaps between anchors are aligned the same way, after equal words at
their ends. Coverage is the share of the notice's words that are aligned.

A stretch is a number of words in a row, from a word of the notice to another;
``WIDER`` says how much longer than the notice the widest may be, for words put
in. All stretches of a text count, wherever they begin and end, and the best of
them is what the notice covers; but only those are aligned that could be better
than the best so far. The words that a stretch and the notice have in common,
counted, bound it from above: ends are taken in the order of that bound. So does
the longest common subsequence, which one pass of bit operations from an end to
the left gives for all beginnings. So a notice that is repeated, or whose words
stand before it too, is found as well, and a text of nothing but notices takes
little time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import ids_and_text, table
from ._text import BYTE_CODE, Run, runs, span_hashes

LEAST = 0.75

#: Most words of a stretch, by the notice's words: as many again.
WIDER = 2.0

PLAIN = np.full(256, 32, np.uint8)
PLAIN[48:58] = np.arange(48, 58)
PLAIN[65:91] = PLAIN[97:123] = np.arange(97, 123)
PLAIN[128:] = np.arange(128, 256)

#: Fixed: notices by name, in the words of their publishers; of the long ones the grant and its conditions.
NOTICES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


def increasing(places: list[int]) -> list[int]:
    """Indexes of one longest increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(places)
    for i, x in enumerate(places):
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
            ends.append(i)
        else:
            tails[k], ends[k] = x, i
        before[i] = ends[k - 1] if k else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two word lists, increasing in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        times_a, times_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {w: j for j, w in enumerate(b[b0:b1], b0) if times_b[w] == 1}
        pairs = [(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if times_a[w] == 1 and w in at_b]
        pairs = [pairs[k] for k in increasing([j for _, j in pairs])]
        if pairs:
            found += pairs
            edges = [(a0 - 1, b0 - 1), *pairs, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


class Templates:
    """Notices as lists of word numbers."""

    def __init__(self, notices: dict[str, str]):
        self.names = list(notices)
        run = next(iter(runs(pa.array(list(notices.values()), pa.string()))))
        hashes, first, _, _ = plain_words(run)
        self.vocab = np.unique(hashes)
        number = np.searchsorted(self.vocab, hashes)
        self.words = [number[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        self.counts = np.stack([np.bincount(w, minlength=len(self.vocab)) for w in self.words])
        self.length = self.counts.sum(axis=1)


def plain_words(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = PLAIN[run.data]
    starts, ends, first = run.words(data)
    return (span_hashes(BYTE_CODE[data], starts, ends) if len(starts) else np.empty(0, np.uint64)), first, starts, ends


def widest(n: int) -> int:
    """Most words of the stretches for a notice of n words."""
    return int(n * WIDER) + 2


def common_counts(words: list[int], hits: list[int], have: list[int], width: int) -> list[tuple[int, int, int]]:
    """(words in common, first, last) of the widest stretch at each end, as indexes of ``hits``.

    ``hits`` are the places of the notice's words in the text; ``have`` is how often each is in the notice.
    """
    seen, total, a, out = Counter(), 0, 0, []
    for i, place in enumerate(hits):
        seen[words[place]] += 1
        total += seen[words[place]] <= have[words[place]]
        while hits[a] <= place - width:
            w = words[hits[a]]
            total -= seen[w] <= have[w]
            seen[w] -= 1
            a += 1
        out.append((total, a, i))
    return out


def best_stretch(words: list[int], notice: list[int], hits: list[int], have: list[int], least: int) -> tuple[int, int, int] | None:
    """(words aligned, first, last place) of the best of all stretches, or None where none aligns ``least`` words."""
    n, best, found = len(notice), least - 1, None
    full, masks = (1 << n) - 1, {}
    for j, w in enumerate(notice):
        masks[w] = masks.get(w, 0) | 1 << (n - 1 - j)
    ends = [x for x in common_counts(words, hits, have, widest(n)) if x[0] > best]
    for total, a, i in sorted(ends, key=lambda x: (-x[0], x[2])):
        if total <= best:
            break
        row, common = full, []  # of the notice and the stretch from each beginning, from the end to the left
        for x in range(i, a - 1, -1):
            same = row & masks[words[hits[x]]]
            row = ((row + same) | (row - same)) & full
            common.append(n - row.bit_count())
        for x in range(a, i + 1):
            if common[i - x] <= best:
                break
            lo = hits[x]
            pairs = patience(words[lo : hits[i] + 1], notice)
            if len(pairs) > best:
                best, found = len(pairs), (len(pairs), lo + pairs[0][0], lo + pairs[-1][0])
    return found


def found_notices(words: list[int], t: Templates, which: list[int], least: float) -> list[tuple]:
    """(coverage, words aligned, -notice, first, last) of each notice's best stretch, best first.

    Words that are in no notice have the number -1.
    """
    at: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if w >= 0:
            at.setdefault(w, []).append(i)
    out = []
    for k in which:
        notice = t.words[k]
        n = len(notice)
        hits = sorted(i for w in set(notice) for i in at.get(w, ()))
        best = best_stretch(words, notice, hits, t.counts[k].tolist(), max(1, ceil(least * n - 1e-9)))
        if best:
            out.append((best[0] / n, best[0], -k, best[1], best[2]))
    return sorted(out, reverse=True)


def _scan(notices: dict[str, str], least: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates(notices)
        for batch in batches:
            for run in runs(batch.column("text")):
                hashes, first, starts, ends = plain_words(run)
                spot = np.minimum(np.searchsorted(t.vocab, hashes), len(t.vocab) - 1)
                hit = t.vocab[spot] == hashes
                row = np.repeat(np.arange(run.rows), np.diff(first))
                counts = np.zeros((run.rows, len(t.vocab)), np.int32)
                np.add.at(counts, (row[hit], spot[hit]), 1)
                common = np.stack([np.minimum(counts, c).sum(axis=1) for c in t.counts], axis=1)
                may = common >= least * t.length
                found: list = [None] * run.rows
                number = np.where(hit, spot, -1)
                for r in np.flatnonzero(may.any(axis=1)).tolist():
                    words = number[first[r] : first[r + 1]].tolist()
                    found[r] = found_notices(words, t, np.flatnonzero(may[r]).tolist(), least)
                names_found = [[t.names[-x[2]] for x in some or ()] for some in found]
                cells = [[y(r, x[0]) if x else None for r, x in enumerate(found)] for y in (
                    lambda r, x: t.names[-x[2]], lambda r, x: x[0], lambda r, x: x[1], lambda r, x: x[3], lambda r, x: x[4],
                    lambda r, x: run.data[starts[first[r] + x[3]] : ends[first[r] + x[4]]].tobytes().decode("utf-8", "replace"),
                )]
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                names = ["license", "coverage", "n_aligned", "first_word", "last_word", "found_text"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(run.first, run.rows), *(pa.array(c, k) for c, k in zip(cells, kinds, strict=True)), pa.array(names_found, pa.list_(pa.string()))], ["doc_id", *names, "licenses"])

    return work


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """One row per input row: doc_id, license, coverage, n_aligned, first_word, last_word, found_text, licenses.

    licenses names all notices that reach ``least`` somewhere in the text, the
    best first; none where none does. The other columns tell of the notice with the highest coverage, of equals the longest, then the first
    by order; all null where none reaches ``least``, as for null and empty
    texts. Of equally good stretches of a notice one is told, the same on every
    run. Whole texts are scanned; rows are scanned each for themselves, so
    repeated rows come out as often as they came in. Other columns aren't read.
    """
    schema = "doc_id long, license string, coverage double, n_aligned long, first_word long, last_word long, found_text string, licenses array<string>"
    return ids_and_text(docs, id_col, text_col).mapInArrow(_scan(notices or NOTICES, least), schema)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLE: dict[str, str] = {}
