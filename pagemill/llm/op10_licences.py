"""Licence scan: winnowed fingerprints pick candidates, banded alignment confirms them.

Every template's word k-grams are hashed and winnowed (the smallest hash of each
window); an inverted index maps fingerprints to (template, place). Documents are
fingerprinted alike, over whole texts; hits of one template that follow each other in
both are chained over neighbouring diagonals, so words put into or left out of a
template do not split it; an unaltered stretch of fewer than ``K + WINDOW - 1`` words that long
insertions cut off may have no fingerprint and is then left out. For each chain an alignment of the template's words with the
document's, within a band around all its diagonals, gives the matched share of the
template (coverage) and the span of characters. What reaches ``coverage`` is a match;
a smaller share is reported if asked for. The index has the size of the template set.

Nulls: a null text is empty and has no match. Of overlapping matches of one span
the one that reaches the coverage stays, then the one that matches more words; ties go
to the template listed first. Very long texts are read whole, in time proportional to
their length and their chains. Repeated rows count each; an empty table gives no rows.
Extra columns stay in ``scan``, but for one named ``licences``, which is replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm import words
from pagemill.llm.common import table

K, WINDOW, BAND, COVERAGE = 3, 3, 8, 0.75

#: Published notices and opening terms of licences.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}

#: Between words: ASCII other than letters and digits.
_GAP = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = words.raw(texts)
    starts, ends = words.bounds(data, offsets, _GAP)
    return words.hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets), data


def winnow(gram: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the rightmost smallest hash of each window; of the smallest of all if there are fewer."""
    n = len(gram)
    if not n:
        return np.zeros(0, np.int64)
    w = min(window, n)
    view = np.lib.stride_tricks.sliding_window_view(gram[::-1], w)
    return np.unique(n - 1 - (np.arange(len(view)) + view.argmin(axis=1)))


@lru_cache(maxsize=1)
def _index(items: tuple[tuple[str, str], ...]):
    """(template words, sorted fingerprints, their template, their place)."""
    bodies, prints, owner, place = [], [], [], []
    for t, (_, body) in enumerate(items):
        h = _words(pa.array([body]))[0]
        bodies.append(h)
        gram = words.grams(h, K)
        at = winnow(gram)
        prints.append(gram[at])
        owner.append(np.full(len(at), t))
        place.append(at)
    key = np.concatenate(prints)
    order = np.argsort(key, kind="stable")
    return bodies, key[order], np.concatenate(owner)[order], np.concatenate(place)[order]


def align(template: np.ndarray, doc: np.ndarray, shift: int, band: int = BAND, more: int = 0) -> tuple[int, int, int]:
    """Most words in common, in order, of the template and ``doc`` within ``band`` of the diagonals from ``shift`` to ``shift + more``; (matched, first, end) in ``doc``.

    Row by row over the template; cell j of a row is the document's word i + shift + j - band.
    Of equally many matches the shortest span counts.
    """
    m, n = len(template), len(doc)
    width = 2 * band + 1 + more
    if shift >= 0 and shift + m <= n and np.array_equal(doc[shift : shift + m], template):
        return m, shift, shift + m
    better = lambda c: (c[0], c[1] - c[2])
    best = [(0, 0, -1)] * (width + 1)  # cell: matched, first, last
    found = (0, 0, -1)
    words_of = doc.tolist()
    for i, word in enumerate(template.tolist()):
        row = []
        left = (0, 0, -1)
        for j in range(width):
            at = i + shift + j - band
            cell = best[j + 1] if best[j + 1][0] > left[0] else left if left[0] > best[j + 1][0] else max(best[j + 1], left, key=better)
            if 0 <= at < n and words_of[at] == word:
                before = best[j]
                hit = (before[0] + 1, before[1] if before[0] else at, at)
                if better(hit) > better(cell):
                    cell = hit
            row.append(cell)
            left = cell
        best = [*row, (0, 0, -1)]
        found = max(found, *row, key=better)
    return found[0], found[1], found[2] + 1


def chains(hits: list[tuple[int, int, int]], lengths: list[int]) -> list[tuple[int, int, int]]:
    """(template, least diagonal, greatest) of hits (template, place in it, place in the document), chained.

    A hit goes on with its template's chain if it lies further on in both, no more than
    the template's length further in the document.
    """
    out: list[list[int]] = []
    open_: dict[int, list[list[int]]] = {}
    for t, q, p in sorted(hits, key=lambda x: (x[2], x[1], x[0])):
        # a template's chains that are still near are few
        going = [c for c in open_.get(t, ()) if p - c[4] <= max(lengths[t], 4 * BAND)]
        fit = [c for c in going if q > c[3] and p > c[4] or (q, p) == (c[3], c[4])]
        if fit:
            # the chain whose last diagonal is the nearest
            best = min(fit, key=lambda c: abs((p - q) - (c[4] - c[3])))
            best[1], best[2], best[3], best[4] = min(best[1], p - q), max(best[2], p - q), q, p
        else:
            best = [t, p - q, p - q, q, p]
            out.append(best)
            going.append(best)
        open_[t] = going
    return list(dict.fromkeys((t, a, b) for t, a, b, _, _ in out))


def matches(texts: pa.Array, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, least: float | None = None) -> list[list[tuple[int, int, int, float]]]:
    """For each text its (start, end, template number, coverage), by start, in characters; those below ``coverage`` from ``least`` on."""
    bodies, key, owner, place = _index(tuple(templates.items()))
    h, starts, ends, first, data = _words(texts)
    bounds = words.raw(texts)[1]
    lengths = [len(b) for b in bodies]
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(len(texts))]
    gram = words.grams(h, K)
    hit = np.flatnonzero(np.isin(gram, key))
    for d in np.unique(np.searchsorted(first, hit, side="right") - 1):
        a, b = int(first[d]), int(first[d + 1])
        own = gram[a : max(a, b - K + 1)]
        at = winnow(own)
        left, right = np.searchsorted(key, own[at]), np.searchsorted(key, own[at], side="right")
        hits = [(int(owner[q]), int(place[q]), int(p)) for p, x, y in zip(at[right > left], left[right > left], right[right > left], strict=True) for q in range(x, y)]
        found = []
        for t, low, high in chains(hits, lengths):
            lo = max(0, low - BAND)
            part = h[a + lo : min(b, a + high + lengths[t] + BAND)]
            n, s, e = align(bodies[t], part, low - lo, more=high - low)
            if n and n >= (coverage if least is None else least) * lengths[t]:
                found.append((n, lo + s, lo + e, t))
        if not found:
            continue
        taken: list[tuple[int, int, int, int]] = []  # (first word, end, words matched, template), by first word, none overlapping
        for n, s, e, t in sorted(found, key=lambda x: (x[0] < coverage * lengths[x[3]], -x[0], x[3], x[1])):
            k = bisect_left(taken, (s,))
            if (k == 0 or taken[k - 1][1] <= s) and (k == len(taken) or e <= taken[k][0]):
                taken.insert(k, (s, e, n, t))
        base, end = int(bounds[d]), int(bounds[d + 1])
        chars = np.concatenate([[0], np.cumsum(data[base:end] & 0xC0 != 0x80)])
        for s, e, n, t in taken:
            out[d].append((int(chars[starts[a + s] - base]), int(chars[ends[a + e - 1] - base]), t, n / lengths[t]))
    return out


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, least: float | None = None) -> DataFrame:
    """``docs`` without the text, with ``licences``: array of (licence, start, end, coverage)."""
    names, kept = list(templates), [c for c in docs.columns if c not in (text, "licences")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())]))
        for whole in batches:
            for batch in words.slices(whole, len(kept)):
                found = [[{"licence": names[t], "start": s, "end": e, "coverage": c} for s, e, t, c in row] for row in matches(batch.column(len(kept)), templates, coverage, least)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, kind)], names=[*kept, "licences"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in kept)
    return docs.select(*kept, text).mapInArrow(run, schema + "licences array<struct<licence:string,start:int,end:int,coverage:double>>")


def query(spark, sf_dir) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), least=0.0)
    found = found.selectExpr("doc_id", "licences", f"filter(licences, x -> x.coverage >= {COVERAGE}) as sure")
    return found.selectExpr(
        "doc_id", "cast(size(sure) as long) as n_matches", "array_join(array_sort(array_distinct(transform(sure, x -> x.licence))), ',') as found",
        "coalesce(array_max(transform(licences, x -> x.coverage)), 0D) as best_coverage",
        "array_join(transform(sure, x -> concat_ws(':', x.licence, x.start, x.end, cast(round(x.coverage * 1000) as int))), ',') as spans",
    )
