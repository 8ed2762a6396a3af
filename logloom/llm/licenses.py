"""License scan: MinHash bands over overlapping windows, then exact containment.

Text and templates are normalised to lower-case words and cut into 5-word
shingles. A template of T shingles is looked for in windows of W shingles, W the
least power of two with W >= 2 T (8 at least), that overlap by three quarters; so
every contiguous copy lies in some window. With at least 0.8 of the template's
shingles in the window, their Jaccard similarity J has a lower bound, and the
number of one-row bands is such that a shared band is missed with probability
(1 - J) ** BANDS. Candidates are verified by comparing the shingles themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import text_slices

WIDTH = 5
CONTAINMENT = 0.8
BANDS = 96
LEAST_WINDOW = 8
#: Shingles handled at once; long texts go in overlapping slices of this size.
SLICE = 16_384
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")

#: Names and notices of public licenses (fixed values).
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def normal(text: bytes | None) -> list[bytes]:
    return _WORD.findall((text or b"").lower())


def shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """Runs of WIDTH words; of fewer words the whole; of none nothing."""
    if len(words) < WIDTH:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(WIDTH))))


def window_for(n: int) -> int:
    """Window size for a template of n shingles."""
    return max(LEAST_WINDOW, 1 << (2 * n - 1).bit_length())


def least_jaccard(n: int) -> float:
    """Lower bound of the similarity of a template and a window that holds CONTAINMENT of it."""
    return CONTAINMENT * n / (window_for(n) + (1 - CONTAINMENT) * n)


def miss_probability(n: int) -> float:
    return (1 - least_jaccard(n)) ** BANDS


_SEEDS = np.array([xxhash.xxh32_intdigest(b"band", seed=k) | 1 for k in range(BANDS)], np.uint32)[None, :]
#: Where each band begins in the flat table of leading bits.
_FIRST = (np.arange(BANDS, dtype=np.uint32) << np.uint32(12))[None, :]
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WIDTH)]


class Scanner:
    """Templates and their bands; scans texts one by one."""

    def __init__(self, templates: dict[str, str]):
        self.cache: dict[bytes, int] = {}
        self.names, self.sets, groups = [], [], {}
        self.short: dict[tuple[bytes, ...], list[int]] = {}
        for name, text in templates.items():
            words = normal(text.encode())
            if not words:
                continue
            index = len(self.names)
            self.names.append(name)
            self.sets.append(frozenset(shingles(words)))
            if len(words) < WIDTH:  # such a template is one short shingle; it is looked up as a run of words
                self.short.setdefault(tuple(words), []).append(index)
                continue
            groups.setdefault(window_for(len(self.sets[-1])), []).append((index, self._bands(self._hashes(words)).min(axis=0)))
        self.groups = {}
        for window, found in groups.items():
            tables = [{} for _ in range(BANDS)]
            quick = np.zeros(BANDS << 12, bool)
            for index, mins in found:
                for band, value in enumerate(mins.tolist()):
                    tables[band].setdefault(value, []).append(index)
                    quick[band << 12 | value >> 20] = True
            self.groups[window] = (tables, quick)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        """32-bit hash of each shingle, from its words' hashes."""
        cache = self.cache
        if len(cache) > 1_000_000:
            cache.clear()
        out = []
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        word, n = np.array(out, np.uint64), len(words) - WIDTH + 1
        with np.errstate(over="ignore"):
            total = np.zeros(n, np.uint64)
            for k in range(WIDTH):
                total += word[k : k + n] * _POWERS[k]
            total = (total ^ (total >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            return (total >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def _bands(hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return hashes[:, None] * _SEEDS

    def _candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first shingle, shingles) of the windows that share a band with a template."""
        if not self.groups or not len(hashes):
            return
        step, low, top = 1, self._bands(hashes), max(self.groups)
        while 4 * step <= top:
            if 4 * step in self.groups:
                tables, quick = self.groups[4 * step]
                # a window is four blocks, and windows move by one
                pairs = np.concatenate([low, np.full((3, BANDS), 0xFFFFFFFF, np.uint32)])
                pairs = np.minimum(pairs[:-1], pairs[1:])
                mins = np.minimum(pairs[:-2], pairs[2:])
                hit = quick[(mins >> np.uint32(20)) + _FIRST]
                for at, band in zip(*np.nonzero(hit)):
                    for index in tables[band].get(int(mins[at, band]), ()):
                        yield index, int(at) * step, 4 * step
            # blocks of twice the size; an odd one at the end stays by itself
            even = len(low) // 2 * 2
            low = np.concatenate([np.minimum(low[0:even:2], low[1:even:2]), low[even:]])
            step *= 2

    def scan(self, text: bytes | None) -> dict[int, tuple[float, int]]:
        """Of each template found: (containment, first word of the best window)."""
        words = normal(text)
        found: dict[int, tuple[float, int]] = {}
        for key, indexes in self.short.items():
            k = len(key)
            at = next((i for i, w in enumerate(words) if w == key[0] and tuple(words[i : i + k]) == key), None)
            if at is not None:
                found |= dict.fromkeys(indexes, (1.0, at))
        total = len(words) - WIDTH + 1
        if total < 1:
            return found
        hashes = self._hashes(words)
        overlap = max(self.groups, default=0)
        for start in range(0, total, SLICE):
            part = hashes[start : start + SLICE + overlap]
            for index, at, size in sorted(set(self._candidates(part))):  # of equal windows the first counts
                at += start
                here = set(shingles(words[at : at + size + WIDTH - 1]))
                share = len(self.sets[index] & here) / len(self.sets[index])
                if share >= CONTAINMENT and share > found.get(index, (0.0, 0))[0]:
                    found[index] = (share, at)
        return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, at_word): one row for each row of ``docs`` and template it holds.

    A document holds a template if one window holds at least CONTAINMENT of the
    template's shingles; ``containment`` is the best window's share and
    ``at_word`` its first word. A template of fewer than 5 words must occur whole.

    Null, empty and short texts hold nothing. Repeated rows are scanned each; ties
    between windows go to the first found. Whole texts are scanned, long ones in
    overlapping slices. An empty table or no templates give an empty table. Other
    columns are not read. ``templates`` goes to every task and must be small.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            row, name, share, at = [], [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                for index, (best, word) in sorted(scanner.scan(text).items()):
                    row.append(i)
                    name.append(scanner.names[index])
                    share.append(best)
                    at.append(word)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())), pa.array(name, pa.string()), pa.array(share, pa.float64()), pa.array(at, pa.int64())],
                names=["doc_id", "license", "containment", "at_word"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, containment double, at_word long")
