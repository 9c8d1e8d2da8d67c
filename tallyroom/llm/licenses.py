"""License scan: winnowed fingerprints of templates pick candidates, banded alignment reports spans.

Words of a text are hashed, K consecutive words make a fingerprint, and of every WINDOW neighbouring
fingerprints the least is kept, in templates and texts alike: any run of WINDOW + K - 1 equal words shares one.
An inverted index from fingerprint to template and place turns the kept fingerprints of a text into
candidate places, and an alignment within BAND words of a candidate's diagonal gives the
matched share of the template and the span in the text. The templates are a fixed short list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm import common

K = 2
WINDOW = 2
BAND = 6
MIN_COVERAGE = 0.8
MAX_TEMPLATES = 2000

#: Notices of common public licences, by identifier.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "bsd-2-clause-conditions",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "isc-permission",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    ("mit-notice", "Released under the MIT License."),
    (
        "mit-permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
)
_TABLE = common.byte_table(separators=frozenset(b for b in range(1, 128) if not (chr(b).isalnum() or chr(b) == ".")))


def _clean(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words (letters, digits and full stops inside numbers) and row offsets."""
    return common.word_hashes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), _TABLE)


def _plain(text: F.Column) -> F.Column:
    """The text with the full stops that end a word taken off."""
    return F.regexp_replace(text, "\\.+(?![0-9A-Za-z])", " ")


def winnow(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept fingerprints and their places: the least (the first of equals) of each ``window`` neighbours.

    With fewer words than ``k`` the whole is one fingerprint; with fewer fingerprints than ``window`` the least is kept.
    """
    if not len(words):
        return words, np.zeros(0, np.int64)
    prints = common.chain(words, min(k, len(words)))
    n = max(len(prints) - window + 1, 1)
    least = np.arange(n)
    for j in range(1, min(window, len(prints))):
        least = np.where(prints[np.arange(n) + j] < prints[least], np.arange(n) + j, least)
    places = np.unique(least)
    return prints[places], places


def align(template: list[int], text: list[int], offset: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, last) of the best alignment within ``band`` of the diagonal text = template + offset.

    A cell has (matches, minus the span's length, minus the distance of its first match from the diagonal,
    minus its first place): most matches win, then the shortest span, then the nearest, then the earliest.
    The number of matches is exact.
    """
    none = (0, 0, 0, 0)
    row: dict[int, tuple[int, int, int, int]] = {}
    for i, word in enumerate(template):
        new: dict[int, tuple[int, int, int, int]] = {}
        for j in range(min(max(0, i + offset - band), len(text) - 1), min(len(text), i + offset + band + 1)):
            found = max(row.get(j, none), new.get(j - 1, none))
            away = abs(j - i - offset)
            if text[j] == word and away <= band:
                n, _, far, start = row.get(j - 1, none)
                far, start = (far, start) if n else (-away, -j)
                found = max(found, (n + 1, -start - j - 1, far, start))
            new[j] = found
        row = new
    n, length, _, start = max(row.values(), default=none)
    return n, -start, -start - length - 1


class _Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates) -> None:
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.names = [name for name, _ in templates]
        words, at = _clean([_strip(text) for _, text in templates])
        self.words = [words[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        entries = []
        for t, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            # all fingerprints of a template are indexed, so whichever a text keeps is found
            prints = common.chain(words[a:b], min(K, int(b - a))) if b > a else words[:0]
            entries += [(p, t, i) for i, p in enumerate(prints.tolist())]
        entries.sort()
        self.prints = np.array([e[0] for e in entries], np.uint64)
        self.places = [(e[1], e[2]) for e in entries]

    def candidates(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(template, offset of its start in the text), offsets that share a band once."""
        kept, places = winnow(words)
        lo, hi = np.searchsorted(self.prints, kept), np.searchsorted(self.prints, kept, "right")
        found: set[tuple[int, int]] = set()
        for i in np.flatnonzero(hi > lo):
            for t, place in self.places[lo[i] : hi[i]]:
                found.add((t, int(places[i]) - place))
        out: list[tuple[int, int]] = []
        for t, offset in sorted(found):
            if not out or out[-1][0] != t or offset - out[-1][1] > BAND // 2:
                out.append((t, offset))
        return out


def _strip(text: str) -> str:
    import re

    return re.sub(r"\.+(?![0-9A-Za-z])", " ", text)


def _scan(templates, min_coverage: float):
    names = ["doc_id", "license", "matched", "coverage", "first_word", "last_word"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(templates)
        for batch in batches:
            words, at = _clean(batch.column("text"))
            rows = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                spans: dict[int, list[tuple[int, int, int]]] = {}
                for t, offset in index.candidates(words[a:b]):
                    size = len(index.words[t])
                    lo = max(a, a + offset - BAND)
                    part = words[lo : max(lo, min(b, a + offset + size + BAND))].tolist()
                    matched, first, last = align(index.words[t], part, a + offset - lo)
                    if matched >= min_coverage * size:
                        spans.setdefault(t, []).append((matched, first + lo - a, last + lo - a))
                for t, found in spans.items():
                    end = -1
                    for matched, first, last in sorted(found, key=lambda x: (x[1], -x[0], x[2])):
                        if first > end:  # overlapping places of one template are reported once
                            rows.append((doc, index.names[t], matched, matched / len(index.words[t]), first, last))
                            end = last
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return scan


def scan_licenses(documents: DataFrame, templates=TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per place of a template in a document: doc_id, license, matched (words), coverage (of the
    template), first_word, last_word.

    Words are runs of ASCII letters, digits, inner full stops and non-ASCII characters, without case. A
    null or empty text has no rows; a null doc_id is carried; repeated rows are each scanned; other columns
    are ignored. A longer template that holds a shorter one is reported besides it.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _plain(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    return docs.mapInArrow(_scan(templates, min_coverage), "doc_id long, license string, matched int, coverage double, first_word int, last_word int")
