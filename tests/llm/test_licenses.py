import random

import numpy as np
import pyarrow as pa

from tallyroom.llm import common, licenses as L


def test_winnowing_guarantees_a_shared_fingerprint():
    rng = random.Random(2)
    for _ in range(200):
        words = np.array([rng.randrange(1, 1 << 60) for _ in range(30)], np.uint64)
        size = L.WINDOW + L.K - 1
        a, b = rng.randrange(26), rng.randrange(20)
        other = np.array([rng.randrange(1, 1 << 60) for _ in range(30)], np.uint64)
        part = words[a : a + size]
        if len(part) == size:
            other[b : b + size] = part
            assert set(L.winnow(words)[0].tolist()) & set(L.winnow(other)[0].tolist())


def _lcs_in_band(a, b, offset):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            near = abs(j - i - offset) <= L.BAND
            best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + 1 if near and x == y else 0)
    return best[-1, -1]


def test_alignment_matches_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(8) for _ in range(rng.randrange(1, 12))]
        b = [rng.randrange(8) for _ in range(rng.randrange(1, 12))]
        matched, first, last = L.align(a, b, 0)
        assert matched == _lcs_in_band(a, b, 0)
        if matched:
            assert a and b[first] in a and b[last] in a and last - first + 1 >= matched


def _scan(spark, rows):
    out = L.scan_licenses(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")).collect()
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["license"], r["matched"], r["first_word"], r["last_word"]) for r in out)


def test_spans_and_coverage(spark):
    rows = [
        (1, "some words here\nReleased under the MIT License."),
        (2, "released UNDER the, MIT   licence and then Licensed under the Apache License, Version 2.0. end"),
        (3, "nothing at all to see here, under the bridge"),
        (4, None),
        (5, ""),
        (6, "word " * 40_000 + "All rights reserved."),
        (None, "All rights reserved"),
        (7, "All rights reserved. x y z All rights reserved."),
        (7, "All rights reserved. x y z All rights reserved."),
        (8, "Licensed under CC BY-NC 4.0"),
        (9, "Licensed under CC BY-NC 3.0 and so on"),
    ]
    assert _scan(spark, rows) == [
        (-1, "all-rights-reserved", 3, 0, 2),
        (1, "mit-notice", 5, 3, 7),
        (2, "apache-2.0-notice", 7, 7, 13),
        (2, "mit-notice", 4, 0, 3),
        (6, "all-rights-reserved", 3, 40_000, 40_002),
        (7, "all-rights-reserved", 3, 0, 2),
        (7, "all-rights-reserved", 3, 0, 2),
        (7, "all-rights-reserved", 3, 6, 8),
        (7, "all-rights-reserved", 3, 6, 8),
        (8, "cc-by-nc-4.0-notice", 6, 0, 5),
        (9, "cc-by-nc-4.0-notice", 5, 0, 4),
    ]


def test_finds_what_an_exhaustive_alignment_finds(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    rows, want = [], set()
    for i in range(60):
        words = [word() for _ in range(rng.randrange(0, 60))]
        name, text = rng.choice(L.TEMPLATES)
        said = text.split()
        for _ in range(len(said) // 12):
            said[rng.randrange(len(said))] = word()
        at = rng.randrange(len(words) + 1)
        words[at:at] = said
        rows.append((i, " ".join(words)))
        a = common.word_hashes(pa.array([L._strip(text), L._strip(rows[-1][1])]), L._TABLE)
        template, full = a[0][: a[1][1]].tolist(), a[0][a[1][1] :].tolist()
        if max(L.align(template, full, o)[0] for o in range(-2, len(full))) >= L.MIN_COVERAGE * len(template):
            want.add((i, name))
    got = {(r[0], r[1]) for r in _scan(spark, rows)}
    assert len(got & want) >= 0.9 * len(want) and len(want) > 40


def test_no_rows(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
