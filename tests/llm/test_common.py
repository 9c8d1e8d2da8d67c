import random

import numpy as np
import pyarrow as pa
import pytest

from tallyroom.llm import common

SPACE = common.byte_table()


def test_words_are_split_like_bytes_split():
    texts = ["", None, "a", " a  b ", "A b\x0bC\x0c\r\nd", "é É", "x" * 50, "a\x00b a", "tail ", " \t\n"]
    hashes, at = common.word_hashes(pa.array(texts, pa.string()), SPACE)
    known: dict[int, bytes] = {}
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        words = (t or "").encode().lower().split()
        assert len(words) == b - a
        for h, w in zip(hashes[a:b].tolist(), words, strict=True):
            assert known.setdefault(h, w) == w
    assert len(set(known.values())) == len(known)


def test_pieces_give_the_same_hashes(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(0, 300))) for _ in range(40)] + ["y" * 900, "z " * 400]
    whole = common.word_hashes(pa.array(texts), SPACE)
    monkeypatch.setattr(common, "_CHUNK", 64)
    pieces = common.word_hashes(pa.array(texts), SPACE)
    assert np.array_equal(whole[0], pieces[0]) and np.array_equal(whole[1], pieces[1])


def test_sliced_arrays_and_no_rows():
    texts = pa.array(["one two", "three", None, "four five six"])
    _, at = common.word_hashes(texts.slice(1, 3), SPACE)
    assert at.tolist() == [0, 1, 1, 4]
    assert common.word_hashes(pa.array([], pa.string()), SPACE)[1].tolist() == [0]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_no_edges_no_components(spark):
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_order_of_values_sorts_them():
    rng = np.random.default_rng(4)
    near = (np.uint64(1) << np.uint64(63)) + rng.integers(0, 9, 500).astype(np.uint64)
    for x in (rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2), near, rng.integers(0, 50, 300).astype(np.uint64), near[:0], near[:1]):
        by = common.order_of(x)
        assert np.array_equal(np.sort(by), np.arange(len(x))) and np.array_equal(x[by], np.sort(x))
