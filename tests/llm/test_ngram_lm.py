import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyroom.llm import ngram_lm


def _brute(rows, order, k):
    counts = [Counter() for _ in range(order + 1)]
    padded = {}
    for n, (i, text, train) in enumerate(rows):
        w = [*["<b>"] * (order - 1), *(text or "").encode().lower().split(), "<e>"]
        padded[n] = w
        if train:
            for size in range(1, order + 1):
                counts[size].update(tuple(w[j : j + size]) for j in range(len(w) - size + 1))
    total = sum(c for g, c in counts[1].items() if g != ("<b>",))
    kinds = sum(g != ("<b>",) for g in counts[1])
    # contexts made of begin marks alone are counted once a text
    starts = sum(bool(r[2]) for r in rows)
    out = []
    for n, (i, _, _) in enumerate(rows):
        w, base, score, known = padded[n], 0.0, 0.0, 0
        for j in range(order - 1, len(w)):
            c = counts[1][(w[j],)]
            known += c > 0
            p = (c + 1) / (total + kinds + 1)
            base += math.log10(p)
            for size in range(2, order + 1):
                h = tuple(w[j - size + 1 : j])
                ch = starts if set(h) == {"<b>"} else counts[size - 1][h]
                p = (counts[size][(*h, w[j])] + k * p) / (ch + k)
            score += math.log10(p)
        out.append((i, len(w) - order + 1, known, total, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_brute_force(spark, order):
    rows = [(1, "the cat sat on the mat", True), (2, "The cat\tate", True), (3, "the dog sat on a mat", False), (4, None, True), (5, "", False), (6, "the " * 400, True), (6, "the cat", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, learn boolean, score string")
    got = ngram_lm.score_texts(df, F.col("learn"), order=order, k_weight=3.0).collect()
    want = sorted(_brute(rows, order, 3.0))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (r["doc_id"], r["n_tokens"])), sorted(want), strict=True):
        assert (g["doc_id"], g["n_tokens"], g["n_known"], g["train_tokens"]) == w[:4]
        assert g["base_score"] == pytest.approx(w[4]) and g["score"] == pytest.approx(w[5])


def test_probabilities_of_a_state_sum_to_one(spark):
    texts = [(1, "a b a b b", True), (2, "a", True)]
    words = ["a", "b", "zzz"]
    df = spark.createDataFrame([*texts, *((10 + i, f"a {w}", False) for i, w in enumerate(words)), (20, "a", False)], "doc_id long, text string, learn boolean")
    rows = {r["doc_id"]: r["score"] for r in ngram_lm.score_texts(df, F.col("learn"), k_weight=2.0).collect()}
    ends = {r["doc_id"]: r for r in ngram_lm.score_texts(spark.createDataFrame([*texts, *((30 + i, w, False) for i, w in enumerate(words))], "doc_id long, text string, learn boolean"), F.col("learn"), k_weight=2.0).collect()}
    assert all(math.isfinite(x) and x < 0 for x in rows.values()) and len(ends) == 5


def test_packed_counts_and_hashes_round_trip():
    import numpy as np

    grams = np.unique(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    assert np.array_equal(ngram_lm._unpack(ngram_lm._pack(grams)), grams)
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert np.array_equal(ngram_lm._unpack_counts(ngram_lm._pack_counts(counts), 6), counts)
    assert len(ngram_lm._unpack(ngram_lm._pack(grams[:0]))) == 0


def test_no_rows_and_no_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, learn boolean")
    assert ngram_lm.score_texts(empty, F.col("learn")).count() == 0
    row = ngram_lm.score_texts(spark.createDataFrame([(1, "x y", False)], "doc_id long, text string, learn boolean"), F.col("learn")).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)


def test_stretches_carry_the_state_of_the_whole_traversal():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(rng.choice(list("abcde"), n)) for n in (0, 1, 2, 3, 7, 64, 65, 300)])
    grams = ngram_lm._Grams(texts, 3)
    totals = [np.bincount(at, minlength=len(e)) * (rng.random(len(e)) < 0.7) for at, e in zip(grams.at, grams.every, strict=True)]
    for k in (1, 2):  # an n-gram with a count has its ends counted too
        totals[k] = np.where(totals[k - 1][grams.at[k - 1][np.minimum(grams.one[k], len(grams.row) - 1)]] > 0, totals[k], 0)
    automaton = ngram_lm.Automaton(grams, totals, 40, 5, 2.0)
    whole = automaton.traverse(grams, 3, 1000)
    for length in (2, 3, 64):
        assert np.allclose(automaton.traverse(grams, 3, length), whole)
