import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroom.llm import langid

SYLLABLES = {"aa": ["the", "ing", "wh", "ou"], "bb": ["sch", "ung", "ß", "ein"], "cc": ["eau", "ê", "tion", "qu"]}


def _rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 60))]
        rows.append((i, " ".join(words), lang, i % 3 != 1))
    return rows


def test_held_out_accuracy_and_calibrated_scores(spark):
    df = spark.createDataFrame(_rows(600, 1), "doc_id long, text string, lang string, learn boolean")
    rows = langid.identify(df, F.col("learn")).collect()
    held = [r for r in rows if not r["learn"]]
    assert len(rows) == 600 and np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_predictions_do_not_read_the_label(spark):
    rows = _rows(300, 2)
    a = spark.createDataFrame(rows, "doc_id long, text string, lang string, learn boolean")
    b = spark.createDataFrame([(i, t, g if keep else "zz", keep) for i, t, g, keep in rows], "doc_id long, text string, lang string, learn boolean")
    pick = lambda df: {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, F.col("learn")).collect()}
    assert pick(a) == pick(b)


def test_edges(spark):
    rows = [*[(i, t, g, True, "x") for i, t, g, _ in _rows(90, 3)], (900, None, "aa", True, "x"), (901, "", "aa", True, "x"), (902, "12 34 !?", None, False, "x"), (903, "the " * 60_000, None, False, "x"), (None, "the ing", None, None, "x"), (901, "", "aa", True, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, learn boolean, score string")
    out = langid.identify(df, F.col("learn"))
    assert out.columns == ["doc_id", "text", "lang", "learn", "lang_pred", "score"]
    got = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in out.collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    assert got[903][0] == "aa" and got[None][0] == "aa" and out.count() == len(rows)


def test_nothing_learnt_and_no_rows(spark):
    df = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert langid.identify(df, F.lit(True)).first()["lang_pred"] == "und"
    assert langid.identify(df.limit(0), F.lit(True)).count() == 0


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    p = langid._softmax(logits)
    labels = np.array([rng.choice(3, p=row) for row in p])
    assert langid.temperature(logits * 5, labels) == pytest.approx(5, rel=0.15)


def test_l1_leaves_unused_weights_at_zero():
    w = langid.ftrl([(np.array([1, 2]), np.array([0.6, 0.8])), (np.array([3]), np.array([1.0]))], np.array([0, 1]), 2)
    assert np.count_nonzero(w[:, [0, 5, 100]]) == 0 and w[0, 1] > w[1, 1] and w[1, 3] > w[0, 3]


def test_ftrl_equals_a_plain_one_and_l1_makes_it_sparse():
    import math
    import random

    rng = random.Random(2)
    examples, labels = [], []
    for _ in range(60):
        k = rng.randrange(3)
        at = sorted({k * 5 + rng.randrange(5) for _ in range(4)} | {rng.randrange(100, 140) for _ in range(3)})
        x = [rng.random() for _ in at]
        norm = math.sqrt(sum(v * v for v in x))
        examples.append((np.array(at), np.array(x) / norm))
        labels.append(k)
    shares = []
    for l1 in (0.0, 0.3):
        z, n = {}, {}  # by (class, feature), one weight at a time

        def weight(key):
            zi, ni = z.get(key, 0.0), n.get(key, 0.0)
            return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((langid.BETA + math.sqrt(ni)) / langid.ALPHA + langid.L2)

        order = np.random.default_rng(7)
        for _ in range(langid.EPOCHS):
            for e in order.permutation(len(examples)):
                at, x = examples[e]
                logits = [sum(weight((k, i)) * v for i, v in zip(at.tolist(), x.tolist())) for k in range(3)]
                total = sum(math.exp(v - max(logits)) for v in logits)
                before = {(k, i): weight((k, i)) for k in range(3) for i in at.tolist()}
                for k in range(3):
                    p = math.exp(logits[k] - max(logits)) / total - (labels[e] == k)
                    for i, v in zip(at.tolist(), x.tolist()):
                        g, old = p * v, n.get((k, i), 0.0)
                        z[k, i] = z.get((k, i), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / langid.ALPHA * before[k, i]
                        n[k, i] = old + g * g
        got = langid.ftrl(examples, np.array(labels), 3, l1)
        want = np.zeros((3, langid.DIM))
        for k, i in z:
            want[k, i] = weight((k, i))
        assert np.allclose(got, want, atol=1e-9)
        shares.append(np.count_nonzero(got) / len(z))
        assert np.mean([(got[:, at] @ x).argmax() == k for (at, x), k in zip(examples, labels)]) > 0.95
    assert shares[0] > 0.99 and shares[1] < 0.85


def test_clashing_names_pass(spark):
    rows = [(i, "der hund und die katze" if i % 2 else "the dog and the cat", "de" if i % 2 else "en", 1, 2, 3) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _lower int, letter int, row int")
    out = langid.identify(df, F.lit(True))
    assert out.columns == [*df.columns, "lang_pred", "score"]
    assert {(r["_lower"], r["letter"], r["row"]) for r in out.collect()} == {(1, 2, 3)}
