import math
from collections import Counter

import pytest
import xxhash

from tallyroom.llm import quality


def _hash(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return (seed - (1 << 64) if seed >= 1 << 63 else seed) % quality.BUCKETS


def _base(text):
    words = [w.decode() for w in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def _grams(text):
    w = [x.decode() for x in (text or "").lower().encode().split()]
    return [_hash(x) for x in w] + [_hash(a, b) for a, b in zip(w, w[1:])]


TEXTS = [
    None, "", " \t\n", "one", "a b c d e f g h i j k", "a b c d e a b c d e x y z", "x " * 30, "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5 w7 w8 w9 w1 w2 w3 w4 w5 w10 w11", "same line here\nsame line here\n\n \nother\nsame line here ",
    "### *** $$ % & | < > junk@@ é ß 漢字 \u2003 x", "A\x0bB\x0cC\rD", " ".join(f"n{i % 997}" for i in range(9000)), "tail\n",
]


def test_base_and_ratio_match_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b c d e f g h i j k l", "x"), (4, TEXTS[4], "x")]
    trusted = [4, 11, 11, None]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, n_words string"), spark.createDataFrame([(x,) for x in trusted], "doc_id long")).collect()
    raw, target = Counter(), Counter()
    for i, t, _ in rows:
        raw.update(_grams(t))
        if i in (4, 11):
            target.update(_grams(t))
    shift = math.log((sum(raw.values()) + quality.BUCKETS) / (sum(target.values()) + quality.BUCKETS))
    assert len(got) == len(rows)
    by = {(r["doc_id"]): r for r in got}
    for i, t, _ in rows:
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _base(t), t
        g = _grams(t)
        if g:
            want = sum(math.log((target[b] + 1) / (raw[b] + 1)) + shift for b in g) / len(g)
            assert r["llr"] == pytest.approx(want)
            assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD)
        else:
            assert r["llr"] is None and not r["kept"]


def test_no_rows_and_no_trusted(spark):
    docs = spark.createDataFrame([(1, " ".join("abcdefghijklm"))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert quality.judged(docs, none).first()["kept"] and quality.judged(docs.limit(0), none).count() == 0


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = quality.judged(docs, docs.select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("bits", [quality.WINDOW, 62])
def test_repeated_words_where_places_leave_few_bits_of_keys(spark, monkeypatch, bits):
    monkeypatch.setattr(quality, "PLACE_BITS", bits)
    cased = "Aa b c d e f g h aA b c d e f g h i j k"  # pairs repeat in lower case, the first window does not
    texts = [*TEXTS, cased, "p q r x y p q s x y p q t x y p q u x y", " ".join(f"n{i % 97}" for i in range(500)) + " tail " + " ".join(f"m{i}" for i in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.judged(docs, docs.select("doc_id").limit(0)).collect()}
    assert got == {i: _base(t)[4] for i, t in enumerate(texts)}


def test_only_texts_with_repeated_pairs_get_windows_and_counting_compiles(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f A B C D E f")], "doc_id long, text string")
    rows = docs.select("doc_id", "text", quality.words_of(quality.F.lower("text")).alias("lowered"))
    rows = rows.select("*", quality._pairs().alias("pairs")).select("doc_id", quality.F.size(quality._window_keys()).alias("n"))
    assert {r["doc_id"]: r["n"] for r in rows.collect()} == {1: 0, 2: 8}
    plan = quality.gram_counts(docs, docs.select("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "lambda" not in plan
