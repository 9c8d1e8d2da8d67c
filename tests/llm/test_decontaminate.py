import random

import numpy as np
import pyarrow as pa

from tallyroom.llm import common, decontaminate as D


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_bit_parallel_subsequence_is_the_textbook_one():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        b = [rng.randrange(6) for _ in range(rng.randrange(0, 40))]
        masks: dict[int, int] = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        assert D.common_subsequence(masks, len(a), b).bit_count() == _lcs(a, b)


def _corpus(seed=2, n=150):
    rng = random.Random(seed)
    common_words = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(common_words) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(rng.randrange(18, 60)))) for i in range(20)]
    docs, planted = [], set()
    for i in range(n):
        words = [word() for _ in range(rng.randrange(1, 400))]
        if i % 5 == 0:
            item = rng.choice(items)
            said = item[1].split()
            if i % 10 == 0:  # a paraphrase: every seventh word is another, the answer at the end stays
                said = [word() if j % 7 == 3 and j < len(said) - 6 else w for j, w in enumerate(said)]
            at = rng.randrange(len(words))
            words[at:at] = said
            planted.add((i, item[0]))
        docs.append((i, ("X" if i % 3 else "") + ". ".join([" ".join(words), "End"])))
    return docs, items, planted


def test_finds_copies_and_paraphrases_and_nothing_else(spark):
    docs, items, planted = _corpus()
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(got & planted) >= 0.95 * len(planted) and not got - planted and len(found) == len(got)


def test_search_matches_an_exhaustive_one(spark):
    docs, items, _ = _corpus(9, 60)
    words, at = common.word_hashes(pa.array([t.lower() for _, t in docs]), D._TABLE)
    iw, ia = common.word_hashes(pa.array([t.lower() for _, t in items]), D._TABLE)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    latent, want = D.latent_map(d, b)[0], set()
    for k, (i, _) in enumerate(items):
        own = iw[ia[k] : ia[k + 1]]
        item = D._Item(i, own, iw[:0], (latent[D._bucket(own)] != 0).any(axis=1))
        for n, (doc, _) in enumerate(docs):
            w = words[at[n] : at[n + 1]]
            size = D.window_of(item.length)
            if any(D._confirm(item, w[max(0, s - item.length) : s + size + item.length])[2] for s in range(0, len(w), size // 4)):
                want.add((doc, i))
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(d, b).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    docs = [(1, f"so {item} there", "x"), (1, f"so {item} there", "x"), (None, item, "x"), (2, None, "x"), (3, "", "x"), (4, "the " * 50_000 + item, "x"), (5, "nothing of the kind", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (10, "?!")], "item_id long, text string")
    rows = D.contaminated(d, b).collect()
    assert sorted((r["doc_id"] or -1) for r in rows if r["item_id"] == 7) == [-1, -1, 1, 1, 1, 1, 4, 4]
    assert {r["item_id"] for r in rows} == {7}
    assert sorted(str(r["doc_id"]) for r in D.without_contaminated(d, b).collect()) == ["2", "3", "5", "None"]
    assert D.contaminated(d.limit(0), b).count() == 0 and D.contaminated(d, b.limit(0)).count() == 0


def test_answers_decide_between_thresholds():
    words = np.arange(1, 41, dtype=np.uint64)
    item = D._Item(1, words, words[-5:])
    assert D._confirm(item, words[10:])[2] and not D._confirm(item, words[:28])[2] and D._confirm(item, words[:35])[2]


def test_memory_goes_by_the_item_however_long_a_text_repeats_it():
    import tracemalloc

    text = " ".join(f"word{i % 211}x{i}" for i in range(300))
    own, _ = common.word_hashes(pa.array([text]), D._TABLE)
    vocabulary = np.unique(own)
    latent = np.random.default_rng(1).standard_normal((D.DIM, D.RANK)).astype(np.float32)
    vectors = D._unit(latent[D._bucket(own)].sum(axis=0, keepdims=True))
    index = D._Index([7], [own], [own[:0]], vectors, vocabulary, np.ones(len(vocabulary), np.int64))
    near = " ".join(w for i, w in enumerate(text.split()) if i % 10)  # never whole, so that no window ends the search
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join([near] * 7500)])], ["doc_id", "_lower"])
    assert len(near.split()) * 7500 > 2_000_000
    tracemalloc.start()
    found = [r for b in D._search(latent, index, 2.0)([batch]) for r in b.to_pylist()]
    assert not found and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    few = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join([near] * 5)])], ["doc_id", "_lower"])
    found = [r for b in D._search(latent, index, 0.3)([few]) for r in b.to_pylist()]
    assert [(r["doc_id"], r["item_id"], r["n_common"]) for r in found] == [(1, 7, 270)]


def test_counts_of_a_long_item_are_those_of_the_table(monkeypatch):
    rng = np.random.default_rng(3)
    words = rng.integers(0, 40, 500).astype(np.uint64)
    item = D._Item(1, rng.integers(0, 40, 60).astype(np.uint64), words[:0])
    start = np.arange(0, 400, 7)
    want = item.held(words, start, start + 90)
    monkeypatch.setattr(D, "HELD_CELLS", 1)
    assert np.array_equal(item.held(words, start, start + 90), want)


def _plain_map(texts, items):
    """The latent map by dense products over every passage of all texts and items."""
    from collections import Counter

    words = [common.word_hashes(pa.array([t.lower()]), D._TABLE)[0] for t in texts + items]
    hashed = [D._bucket(w).tolist() for w in words]
    df = Counter(b for h in hashed[: len(texts)] for b in set(h))
    in_items = Counter(b for h in hashed[len(texts) :] for b in set(h))
    idf = np.zeros(D.DIM)
    for b in range(D.DIM):
        if not (df[b] > 0.2 * len(texts) and in_items[b] > max(0.2 * len(items), 4)):
            idf[b] = max(np.log((1 + len(texts)) / (1 + df[b])), 0.1)
    rows = []
    for h in hashed:
        for i in range(0, len(h), D.PASSAGE):
            x = np.bincount(h[i : i + D.PASSAGE], minlength=D.DIM) * idf
            rows.append(x / (np.linalg.norm(x) or 1))
    some = np.flatnonzero(np.any(rows, axis=0))
    a = np.array(rows)[:, some]
    values, vectors = np.linalg.eigh(a.T @ a)
    values, vectors = values[::-1][: D.RANK], vectors[:, ::-1][:, : D.RANK]
    keep = values > 1e-9 * values[0]
    out = np.zeros((D.DIM, keep.sum()))
    out[some] = idf[some, None] * vectors[:, keep] / np.sqrt(values[keep] + np.median(values[keep]))
    return out, some, Counter(int(w) for own in words[: len(texts)] for w in own)


def _few_words(seed=6, n=130):
    """Texts of 90 words in all, so that the map has no more directions than it keeps."""
    rng = random.Random(seed)
    words = [f"{c}{i}" for i, c in enumerate("abcdefghij" * 9)]
    texts = [" ".join(rng.choice(words[i % 7 * 10 :]) for _ in range(rng.choice((0, 1, 47, 48, 49, 300, 700)))) for i in range(n)]
    return texts, [" ".join(rng.sample(words, 30)) for _ in range(8)]


def test_map_and_counts_are_those_of_every_passage(spark, monkeypatch):
    monkeypatch.setattr(D, "SAMPLE_PASSAGES", 50, raising=False)  # a bound that must not be heeded
    monkeypatch.setattr(D, "HEAD", 16, raising=False)
    texts, items = _few_words()
    want, some, counts = _plain_map(texts, items)
    d = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    latent, seen = D.latent_map(d, spark.createDataFrame([(t,) for t in items], "text string"))
    want, got = want[some] @ want[some].T, latent[some] @ latent[some].T
    assert np.abs(got - want).max() < 1e-3 * np.abs(want).max()
    own = np.unique(common.word_hashes(pa.array(items), D._TABLE)[0])
    assert [int(n) for n in seen[D._counted(own)]] == [counts[w] for w in own.tolist()]
    assert 0 < seen.sum() == sum(counts[w] for w in own.tolist()) < sum(counts.values())


def test_products_are_the_dense_ones_however_passages_are_grouped(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [rng.zipf(1.3, n).astype(np.uint64) % D.DIM for n in (0, 5, 48, 49, 2000, 0, 731)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.astype(np.uint16).tobytes() for t in texts], pa.binary())], ["words"]).slice(1)
    idf, basis = rng.random(D.DIM) * (rng.random(D.DIM) < 0.9), rng.standard_normal((D.DIM, 7))
    rows = [np.bincount(t[i : i + D.PASSAGE].astype(int), minlength=D.DIM) * idf for t in texts for i in range(0, len(t), D.PASSAGE)]
    a = np.array([x / np.linalg.norm(x) for x in rows])
    for sizes in ({}, {"HEAD": 9, "BLOCK": 4, "GROUP": 10, "CELLS": 6}):
        for name, size in sizes.items():
            monkeypatch.setattr(D, name, size)
        product = D._Product(basis, idf, a.sum(axis=0))
        for step, want in ((D._half_step, a.T @ (a @ basis)), (D._square, (a @ basis).T @ (a @ basis))):
            (out,) = step(product)(iter([batch]))
            got = np.concatenate([np.frombuffer(x).reshape(-1, 7) for x in out["part"].to_pylist()])
            assert np.abs(got - want).max() < 1e-5 * np.abs(want).max()


def test_most_is_what_a_whole_stretch_holds():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 90, 300).astype(np.uint64)
    item = D._Item(1, rng.integers(0, 60, 50).astype(np.uint64), words[:0])
    start = np.arange(0, 250, 7)
    assert [item.most(words[a : a + 50]) for a in start] == item.held(words, start, start + 50).tolist()
    assert item.most(words[:0]) == 0


def test_runs_of_cells_are_found_once_for_all_products(monkeypatch):
    rng = np.random.default_rng(3)
    seen, begins = [], D._begins
    monkeypatch.setattr(D, "_begins", lambda x: seen.append(len(x)) or begins(x))
    rows = rng.standard_normal((50, 7)).astype(np.float32)
    for n in (0, 1, D.CELLS, 10 * D.CELLS + 3):
        to, at, value = np.sort(rng.integers(0, 40, n)), rng.integers(0, 50, n), rng.standard_normal(n).astype(np.float32)
        out = np.ones((40, 7))
        D._sum_rows(out, to, rows, at, value)
        want = np.ones((40, 7))
        np.add.at(want, to, value[:, None] * rows[at])
        assert np.allclose(out, want, atol=1e-4)
    assert len(seen) == 4
