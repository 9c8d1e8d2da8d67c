import random
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyroom.llm import common, neardup


def _brute(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.setdefault(i, s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if sets[a] and 100 * n >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def _texts(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for group in range(6):
        base = [word() for _ in range(rng.choice([3, 6, 8, 40, 120]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows) + 10 * group, " ".join(words)))
    return rows


def test_groups_match_brute_force(spark):
    rows = _texts() + [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "One two"), (1004, "one  TWO"), (1005, "w " * 30_000), (1006, "w " * 31_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, kept int")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df).collect()}
    want = _brute(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_chain_links_beyond_similar_pairs(spark):
    words = [f"w{i}" for i in range(140)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in neardup.near_duplicates(df).collect()} == {0}


def test_nulls_repeats_and_no_rows(spark):
    text = "a b c d e f g"
    rows = [(None, text), (None, text), (7, text), (7, text), (3, text), (9, "else entirely here and now")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None] and all(r["kept"] for r in got if r["doc_id"] is None)
    assert {r["component_id"] for r in got if r["doc_id"] == 7} == {3}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0


def test_deduplicated_keeps_one_of_each(spark):
    text = "a b c d e f g"
    rows = [(7, text, "s"), (7, text, "s"), (3, text, "s"), (3, text, "s"), (9, "else entirely here and now", "t"), (None, None, None)]
    out = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert out.columns == ["doc_id", "text", "source"]
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 3, 9]


def test_links_of_a_bucket_that_no_centre_meets_are_found(spark):
    """Pairs alike only to each other in one bucket with a large group: centres meet them with a chance of a few in a thousand."""
    pairs = [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(20)]
    group = {i: " ".join(f"g{j}" for j in range(60)) for i in range(800)}
    text, rows = dict(group), []
    for n, pair in enumerate(pairs):
        words = [f"p{n}x{j}" for j in range(60)]
        text |= dict(zip(pair, (" ".join(words), " ".join([*words, "end"])), strict=True))
        keys = neardup.band_keys(neardup.shingle_sets(pa.array([text[i] for i in pair])), neardup._orders()).view(np.int64)
        rows += [(i, int(k), 56, i) for i, own in zip(pair, keys, strict=True) for k in own]
        first = int(keys[0][(keys[0] == keys[1]).argmax()])
        rows += [(i, first, 56, 0) for i in group]
    members = spark.createDataFrame(rows, "doc_id long, key long, n_shingles long, component long")
    texts = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    sets = texts.mapInArrow(neardup._sets, "doc_id long, size long, sketch binary, hashes binary")
    for block in (64, 1024):  # each pair once, in the first bucket that both are in
        assert sorted((r["v"], r["u"]) for r in neardup._remaining(members, sets, block).collect()) == pairs, block


def test_bounds_drop_no_link():
    rng = random.Random(3)
    sets = []
    for n in (3, 4, 10, 60, 400, 3000):
        base = [rng.getrandbits(64) for _ in range(n)]
        for _ in range(8):
            cut = rng.sample(base, n - rng.randrange(0, n // 4 + 1))
            sets.append(np.unique(np.array(cut + [rng.getrandbits(64) for _ in range(rng.randrange(0, n // 6 + 1))], np.uint64)))
    sketch = neardup.parity_sketches(sets)
    ids, n = np.arange(len(sets)), np.array([len(s) for s in sets])
    found = [tuple(p) for x in neardup._block_pairs(ids, n, ids, sketch, ids < 0, False) for p in x.tolist()]
    alike = set()
    for v, u in combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[u], sets[v]))
        if 100 * both >= 75 * (len(sets[u]) + len(sets[v]) - both):
            alike.add((u, v))
    assert alike and alike <= set(found) and len(found) == len(set(found))


def test_members_of_a_large_component_do_not_meet(spark):
    """Rows that meet and pairs that are looked at: strays meet the component, its members not each other."""
    members = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(5).cast("long").alias("key"), F.when(F.col("id") < 1995, 0).otherwise(F.col("id")).alias("component"))
    sketch = F.lit(bytes(8 * (1 << (neardup.SKETCH_BITS - 6)) + 8 * neardup.BINS // neardup.ROWS))
    sets = members.select("doc_id", F.lit(40).cast("long").alias("size"), sketch.alias("sketch"))
    n = neardup._blocks(members, sets, block=100).groupBy("key", "i", "j")
    n = n.agg(F.count(F.when(F.col("block") == F.col("i"), 1)).alias("a"), F.count(F.when(F.col("block") != F.col("i"), 1)).alias("b")).collect()
    assert sum(r["a"] + r["b"] for r in n) == 1995 + 5 * 21  # each member once, each stray with 20 chunks and its own block
    assert sum(r["a"] * (r["b"] or r["a"]) for r in n) == 1995 * 5 + 25


def test_all_links_of_a_bucket_with_a_large_component_are_found(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:59] + [f"t{i % 40}"])) for i in range(400)]  # one component of near copies
    rows += [(1000 + i, " ".join(base[: 52 - i] + [f"u{i}x{k}" for k in range(8)])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = {k: a if v == b else v for k, v in group.items()}
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == group


def test_the_row_of_the_least_text_stays_of_a_repeated_id(spark):
    rows = [(1, "b b b", "x"), (1, "a a a", "y"), (1, None, "z"), (2, "c c c", "x")]
    out = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect()
    assert {(r["doc_id"], r["row"]) for r in out} == {(1, "y"), (2, "x")} and len(out) == 2


def test_memory_of_a_worker_does_not_go_by_the_rows_of_long_texts():
    import tracemalloc

    rng = np.random.default_rng(2)
    words = np.array([f"word{i}" for i in range(5000)])
    texts = [" ".join(words[rng.integers(0, len(words), 6000)]) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    for made in (neardup._signatures, neardup._sets):
        tracemalloc.start()
        rows = [r.num_rows for r in made([batch])]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(rows) == 1000 and peak < 150e6, (made.__name__, peak)


def test_slices_of_texts_have_the_rows_of_the_batch_in_order():
    texts = ["a" * 3, None, "", "é" * 5, "b" * 30, "c", "d" * 4, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array(["z" * 99, *texts])], ["doc_id", "text"]).slice(1)
    for rows in (1, 3, 100):
        for size in (1, 10, 1000):
            got = list(common.pieces(batch, rows, size))
            assert pa.Table.from_batches(got).to_pydict() == batch.to_pydict()
            assert all(0 < x.num_rows <= rows and (x.num_rows == 1 or sum(len((t or "").encode()) for t in x.column("text").to_pylist()) <= size) for x in got)
    assert not list(common.pieces(batch.slice(0, 0), 3))
