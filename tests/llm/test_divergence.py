import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tallyroom.llm import divergence, transducer

SHAPE = "lang string, source string, text string"


def _terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def _brute(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        docs[lang].update(set(_terms(text)))
        counts[lang, source].update(_terms(text))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        p = {}
        for s, c in [*((s, counts[lang, s]) for s in sources), (None, whole)]:
            n = sum(c[t] for t in kept)
            p[s] = [1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept]
        utf8 = lambda x: (-x[1], x[0].encode())
        for s in sources:
            pairs = [(o, sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True))) for o in sources if o != s]
            best = [(t, a - b) for t, a, b in zip(kept, p[s], p[None], strict=True) if counts[lang, s][t] and a > b]
            out |= {(lang, s, "pair", i, v, r) for r, (i, v) in enumerate(sorted(pairs, key=utf8), 1)}
            out |= {(lang, s, "term", i, v, r) for r, (i, v) in enumerate(sorted(best, key=utf8)[:top], 1)}
    return out


def _rows(n=300, seed=3):
    rng = random.Random(seed)
    words = ["Ab", "abc", "é", "éa", "zug", "Zug", "ab9cd", "x_y", "日本", "don't", *(f"w{chr(97 + i)}" for i in range(26))]
    return [(rng.choice(["en", "en", "de", None, ""]), rng.choice(["s", "s", "s", "t", "é", None]), " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(n)]


def _got(df, **more):
    return [tuple(r) for r in divergence.source_divergence(df, **more).select("lang", "source", "part", "item", "value", "rank").collect()]


def test_equals_brute_force(spark):
    rows = _rows()
    for least, top in ((5, 50), (30, 3), (10_000, 50)):
        got = _got(spark.createDataFrame(rows, SHAPE), min_documents=least, top=top)
        assert len(got) == len(set(got)) and set(got) == _brute(rows, least, top), least


def test_small_blocks_ranges_and_passes_change_nothing(spark, monkeypatch):
    rows = _rows()
    df = spark.createDataFrame(rows, SHAPE)
    kept = df.selectExpr("'en' AS lang", "explode(array('b', 'ba', 'é', 'a', 'zz', 'ab')) AS term").distinct()
    machines = divergence.vocabulary(kept, range_terms=2)
    assert len(divergence.passes(machines, most=1)) == machines.count() > 1
    keys = [transducer.Transducer.loads(bytes(r["machine"])).key(i) for r in machines.orderBy("range").collect() for i in range(r["terms"])]
    assert keys == [b"en\0" + t.encode() for t in ("a", "ab", "b", "ba", "zz", "é")]
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 1)
    monkeypatch.setattr(divergence, "HELD", 4)
    monkeypatch.setattr(divergence, "PASS_BYTES", 1)
    one = divergence.vocabulary
    monkeypatch.setattr(divergence, "vocabulary", lambda k: one(k, range_terms=40))
    monkeypatch.setattr(divergence, "passes", lambda v, f=divergence.passes: f(v, 1))
    assert set(_got(df, min_documents=5)) == _brute(rows, 5, 50)


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None)], SHAPE)
    assert _got(df) == [] and _got(df.limit(0)) == []
    rows = [("en", s, "same words") for s in ("a", "b", "a", "b")] + [("fr", "a", None), ("fr", "b", "!?"), ("fr", "é", "")]
    wide = spark.createDataFrame([(*r, i, "x", "y") for i, r in enumerate(rows)], f"{SHAPE}, doc_id int, ordinal string, rank string")
    assert set(_got(wide, min_documents=4)) == _brute(rows, 4, 50)
    long = [("en", "a", "Lorem, ipsum1dolor " * 200_000), ("en", "b", "x" * 3_000_000 + " lorem")]
    assert set(_got(spark.createDataFrame(long, SHAPE), min_documents=1)) == _brute(long, 1, 50)


def test_shares_are_exact_beyond_64_bits():
    rng = random.Random(1)
    for _ in range(200):
        total, terms = rng.randint(0, 8 * 10**15), rng.randint(1, 10**9)
        count = rng.randint(0, total)
        assert int(divergence.share(np.array([count]), total, terms)[0]) == 1 + 10**9 * (count + 5) // (total + 5 * terms)


def test_transducer_is_minimal_and_ordinals_are_places():
    rng = random.Random(5)
    keys = sorted({bytes(rng.choices(b"abc\xc3\xa9", k=rng.randint(1, 9))) for _ in range(3000)} | {b"plays", b"played", b"play", b"stays", b"stayed", b"stay"})
    machine = transducer.Transducer.loads(transducer.built(keys).dumps())
    assert [machine.key(i) for i in range(len(keys))] == keys and machine.size == len(keys)
    # no two states accept the same endings
    def endings(state):
        out = {b""} if machine.final[state] else set()
        for slot in np.flatnonzero(machine.check == state).tolist():
            out |= {bytes([slot - int(machine.base[state])]) + x for x in endings(int(machine.target[slot]))}
        return frozenset(out)
    every = [endings(s) for s in range(len(machine.base))]
    assert len(set(every)) == len(every)
    table = np.arange(256, dtype=np.uint8)
    table[32] = 0
    texts = pa.array(["play stays nothere", "", None, "stayed", "  ", "playsstay"])
    places = []
    for data, starts, row in transducer.words(texts, table):
        got = machine.ordinals(data, starts, np.full(len(starts), machine.root), np.zeros(len(starts), np.int64))
        places += list(zip(row.tolist(), got.tolist(), strict=True))
    assert places == [(0, keys.index(b"play")), (0, keys.index(b"stays")), (0, -1), (3, keys.index(b"stayed")), (5, -1)]
    assert transducer.built([]).size == 0 and transducer.built([]).prefix(b"a") == (-1, 0)
