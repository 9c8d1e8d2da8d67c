import math
import random
import re
from collections import Counter

import numpy as np

from tallyroom.llm import lexical

DOCS = "doc_id long, text string"


def _terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(lexical._TERM, lower)


def _brute(docs, items, top=20):
    bags = [(i, Counter(_terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = set()
    for item, text in items:
        scored = []
        for i, b, length in bags:
            m, s = 75 + (25 * length * n) // total, 0
            for t in _terms(text):
                if t in b:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    s += w * ((10**9 * b[t]) // (1000 * b[t] + 12 * m))
            if s > 0 and i is not None:
                scored.append((-s, i))
        out |= {(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:top], 1)}
    return out


def _made(seed, docs=200, items=40):
    rng = random.Random(seed)
    words = [f"w{int(rng.expovariate(0.05))}" for _ in range(400)] + ["É1", "Zoo", "zoo", "a-b"]
    text = lambda k: " ".join(rng.choices(words, k=k))
    made = [(i, text(rng.randint(0, 60))) for i in range(docs)]
    made += [(1000 + i, made[3][1]) for i in range(50)]
    return made, [(i, text(rng.randint(0, 30))) for i in range(items)]


def _got(spark, docs, items, **more):
    out = lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), **more)
    return [tuple(r) for r in out.select("item_id", "rank", "doc_id", "score").collect()]


def test_equals_brute_force(spark):
    docs, items = _made(1)
    got = _got(spark, docs, items)
    assert len(got) == len(set(got)) and set(got) == _brute(docs, items)


def test_passes_dags_and_blocks_change_nothing(spark, monkeypatch):
    docs, items = _made(2)
    for name, value in (("PASS_TERMS", 250), ("DAG_ITEMS", 5), ("CELLS", 300)):
        monkeypatch.setattr(lexical, name, value)
    assert set(_got(spark, docs, items, top=7)) == _brute(docs, items, 7)


def test_shared_sets_are_evaluated_once():
    rng = random.Random(4)
    common_ = [dict.fromkeys(rng.sample(range(60), 12), 1) for _ in range(4)]
    bags = [{**rng.choice(common_), **{rng.randrange(60, 90): rng.randint(1, 3) for _ in range(4)}} for _ in range(50)]
    dag = lexical.shared(list(range(50)), bags)
    gains = np.array([[rng.randrange(1000) for _ in range(9)] for _ in range(90)])
    want = np.array([sum(k * gains[t] for t, k in bag.items()) for bag in bags])
    assert np.array_equal(lexical.evaluated(dag, gains), want)
    plain = sum(len(b) - 1 for b in bags)
    assert sum(len(a) for a, _ in dag.levels) + len(dag.nodes) - 50 < plain / 2


def test_edges(spark):
    docs = [(None, "apple pie"), (1, None), (2, ""), (3, "!!"), (4, "Apple"), (4, "Apple"), (5, "pear " * 300_000 + "apple"), (6, "x" * 2_000_000), (7, "plum")]
    items = [(1, "apple APPLE tart"), (2, None), (3, "..."), (4, "nothing"), (None, "apple"), (5, "pear"), (5, "pear")]
    want = _brute(docs, [(1, items[0][1]), (5, "pear")])
    assert set(_got(spark, docs, items)) == want and {x[0] for x in want} == {1, 5}
    assert sorted(x[2] for x in _got(spark, docs, items) if x[0] == 1) == [4, 4, 5]
    for d, i in ((docs[:0], items), (docs, items[:0]), (docs[1:4], items)):
        assert _got(spark, d, i) == []
    wide = spark.createDataFrame([(1, "apple", 5, 6)], "doc_id int, text string, terms int, score int")
    out = lexical.search(wide, spark.createDataFrame([("a", "apple"), ("b", "pie")], "item_id string, text string"))
    assert [tuple(r)[:3] for r in out.collect()] == [("a", 1, 1)]
