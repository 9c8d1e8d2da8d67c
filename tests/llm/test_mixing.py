import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroom.llm import mixing, registry

DOMAINS = {"good": ["the", "ing", "wh", "ou"], "bad": ["zz", "qq", "xx"], "odd": ["é", "ß", "ñ"]}


def _tables(spark, n=240):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        d = rng.choice(list(DOMAINS))
        docs.append((i, " ".join("".join(rng.choice(DOMAINS[d]) for _ in range(3)) for _ in range(rng.randrange(1, 80))), "x"))
        if i % 2:
            labels.append((i, d))
    return spark.createDataFrame(docs, "doc_id long, text string, rate string"), spark.createDataFrame(labels, "doc_id long, d string")


def test_expected_totals_match_targets(spark):
    docs, labels = _tables(spark)
    targets = {"good": 0.7, "odd": 0.25, "bad": 0.05}
    rows = mixing.mixed(docs, labels, F.col("d"), targets, budget=0.6).collect()
    assert len(rows) == 240 and all(r["rate"] >= 0 for r in rows)
    n, r, p = (np.array([x[k] for x in rows]) for k in ("n_tokens", "rate", "posteriors"))
    assert np.allclose(p.sum(axis=1), 1)
    assert (r * n) @ p == pytest.approx(np.array([0.05, 0.7, 0.25]) * 0.6 * n.sum(), rel=0.01)  # by name: bad, good, odd


def _plain(n, p, goal, budget, steps):
    """Least misfit of accelerated projected gradient in numpy, started again where it overshoots."""
    w = n / n.sum()
    safe = 1 / np.linalg.eigvalsh((p * w[:, None]).T @ p)[-1]
    r = y = np.full(len(n), budget)
    t, last = 1.0, np.inf
    for _ in range(steps):
        new = np.maximum(0, y - safe * (p @ ((y * w) @ p - goal)))
        miss = np.linalg.norm((new * w) @ p - goal)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (before - 1) / t * (new - r) if miss <= last else new
        t = t if miss <= last else 1.0
        r, last = new, min(last, miss)
    return last


@pytest.mark.parametrize("targets", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.98, "b": 0.01, "c": 0.01}, {"c": 1.0}])
def test_fit_matches_plain_projected_gradient(spark, targets):
    rng = np.random.default_rng(1)
    for sharp in (0.2, 1.0, 8.0):  # blunt posteriors can't reach every target
        p = rng.dirichlet(np.full(3, sharp), 200)
        n = rng.integers(0, 100, 200).astype(float)
        table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, posteriors array<double>")
        length, misfit, goal, reached = mixing.fitted(table, ["a", "b", "c"], targets, 0.4)
        rates = mixing.stepped(p, 0.4, length, misfit)
        assert (rates >= 0).all() and (rates * n) @ p / n.sum() == pytest.approx(reached, abs=1e-9)
        assert np.linalg.norm(reached - goal) <= 1.01 * _plain(n, p, goal, 0.4, 20_000) + 1e-4


@pytest.mark.parametrize(("sf", "steps"), [("sf0.01", 20_000), ("sf0.1", 4_000)])
def test_fit_of_the_given_tables_is_converged(spark, sf, steps):
    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    out, fit = mixing.mixture(docs.select("doc_id", "text"), labels, registry.label_domain(), registry.TARGETS)
    rows = out.select("n_tokens", "posteriors", "rate").toPandas()
    n, p, fit = rows["n_tokens"].to_numpy(float), np.stack(rows["posteriors"]), fit.toPandas()
    assert (rows["rate"].to_numpy() * n) @ p / n.sum() == pytest.approx(fit["reached"].to_numpy(), abs=1e-9)
    assert np.linalg.norm(fit["misfit"]) <= 1.01 * _plain(n, p, fit["target"].to_numpy(), mixing.BUDGET, steps) + 1e-4


def test_edges(spark):
    docs, labels = _tables(spark, 60)
    more = spark.createDataFrame([(900, None, "x"), (901, "", "x"), (None, "the ing", "x"), (None, "the ing", "x"), (902, "zz " * 40_000, "x")], "doc_id long, text string, rate string")
    more_labels = spark.createDataFrame([(None, "good"), (1, None), (900, "good"), (12345, "bad"), (3, "aaa")], "doc_id long, d string")
    out = mixing.mixed(docs.unionAll(more), labels.unionAll(more_labels), F.col("d"), {"good": 1.0})
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 65 and rows[900]["n_tokens"] == 0 and rows[902]["n_tokens"] == 40_000
    none = mixing.mixed(docs, labels.limit(0), F.col("d"), {"good": 1.0}, budget=0.3)
    assert {(r["rate"], r["domain"]) for r in none.collect()} == {(0.3, None)}
    clashing = docs.limit(5).withColumns({"_lower": F.lit(1), "lower": F.lit(2), "row": F.lit(3), "letter": F.lit(4)})
    assert {(r["_lower"], r["lower"], r["row"], r["letter"]) for r in mixing.mixed(clashing, labels, F.col("d"), {"good": 1.0}).collect()} == {(1, 2, 3, 4)}
    assert mixing.mixed(docs.limit(0), labels, F.col("d"), {"good": 1.0}).count() == 0
