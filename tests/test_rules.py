"""Single rules on hand-written rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyroom.functions import text as T
from tallyroom.operators import access, forest, intake
from tallyroom.streaming import jobs


def test_model_text(spark):
    given = ["```Ramesh```", "BLANK\n", "\tRamesh ", "```TEXT\nRamesh\n```", "unknown", "", "a\nb", "x" * 181, "{x}", None, "x" * 180]
    want = ["Ramesh", "", "Ramesh", "Ramesh", "", None, None, None, None, None, "x" * 180]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", T.clean_model_text(F.col("t")).alias("t"))
    assert [r["t"] for r in rows.orderBy("i").collect()] == want


@pytest.mark.parametrize("head", [1, 2, 100])
def test_files_are_admitted_one_after_the_other(spark, monkeypatch, head):
    monkeypatch.setattr(intake, "HEAD", head)
    needs = [(1, 50), (2, 60), (3, 30), (4, 25), (5, 20), (6, 1)]
    for free in (0, 79, 80, 100, 105, 186, 10**12):
        left, want = free, []
        for i, n in needs:
            if n <= left:
                left -= n
                want.append(i)
        rows = spark.createDataFrame(needs, "file_id long, need long")
        assert sorted(r["file_id"] for r in intake.admitted(rows, free).collect()) == want, free


def test_progress_counts_each_place_of_a_batch_once(spark):
    papers = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0)], "batch_id long, idx long")
    batches = spark.createDataFrame([(1, 2), (2, 2)], "batch_id long, total long")
    rows = jobs.stream_batch_progress(papers, batches).collect()
    assert {(r["batch_id"], r["stored"], r["ready"]) for r in rows} == {(1, 2, True), (2, 1, False)}


def _attempts(seed):
    rng = random.Random(seed)
    rows, at = [], {k: 0 for k in ("a", "b", None)}
    for i in range(400):
        key = rng.choice(["a", "a", "b", None])
        at[key] += rng.choice([0, 1, 3, 9, 10, 11, 40])
        rows.append((i, key, at[key], rng.random() < 0.1))
    return rows


def test_login_rules_against_a_plain_walk(spark):
    rows = _attempts(4)
    df = spark.createDataFrame(rows, "event_id long, key string, ms long, success boolean").repartition(3)
    allowed, refused, windows, records = {}, {}, {}, {}
    for event, key, ms, success in sorted(rows, key=lambda r: (r[2], r[0])):
        begun, n = windows.get(key, (None, 0))
        begun, n = (ms, 1) if begun is None or ms >= begun + 10 else (begun, n + 1)
        windows[key] = begun, n
        allowed[event] = n <= 2
        seen = [t for t in records.get(key, []) if t > ms - 10]
        refused[event] = len(seen) >= 2
        records[key] = seen if refused[event] else [] if success else [*seen, ms]
    assert {r["event_id"]: r["allowed"] for r in access.login_throttle(df, 2, 10).collect()} == allowed
    assert {r["event_id"]: r["refused"] for r in access.failed_login_burst(df, 2, 10).collect()} == refused
    assert len(set(allowed.values())) == len(set(refused.values())) == 2


def test_login_rules_without_attempts(spark):
    df = spark.createDataFrame([], "event_id long, key string, ms long, success boolean")
    assert access.login_throttle(df).count() == access.failed_login_burst(df).count() == 0


def test_throttle_step_carries_its_window_over_batches():
    import numpy as np

    from tallyroom.streaming import logins

    ms = np.array(sorted(r[2] for r in _attempts(5) if r[1] == "a"))
    whole, _, _ = logins.throttled(ms, 0, 0, 2, 10)
    assert whole.tolist() == access._throttle(ms, 2, 10).tolist()
    pieces, count, reset_at = [], 0, 0
    for i in range(0, len(ms), 7):
        out, count, reset_at = logins.throttled(ms[i : i + 7], count, reset_at, 2, 10)
        pieces += out.tolist()
    assert pieces == whole.tolist()


def test_a_session_ends_by_a_pause_or_by_age(spark):
    day = 24 * 3600 * 1000
    steps = range(0, 8 * day, access.IDLE_MS - 1)
    rows = [("k", m, i) for i, m in enumerate(steps)] + [("k", 9 * day, 9_000), ("z", 5, 1), ("z", 5, 1)]
    got = access.idle_sessions(spark.createDataFrame(rows, "key string, ms long, event_id long")).orderBy("key", "session").collect()
    young = [m for m in steps if m < 7 * day]
    assert [(r["key"], r["session"], r["started"], r["ended"], r["n"]) for r in got] == [
        ("k", 1, 0, young[-1], len(young)),
        ("k", 2, steps[len(young)], steps[-1], len(steps) - len(young)),
        ("k", 3, 9 * day, 9 * day, 1),
        ("z", 1, 5, 5, 2),
    ]


def test_forest_against_a_plain_walk():
    trees = forest.example_forest(6, 3)
    features = np.random.default_rng(3).integers(-4, 16, (50, 3 * forest.RAW)) / 2.0

    def leaf(row, tree):
        at = 0
        while tree["left"][at] != -1:
            at = tree["left" if row[tree["feature"][at]] <= tree["threshold"][at] else "right"][at]
        return tree["positive"][at]

    want = [sum(leaf(row, t) for t in trees) / len(trees) for row in features.astype(np.float32)]
    assert np.allclose(forest.forest_scores(features, trees), want)
    assert len(forest.forest_scores(features[:0], trees)) == 0
    with pytest.raises(ValueError, match="finite"):
        forest.forest_scores(np.full((1, 3 * forest.RAW), np.nan), trees)


def test_relative_features_of_one_row():
    raw = np.zeros((1, 4, forest.RAW))
    raw[0, :, 0] = [4, 1, 3, 3]
    out = forest.relative_features(raw)
    assert out.shape == (1, 4, 3 * forest.RAW)
    assert out[0, :, forest.RAW].tolist() == [0.8, 0.2, 0.6, 0.6]
    assert out[0, :, 2 * forest.RAW].tolist() == [1, -2, 0, 0]
