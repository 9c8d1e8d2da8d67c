import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyroom.llm import sharding


def _brute(rows, shards, seed=sharding.SEED):
    """(doc_id, shard, slot) by plain sorting; ids are unique and not null."""
    md5 = lambda x: hashlib.md5(f"{seed}:{x}".encode()).hexdigest()
    by = defaultdict(list)
    for doc, source in rows:
        by[source].append(doc)
    order = []
    for source, docs in by.items():
        for r, doc in enumerate(sorted(docs, key=md5), 1):
            order.append(((2 * r - 1) / (2 * len(docs)), md5(source or ""), source or "", r, doc))
    order.sort()
    out, n = set(), len(order)
    for at, x in enumerate(order):
        shard = at * shards // n
        out.add((x[-1], shard, at - (shard * n + shards - 1) // shards))
    return out


def test_equals_brute_force_with_any_slices(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    for least in (1024, 1 << 14):
        monkeypatch.setattr(sharding, "LEAST_SLICES", least)
        for shards in (1, 7, 24):
            assert {tuple(r) for r in sharding.interleaved(df, shards).select("doc_id", "shard", "slot").collect()} == _brute(rows, shards)


def test_shards_are_even_gapless_and_have_the_mixture(spark):
    df = spark.range(5003).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 10).cast("string"))).alias("source"))
    out = sharding.interleaved(df).collect()
    by, all_ = defaultdict(list), Counter(r["source"] for r in out)
    for r in out:
        by[r["shard"]].append(r)
    assert len(out) == 5003 and sorted(by) == list(range(24))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        here = Counter(r["source"] for r in rows)
        assert all(abs(here[s] - n / 24) <= 2 for s, n in all_.items())


def test_edges(spark):
    rows = [(None, "s", "a", 1)] * 5 + [(1, "s", "b", 2)] * 3 + [(2, None, None, 3), (3, "", "", 4), (4, "s", "x" * 2_000_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, shard int").withColumn("slice", F.lit("k")).withColumn("row", F.create_map(F.lit("a"), F.lit(1)))
    out = sharding.interleaved(df, 4).collect()
    assert Counter((r["doc_id"], r["source"], r["text"], r["slice"], r["row"]["a"]) for r in out) == Counter((*r[:3], "k", 1) for r in rows)
    assert sorted(Counter(r["shard"] for r in out).values()) == [2, 3, 3, 3] and len({(r["shard"], r["slot"]) for r in out}) == 11
    assert sharding.interleaved(df.limit(0)).count() == 0
    few = sharding.interleaved(df.limit(2), 24).collect()
    assert len(few) == 2 and all(0 <= r["shard"] < 24 and r["slot"] == 0 for r in few)


def test_files_hold_each_row_once_in_slot_order(spark, tmp_path):
    rows = [(i // 2, f"s{i % 4}", "twice" if i % 2 else f"text {i}") for i in range(100)] + [(7, "s1", "twice")] * 3 + [(None, "s1", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sharding.write_shards(df, str(tmp_path / "out"), shards=5)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r["doc_id"], r["source"], r["text"]) for r in back) == Counter(rows)
    assert sorted(Counter(r["shard"] for r in back).values()) == [21] * 5 and len({(r["shard"], r["slot"]) for r in back}) == 105


def test_main_path_is_native(spark, capsys):
    sharding.interleaved(spark.createDataFrame([(1, "s")], "doc_id long, source string")).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
