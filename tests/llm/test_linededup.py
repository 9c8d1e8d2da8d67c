from pyspark.sql import functions as F

from tallyroom.llm import linededup

LINE = "This line stands on many different sites"


def _rows():
    rows = [(i, f"own text number {i} goes here\n  {LINE} \nshort", f"site{i % 12}") for i in range(24)]
    rows += [(100 + i, f"A line on three sites only, no more\n{LINE}" if i == 0 else "A line on three sites only, no more", f"site{i}") for i in range(3)]
    return rows


def _brute(rows, min_sites):
    sites, first = {}, {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            line = line.strip(linededup.BLANKS)
            if line:
                sites.setdefault(line, set()).update({s} - {None})
                first[line] = min(first.get(line, i), i)
    spread = {x for x, s in sites.items() if len(s) >= min_sites}
    bare = lambda line: line.strip(linededup.BLANKS)
    keep = lambda i, line: not (bare(line) in spread and i > first[bare(line)])
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if keep(i, x)) for i, t, _ in rows}


def test_matches_brute_force_at_several_thresholds(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in (2, 3, 4, 11, 12, 13):
        out = linededup.without_spread_lines(df, min_sites=n).collect()
        assert {r["doc_id"]: r["text"] for r in out} == _brute(rows, n), n
        assert all(r["n_removed"] == dict((i, t.count("\n")) for i, t, _ in rows)[r["doc_id"]] - r["text"].count("\n") for r in out if r["text"])


def test_line_ends_and_names_of_the_callers_columns_do_not_matter(spark):
    rows = [(i, f"own {i}\n{LINE}" + "\r" * (i % 2) + "\nLes.", f"s{i}", "a", "b") for i in range(9)]
    out = linededup.without_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string, lost string, _lost string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {i: t if i == 0 else f"own {i}" for i, t, *_ in rows}
    assert {(r["lost"], r["_lost"]) for r in out} == {("a", "b")}


def test_edges(spark):
    rows = [(None, LINE, f"s{i}", "x") for i in range(4)] + [(i, LINE, f"s{i}" if i % 2 else None, "x") for i in range(20)] + [(50, None, "s", "x"), (51, "", "s", "x"), (52, (LINE + "\n") * 5000, "s9", "x"), (52, (LINE + "\n") * 5000, "s9", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines string")
    out = linededup.without_spread_lines(df).collect()
    assert len(out) == len(rows)
    assert all(r["text"] == LINE for r in out if r["doc_id"] is None or r["doc_id"] == 0)
    assert {(r["text"], r["n_lines"], r["n_removed"]) for r in out if r["doc_id"] == 50} == {(None, 0, 0)}
    assert [(r["text"], r["n_lines"], r["n_removed"]) for r in out if r["doc_id"] == 52] == [("", 5001, 5000)] * 2
    assert linededup.without_spread_lines(df.limit(0)).count() == 0


def test_a_hot_line_merges_into_one_sketch(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(LINE).alias("text"), (F.col("id") % 300).cast("string").alias("source"))
    assert linededup.spread_lines(df).count() == 1
    assert linededup.without_spread_lines(df).filter("text <> ''").count() == 1
