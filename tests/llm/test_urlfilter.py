import re

import pytest
from pyspark.sql import functions as F

from tallyroom.llm import urlfilter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(LOWER)
    best = None
    for rule, _ in urlfilter.RULES:
        site, _, tail = rule.partition("/")
        if (host == site or host.endswith("." + site)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG", "https://EXAMPLE.org/es/1", "http://a.example.org/es/x?y#z", "http://example.org/en/1", "http://example.org/en/19/", "http://example.org/en/2",
    "http://xexample.org/es/", "http://org/x", "http://a.com/fr/", "http://a.com/fr", "http://a.com/de/?x://y", "http://a.com?/de/", "http://a.com#/de/", "ftp://b.COM/DE/", "x://y://z.org/p", "http://é.org/É", "http://h\n.org/a\nb", "://c.org/", "http://net/a",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("html", F.lit(None).cast("string")).withColumn("host", F.lit("clash"))
    rows = {r["page_id"]: r for r in urlfilter.judged(df).collect()}
    for i, url in enumerate(URLS):
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == _brute(url), url
        if rows[i]["rule"]:
            assert rows[i]["verdict"] == dict(urlfilter.RULES)[rows[i]["rule"]]


def test_propagation_matches_brute_force(spark):
    edges = [("trust", "a", "b", 2.0), ("trust", "a", "c", 1.0), ("trust", "b", "c", 1.0), ("trust", "c", "a", 5.0), ("trust", "d", "a", 1.0), ("distrust", "b", "a", 1.0)]
    seeds = [("trust", "a", 3.0), ("trust", "d", 1.0), ("distrust", "b", 2.0)]
    got = {(r["kind"], r["host"]): r["rank"] for r in urlfilter.propagate(spark.createDataFrame(edges, "kind string, src string, dst string, weight double"), spark.createDataFrame(seeds, "kind string, host string, seed double")).collect()}
    for kind in ("trust", "distrust"):
        own = [e[1:] for e in edges if e[0] == kind]
        start = {h: s for k, h, s in seeds if k == kind}
        start = {h: s / sum(start.values()) for h, s in start.items()}
        rank = dict(start)
        for _ in range(urlfilter.STEPS):
            new = {h: s * (1 - urlfilter.DAMPING) for h, s in start.items()}
            for src, dst, w in own:
                out = sum(x[2] for x in own if x[0] == src)
                new[dst] = new.get(dst, 0) + urlfilter.DAMPING * rank.get(src, 0) * w / out
            rank = new
        for h, x in rank.items():
            assert got[kind, h] == pytest.approx(x)


def test_links_carry_trust_and_distrust(spark):
    good, bad = 'x <a href="https://Friend.net/p?q">f</a>', "<a href='//evil.com/de/1'>e</a>"
    rows = [(1, "https://good.org/a", good), (2, "http://linker.net/b", bad), (3, "http://evil.com/de/1", None), (4, "http://friend.net/", ""), (5, "http://alone.net/", "<a href='/x'>"), (5, "http://alone.net/", "<a href='/x'>")]
    got = [(r["page_id"], r["verdict"]) for r in urlfilter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == [(1, "allow"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (5, "allow")]


def test_no_rows(spark):
    assert urlfilter.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
