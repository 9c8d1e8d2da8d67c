"""URL filter: rules first, then trust and distrust propagated over the host graph.

Native throughout. Host edges come from absolute links in pages and from domains that contain one
another. Personalised PageRank spreads trust from hosts whose pages a rule allows; on the reversed
edges it spreads distrust from hosts whose pages a rule blocks. A host with more distrust than trust is
blocked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm import common

#: Fixed values of the contract: (rule, action).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
DAMPING = 0.85
STEPS = 12
STORE_EVERY = 4
RATIO = 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = "(?i)href\\s*=\\s*[\"']?(?:https?:)?//([^/?#\"'\\s>]+)"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits and its action, or nulls; of equal lengths a block goes first.

    The rules are a short fixed list (at most 500), so they are one conditional expression.
    """
    if len(rules) > 500:
        raise ValueError("more than 500 rules")
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block", r[0])):
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts: links counted, and each host joined to the domains it is part of."""
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"), F.lit(1.0).alias("w"))
    hosts = pages.filter("host <> ''").groupBy("host").agg(F.count("*").cast("double").alias("w"))
    labels = F.split("host", "\\.")
    up = hosts.select("host", "w", F.explode(F.sequence(F.lit(2), F.size(labels))).alias("at"), labels.alias("labels")).filter("size(labels) >= 3")
    up = up.filter("at <= size(labels) - 1").select("host", "w", F.expr("array_join(slice(labels, at, size(labels)), '.')").alias("part_of"))
    up = up.filter(F.col("part_of").contains("."))
    inside = up.select(F.col("host").alias("src"), F.col("part_of").alias("dst"), "w")
    outside = up.select(F.col("part_of").alias("src"), F.col("host").alias("dst"), "w")
    every = links.unionAll(inside).unionAll(outside).filter("src <> dst")
    return every.groupBy("src", "dst").agg(F.sum("w").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank of each kind: edges (kind, src, dst, weight), seeds (kind, host, seed) -> (kind, host, rank).

    A seed's shares add up to one for each kind; what reaches a host without edges out ends there.
    """
    total = seeds.groupBy("kind").agg(F.sum("seed").alias("total"))
    seeds = common.stored(seeds.join(total, "kind").filter("total > 0").select("kind", "host", (F.col("seed") / F.col("total")).alias("rank")), "uf-seeds")
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    shares = edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share"))
    shares = common.stored(shares, "uf-shares")
    start = seeds.select("kind", "host", (F.col("rank") * (1 - damping)).alias("rank"))
    ranks = seeds
    for step in range(1, steps + 1):
        moved = shares.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"])
        moved = moved.select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        ranks = moved.unionAll(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if step % STORE_EVERY == 0 or step == steps:
            ranks = common.stored(ranks, "uf-ranks")
    return ranks


def judged(pages: DataFrame, rules=RULES, ratio: float = RATIO) -> DataFrame:
    """Every row of ``pages`` with page_id, host, path, rule, verdict, trust and distrust.

    A null url, or one without ``://``, has empty host and path, no rule and is allowed; a null html
    has no links. Repeated rows are judged alike and all returned; other columns are left out.
    Ranks are rounded to 12 places before they are compared; a tie is allowed.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("action", action)
    edges = host_edges(parsed)
    seen = parsed.filter("host <> ''").groupBy("host")
    seen = seen.agg(F.count(F.when(F.col("action") == "allow", 1)).alias("allow"), F.count(F.when(F.col("action") == "block", 1)).alias("block"))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionAll(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    seeds = seen.select("host", F.explode(F.create_map(F.lit("trust"), F.col("allow").cast("double"), F.lit("distrust"), F.col("block").cast("double"))).alias("kind", "seed"))
    ranks = propagate(common.stored(both, "uf-edges"), seeds.filter("seed > 0").select("kind", "host", "seed"))
    by_host = ranks.groupBy("host").agg(
        F.round(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)), 12).alias("trust"),
        F.round(F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)), 12).alias("distrust"),
    )
    out = parsed.drop("html").join(common.stored(by_host, "uf-hosts"), "host", "left")
    blocked = F.coalesce(F.col("distrust") > F.col("trust") * ratio, F.lit(False))
    verdict = F.coalesce(F.col("action"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    zero = F.lit(0.0)
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))
