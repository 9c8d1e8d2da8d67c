"""Queries of the operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm import decontaminate, divergence, langid, lexical, licenses, linededup, mixing, neardup, ngram_lm, quality, sharding, toolcalls, urlfilter
from tallyroom.llm.common import table
from tallyroom.llm.oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def _crc(mod: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % mod


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judged(table(spark, sf_dir, "pages"))
    return out.withColumn("trust", F.round("trust", 9)).withColumn("distrust", F.round("distrust", 9))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.without_spread_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("kept_chars"), F.md5(text).alias("kept_md5"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The tools that the conversations' derived calls name, with their fields.
TOOLS = (
    ("lookup", "limit", "integer", True),
    ("lookup", "query", "string", True),
    ("search", "limit", "integer", False),
    ("search", "query", "string", True),
    ("summarise", "query", "string", True),
)


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls and results derived from plain turns, which hold none themselves.

    A user turn is a call whose arguments carry its whole text; an assistant turn is the result of the
    call of the turn before. Text lengths choose the tool, a wrong or absent limit, and whether the call
    uses the result of the user turn before.
    """
    n = F.length("text")
    name = F.when(n % 3 == 0, "search").when(n % 3 == 1, "lookup").otherwise("summarise")
    odd = F.to_json(F.struct(F.col("text").alias("query"), n.cast("string").alias("limit")))
    bare = F.to_json(F.struct(F.col("text").alias("query")))
    arguments = F.when(n % 7 == 0, odd).when(n % 5 == 0, bare).otherwise(F.to_json(F.struct(F.col("text").alias("query"), n.alias("limit"))))
    calls = turns.filter("role = 'user'").select(
        "conv_id",
        "turn",
        F.concat(F.lit("call-"), F.col("turn").cast("string")).alias("call_id"),
        name.alias("name"),
        arguments.alias("arguments"),
        F.when(n % 2 == 0, F.array(F.concat(F.lit("call-"), (F.col("turn") - 2).cast("string")))).alias("uses"),
    )
    results = turns.filter("role = 'assistant'").select(
        "conv_id", "turn", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(TOOLS, "name string, field string, kind string, required boolean")
    return toolcalls.linked(calls, results, schemas)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs, _crc(3) != 1)
    return out.select("doc_id", (_crc(3) == 1).alias("held_out"), "lang_pred", "score")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return quality.judged(table(spark, sf_dir, "documents"), labels.filter("quality = 1 AND toxic = 0"))


#: Wanted token weights of the domains that the labels table spans.
TARGETS = {"quality0_toxic0": 0.10, "quality0_toxic1": 0.01, "quality1_toxic0": 0.85, "quality1_toxic1": 0.04}


CLEAN = "quality1_toxic0"


def label_domain() -> F.Column:
    return F.concat(F.lit("quality"), F.col("quality").cast("string"), F.lit("_toxic"), F.col("toxic").cast("string"))


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, fit = mixing.mixture(docs, table(spark, sf_dir, "labels"), label_domain(), TARGETS)
    # a row for each of at most langid.MAX_LABELS domains
    fit = fit.select("domain", F.col("target").alias("domain_target"), F.col("reached").alias("domain_reached"))
    return out.drop("text").join(F.broadcast(fit), "domain", "left")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score_texts(table(spark, sf_dir, "documents"), _crc(7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    digests = table(spark, sf_dir, "documents").select("doc_id", "source", size.alias("size"), crc.alias("text_crc32"))
    out = sharding.interleaved(digests)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_line_dedup": op2_line_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_tool_call_linking": op4_tool_call_linking,
    "op5_language_id": op5_language_id,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_soft_mixing": op8_soft_mixing,
    "op9_license_scan": op9_license_scan,
    "op10_backoff_lm": op10_backoff_lm,
    "op11_source_divergence": op11_source_divergence,
    "op12_sharding": op12_sharding,
    "op13_lexical_search": op13_lexical_search,
}
