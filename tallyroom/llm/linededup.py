"""Cross-site boilerplate lines, found by distinct-site spread.

A HyperLogLog sketch of the sites of each line hash is built and merged by aggregation. A line whose
estimate is clearly at or over the threshold is spread, one clearly under it is not, and those in
between get an exact distinct count. The document of least id keeps a spread line; the others lose it,
so a group of copies keeps one whole text.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm import common

MIN_SITES = 8
LG_K = 12
BLANKS = " \t\n\x0b\x0c\r"
_ERROR = 1.04 / math.sqrt(1 << LG_K)


def _bare(line: F.Column) -> F.Column:
    return F.btrim(line, F.lit(BLANKS))


def _lines(documents: DataFrame, site: str) -> DataFrame:
    lines = documents.select("doc_id", F.col(site).alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", "site", _bare(F.col("line")).alias("line")).filter("line <> ''")
    return lines.select("doc_id", "site", F.xxhash64("line").alias("line_key"))


def spread_lines(documents: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(line_key, first_doc) of lines with a word that occur on ``min_sites`` sites or more."""
    lines = _lines(documents, site)
    margin = max(1.0, 4 * _ERROR * min_sites)
    sketches = lines.groupBy("line_key").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")
    )
    spread = sketches.filter(F.col("n") >= min_sites).select("line_key", "first_doc", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = common.stored(spread.filter(F.col("sites") > min_sites - 1 - margin), "ld-sketches")
    sure = spread.filter(F.col("sites") >= min_sites + margin).select("line_key", "first_doc")
    near = spread.filter(F.col("sites") < min_sites + margin).select("line_key", "first_doc")
    counted = lines.join(near, "line_key").groupBy("line_key", "first_doc").agg(F.countDistinct("site").alias("sites"))
    return sure.unionAll(counted.filter(F.col("sites") >= min_sites).select("line_key", "first_doc"))


def without_spread_lines(documents: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``documents`` less spread lines, with n_lines and n_removed (long); every row is returned.

    Lines end at \\n and are compared without outer blanks (space and 0x09 to 0x0D); a line of blanks only is
    never spread, one of a single word may be. Rows of a null doc_id are counted for the spread but lose
    nothing; a null site is no site; a null text stays null with 0 lines; an empty text has one line. Repeated
    rows are treated alike, and where several rows have the least doc_id each keeps the line. A very long text
    is split in its row. An empty table gives no rows. Columns named n_lines or n_removed are replaced, others
    pass through whatever their names.
    """
    kept = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    plain = documents.select("doc_id", site, "text")
    spread = common.stored(spread_lines(plain, site, min_sites), "ld-spread")
    lost = _lines(plain, site).join(spread, "line_key").filter("doc_id > first_doc")
    lost = common.stored(lost.groupBy("doc_id").agg(F.collect_set("line_key").alias("lost")), "ld-lost")
    # the caller's columns travel as one, so that names can't clash; the lists grow with the documents, so
    # this join shuffles at every size
    rows = documents.select("doc_id", F.struct(*kept).alias("row")).join(lost.hint("merge"), "doc_id", "left")
    lines = F.split("row.text", "\n")
    stays = F.filter(lines, lambda x: ~F.array_contains(F.col("lost"), F.xxhash64(_bare(x))))
    rows = rows.withColumn("stays", F.when(F.col("lost").isNotNull(), stays))
    n_lines = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    text = F.when(F.col("lost").isNotNull(), F.array_join("stays", "\n")).otherwise(F.col("row.text"))
    return rows.select(
        *((text if c == "text" else F.col("row").getField(c)).alias(c) for c in kept),
        n_lines.alias("n_lines"),
        F.when(F.col("lost").isNotNull(), n_lines - F.size("stays")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
    )
