"""Proportional stratified interleaving of rows into shards, with DataFrame functions only.

Rows are shuffled by a seeded hash and ranked within their source. The rank r of n becomes the fraction
(r - 1/2) / n; in the order of fractions the sources are interleaved in proportion, so any stretch of the
order has each source's share. The order is cut into stretches of equal numbers of rows.

Both rankings are made in slices: a row's rank is its place in a small slice of its source (or of the
fractions) plus the number of rows in the slices before, so a source of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm import common

SHARDS = 24
SEED = "interleave-1"
#: Rows of one slice, about, from the 1,024 slices on that any input has.
SLICE_ROWS = 10_000
LEAST_SLICES = 1024
#: Slices are numbered with so many bits at most: 2^26 slices of 10,000 rows.
MOST_BITS = 26
#: Of a number of slices the first 10 bits name a range, whose totals are added up first.
_RANGE_BITS = 10


def _before(counts: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """``counts`` (keys, slice, n) with ``before``: the rows of the slices before, of the same keys.

    Slices are added up in 1,024 ranges, then ranges among each other, so no window has more than the slices
    of one range or the ranges of one key.
    """
    ranges = F.shiftright("slice", bits - _RANGE_BITS)
    counts = counts.withColumn("range", ranges)
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*keys, "range").agg(F.sum("n").alias("in_range"))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    totals = totals.withColumn("ranges_before", F.coalesce(F.sum("in_range").over(until(by_key.orderBy("range"))), F.lit(0)))
    within = F.coalesce(F.sum("n").over(until(Window.partitionBy(*keys, "range").orderBy("slice"))), F.lit(0))
    same = F.col("r.range") == F.col("c.range")
    for k in keys:
        same &= F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
    joined = counts.withColumn("within", within).alias("c").join(totals.alias("r"), same)
    return joined.select(*(F.col(f"c.{k}") for k in keys), F.col("c.slice"), (F.col("c.within") + F.col("r.ranges_before")).alias("before"))


def interleaved(rows: DataFrame, shards: int = SHARDS, stratum: str = "source", seed: str = SEED) -> DataFrame:
    """``rows`` with shard (int, 0 to ``shards`` - 1) and slot (long, gapless from 0 in each shard).

    Shards' row counts are at most one apart, and each holds each stratum's rows in proportion, to about two
    rows. The order is fixed by ``seed``, doc_id, and for rows of one doc_id by the other columns that can be
    ordered; rows alike in all of them are interchangeable. A null stratum is a stratum of its own; a null
    doc_id is shuffled by the row's other columns. Equal texts are not kept together. Columns named shard or
    slot are replaced, others pass through whatever their names; very long texts travel twice, so give digests
    or ids where texts are not needed. An empty table gives no rows.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    orderable = [f.name for f in rows.schema.fields if f.name in kept and f.name != "doc_id" and f.dataType.typeName() not in ("map", "variant")]
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.xxhash64(*orderable).cast("string")))
    given = rows.select(F.struct(*kept).alias("row"), F.col(stratum).cast("string").alias("stratum"), F.md5(F.concat(F.lit(seed + ":"), named)).alias("mixed"))

    total = rows.count()
    bits = min(MOST_BITS, max(LEAST_SLICES, -(-total // SLICE_ROWS)).bit_length())
    # 28 bits of the hash are enough for 2^26 slices
    place = F.conv(F.substring("mixed", 1, 7), 16, 10).cast("long")
    given = given.withColumn("slice", F.shiftright(place, 28 - bits))
    last = [F.col("row").getField(c) for c in ("doc_id", *orderable)]
    local = Window.partitionBy("stratum", "slice")

    counts = common.stored(given.groupBy("stratum", "slice").agg(F.count("*").alias("n")), "sh-slices")
    offsets = _before(counts, ["stratum"], bits).join(
        counts.groupBy(F.col("stratum").alias("s")).agg(F.sum("n").alias("size")), F.col("stratum").eqNullSafe(F.col("s"))
    )
    offsets = offsets.select(F.col("stratum").alias("of"), F.col("slice").alias("in"), "before", "size")
    ranked = given.withColumn("r", F.row_number().over(local.orderBy("mixed", *last)))
    ranked = ranked.join(offsets, F.col("stratum").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("in")))
    # two times the rank less one, over two times the size: both whole, so the quotient is rounded once
    fraction = (2 * (F.col("r") + F.col("before")) - 1) / (2 * F.col("size")).cast("double")
    ranked = ranked.select("row", "stratum", "r", "before", fraction.alias("fraction"))
    ranked = common.stored(ranked.withColumn("slice", F.floor(F.col("fraction") * (1 << bits))), "sh-ranked")
    common.discard(counts)

    counts = ranked.groupBy("slice").agg(F.count("*").alias("n"))
    offsets = common.stored(_before(counts, [], bits).select(F.col("slice").alias("in"), F.col("before").alias("start")), "sh-starts")
    tie = F.md5(F.concat(F.lit(seed + ":"), F.coalesce("stratum", F.lit(""))))
    order = Window.partitionBy("slice").orderBy("fraction", tie, F.col("stratum").asc_nulls_first(), F.col("before") + F.col("r"))
    placed = ranked.withColumn("p", F.row_number().over(order)).join(offsets, F.col("slice") == F.col("in"))
    at = F.col("p") + F.col("start") - 1
    placed = placed.select("row", at.alias("at")).withColumn("shard", F.expr(f"at * {shards} div {max(total, 1)}").cast("int"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.select(*(F.col("row").getField(c).alias(c) for c in kept), "shard", (F.col("at") - first).alias("slot"))


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, stratum: str = "source", seed: str = SEED) -> None:
    """Write ``documents`` as Parquet below ``path``, a folder ``shard=i`` for each shard, rows in slot order.

    The assignment is made on ids and a number of the text and joined to the documents; repeated rows of one
    doc_id are numbered so that each is written once.
    """
    alike = Window.partitionBy("doc_id", "_crc").orderBy(stratum)
    given = documents.withColumn("_crc", F.crc32(F.coalesce(F.col("text"), F.lit("")))).withColumn("_copy", F.row_number().over(alike))
    given = common.stored(given, "sh-given")
    dealt = common.stored(interleaved(given.select("doc_id", stratum, "_crc", "_copy"), shards, stratum, seed), "sh-dealt")
    d = dealt.select(F.col("doc_id").alias("_id"), F.col("_crc").alias("_c"), F.col("_copy").alias("_k"), "shard", "slot")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_crc") == F.col("_c")) & (F.col("_copy") == F.col("_k"))
    out = given.drop("shard", "slot").join(d, same).select(*(c for c in documents.columns if c not in ("shard", "slot")), "shard", "slot")
    files = max(shards, common.partitions(documents))
    out.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    common.discard(given, dealt)
