"""Quality rules: exact base counts and a hashed n-gram log-likelihood ratio, natively.

Words and word pairs are hashed into BUCKETS buckets. The log ratio of the trusted-target multinomial
to the raw-corpus multinomial, both with one added to each bucket, is summed over a text's n-grams and
divided by their number. Every document at or over THRESHOLD is kept.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 13
THRESHOLD = -0.08
MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
BROADCAST_ROWS = 500_000
#: Low bits of a window's key that its place takes, at least.
PLACE_BITS = 8
_SYMBOL = "[#*$%&|<>]"
_WORD_CHAR = "[^\\x20\\x09-\\x0D]"
_SPLIT = "[\\x20\\x09-\\x0D]+"


def words_of(text: F.Column) -> F.Column:
    return F.array_remove(F.split(text, _SPLIT), "")


def _pairs() -> F.Column:
    """Hashes of the pairs of neighbouring words."""
    rest = "greatest(size(lowered) - 1, 0)"
    return F.expr(f"zip_with(slice(lowered, 1, {rest}), slice(lowered, 2, {rest}), (v, w) -> xxhash64(v, w))")


def _window_keys() -> F.Column:
    """Keys of a text's windows, in order; none where no two windows are equal, as no two of them have equal
    first and last pairs of lower-cased words. Only the other texts are split into words as written."""
    n = f"greatest(size(pairs) - {WINDOW - 2}, 0)"
    ends = f"zip_with(slice(pairs, 1, {n}), slice(pairs, {WINDOW - 1}, {n}), (a, b) -> xxhash64(a, b))"
    keys = f"transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(WINDOW))}))"
    return F.expr(
        f"""CASE WHEN transform(array({ends}), e -> size(array_distinct(e)) < size(e))[0]
        THEN transform(array(array_remove(split(text, r'{_SPLIT}'), '')), w -> {keys})[0] ELSE array() END"""
    )


def _repeated() -> F.Column:
    """Words in windows found twice or more. Texts without such windows stop early.

    Keys are sorted as numbers whose low bits (``low``) give way to the window's place. Only places beside one of
    equal high bits are then sorted by whole keys; those equal to a neighbour are kept, and what each next
    place covers is added up.
    """
    pairs = """transform(
        array(sort_array(transform(windows, (k, i) -> (k & ~low) | i))),
        s -> filter(zip_with(s, slice(s, 2, size(s)), (x, y) -> CASE WHEN ((x ^ y) & ~low) = 0 THEN
          array(x & low, y & low) END), p -> p IS NOT NULL))[0]"""
    return F.expr(
        f"""CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE
        aggregate(
          sort_array(filter(
            transform(
              array(sort_array(transform(array_distinct(flatten({pairs})), i -> struct(windows[i] AS k, CAST(i AS INT) AS i)))),
              s -> transform(s, (x, i) -> CASE WHEN (i > 0 AND s[greatest(i - 1, 0)].k = x.k)
                OR (i + 1 < size(s) AND s[least(i + 1, size(s) - 1)].k = x.k) THEN x.i END))[0],
            p -> p IS NOT NULL)),
          named_struct('last', {-WINDOW}, 'n', 0L),
          (a, p) -> named_struct('last', p, 'n', a.n + least({WINDOW}, p - a.last)),
          a -> a.n) END"""
    )


def gram_counts(documents: DataFrame, trusted: DataFrame) -> DataFrame:
    """bucket, raw, target: n-grams of all and of the trusted documents, for each bucket that has some.

    ``trusted`` is a column doc_id. Its distinct ids are broadcast only if a count finds at most
    BROADCAST_ROWS of them; beyond that the join shuffles.
    """
    ids = trusted.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    docs = documents.select("doc_id", words_of(F.lower("text")).alias("lowered"))
    docs = docs.join(ids.withColumn("target", F.lit(1)), "doc_id", "left")
    # a word and the next one side by side, then a row for each n-gram: all of it compiles, unlike array functions
    words = docs.select("target", F.expr("inline(arrays_zip(lowered, slice(lowered, 2, size(lowered)))) AS (v, w)"))
    hashes = F.array(F.xxhash64("v"), F.when(F.col("w").isNotNull(), F.xxhash64("v", "w")))
    grams = words.select("target", F.explode(hashes).alias("hash")).filter("hash IS NOT NULL")
    grams = grams.select("target", F.col("hash").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("target").alias("target"))


def log_ratios(documents: DataFrame, trusted: DataFrame) -> list[float]:
    """For each bucket the log ratio of target to raw probability; BUCKETS numbers, whatever the input."""
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in gram_counts(documents, trusted).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return [0.0] * BUCKETS
    shift = math.log((sum(raw) + BUCKETS) / (sum(target) + BUCKETS))
    return [math.log((t + 1) / (r + 1)) + shift for t, r in zip(target, raw, strict=True)]


def judged(documents: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    A null text has no words and fails the base rules; so does an empty one. llr is null for a text
    without words. Without trusted n-grams every ratio is 0, so
    the base rules alone decide. Repeated rows are
    judged alike; a null doc_id is trusted by nobody; other columns are left out.
    """
    ratios = log_ratios(documents, trusted)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"))
    rows = rows.select(
        "doc_id",
        "text",
        (F.length("text") - F.length(F.lower("text"))).alias("longer"),
        words_of(F.lower("text")).alias("lowered"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD_CHAR)).alias("lines"),
        F.from_json(F.lit(json.dumps(ratios)), "array<double>").alias("ratios"),
    )
    rows = rows.select("*", _pairs().alias("pairs"))
    rows = rows.select("*", _window_keys().alias("windows"))
    low = F.expr(f"shiftleft(1L, greatest(length(bin(size(windows))), {PLACE_BITS})) - 1")
    rows = rows.select("*", low.alias("low"))
    n_words = F.size("lowered").cast("long")
    # buckets are a power of two, so their numbers are the low bits of hashes
    ones = f"aggregate(lowered, 0D, (a, w) -> a + ratios[xxhash64(w) & {BUCKETS - 1}])"
    llr = F.expr(f"aggregate(pairs, {ones}, (a, p) -> a + ratios[p & {BUCKETS - 1}]) / nullif(size(lowered) + size(pairs), 0)")
    rows = rows.select(
        "doc_id",
        n_words.alias("n_words"),
        (F.length(F.array_join("lowered", "")) + F.col("longer")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(_SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated().cast("long").alias("n_repeat_words"),
        llr.alias("llr"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)))
