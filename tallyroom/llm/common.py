"""Shared helpers: table access, scratch tables, vectorised tokens, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separator class of the contracts' words: space and 0x09 to 0x0D.
SPACE = frozenset(b" \t\n\x0b\x0c\r")

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: dict[str, str] = {}
_PATHS: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where that is unset a local folder is made, for a local master only (tests): on a cluster other
    machines could not read it, so there it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.

    Shuffle files of the write are freed when it has ended: the table replaces them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        path = _PATHS.pop(id(df), None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Total UTF-8 bytes of a text column, to size blocks by."""
    return int(df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0)


# --- vectorised tokens -------------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 19
_PIECE = 1 << 22
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, _CHUNK)
        for key, base in (("p", _P), ("i", _P_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"], _powers["i"]


def byte_table(separators: frozenset[int] = SPACE, lower: bool = True) -> np.ndarray:
    """Byte map: separators to 0, A-Z to lower case if asked, NUL to the unused byte 255."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[0] = 255
    t[list(separators)] = 0
    return t


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows; a null row is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, rows: int, size: int = _PIECE, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and ``size`` bytes of text; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        room = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        stop = max(at + 1, min(at + rows, room))
        yield batch.slice(at, stop - at)
        at = stop


def _cuts(raw: np.ndarray, rows: np.ndarray, table: np.ndarray) -> list[int]:
    """Positions that split no word, about _CHUNK bytes apart."""
    cuts, end = [0], len(raw)
    while end - cuts[-1] > _CHUNK:
        pos, target = cuts[-1], cuts[-1] + _CHUNK
        row = int(rows[np.searchsorted(rows, target, "right") - 1])
        if row > pos:
            cuts.append(row)
            continue
        back = np.flatnonzero(table[raw[pos:target]] == 0)
        if len(back):
            cuts.append(pos + int(back[-1]) + 1)
            continue
        ahead = np.flatnonzero(table[raw[target:]] == 0)
        stop = target + int(ahead[0]) + 1 if len(ahead) else end
        row = int(rows[min(np.searchsorted(rows, target, "right"), len(rows) - 1)])
        cuts.append(min(stop, row) if row > target else stop)
    return [*cuts, end] if cuts[-1] < end else cuts


def word_hashes(texts: pa.Array | pa.ChunkedArray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, and the offsets of rows among the words.

    A word is a longest run of bytes that ``table`` does not map to 0. A polynomial hash by prefix
    sums needs no step per word; texts are worked on in pieces of about 0.5 MB.
    """
    raw, rows = utf8(texts)
    hashes, starts_at = [], []
    cuts = _cuts(raw, rows, table)
    for a, b in zip(cuts, cuts[1:], strict=False):
        d = table[raw[a:b]]
        p, inv = _power_tables(len(d))
        word = d != 0
        begin, stop = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        at = rows[np.searchsorted(rows, a) : np.searchsorted(rows, b)] - a
        begin[at] = word[at]
        at = at[at > 0] - 1
        stop[at] = word[at]
        begin, stop = np.flatnonzero(begin), np.flatnonzero(stop)
        terms = d.astype(np.uint64) * p[: len(d)]
        sums = np.cumsum(terms, dtype=np.uint64)
        hashes.append(mix64((sums[stop] - sums[begin] + terms[begin]) * inv[begin]))
        starts_at.append(begin + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    starts = np.concatenate(starts_at)
    return np.concatenate(hashes), np.searchsorted(starts, rows).astype(np.int64)


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words, as if all rows were one text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    acc = hashes[:m].copy()
    for j in range(1, n):
        acc = mix64(acc * _P + hashes[j : m + j])
    return acc


def order_of(values: np.ndarray) -> np.ndarray:
    """Places of unsigned 64-bit values in ascending order: values and places are sorted as one number where both fit."""
    if not len(values):
        return np.zeros(0, np.int64)
    bits = len(values).bit_length()
    over = max(int(values.max()).bit_length() + bits - 64, 0)
    mixed = ((values >> np.uint64(over)) << np.uint64(bits)) | np.arange(len(values), dtype=np.uint64)
    mixed.sort()
    order = (mixed & np.uint64((1 << bits) - 1)).astype(np.int64)
    if over:  # values that differ in their lowest bits alone may be out of order
        held = values[order]
        if np.any(held[1:] < held[:-1]):
            return np.argsort(values)
    return order


# --- connected components ----------------------------------------------------------------------


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(id, component) of every id on an edge (u, v); component is the least id reachable.

    Each round points every id to the neighbour that comes first in a random order of the ids (or to
    itself) and replaces edges by edges between the ends' pointers, so chains fold up from all places at
    once and few rounds empty the edges. Pointers are then followed and the least id of each root is
    taken. A hub's edges meet in aggregates with partial sums and in joins, which adaptive execution
    splits. Empty edges give no rows; edges with a null end and loops are ignored.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    pairs = stored(pairs.distinct(), tag)
    first = lambda x: F.struct(F.xxhash64(x).alias("order"), F.col(x).alias("id"))
    rounds: list[DataFrame] = []
    while not rounds or not pairs.isEmpty():
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pointers = both.groupBy("u").agg(F.min(first("v")).alias("near"))
        pointers = stored(pointers.select(F.col("u").alias("id"), F.least(first("u"), "near")["id"].alias("root")), f"{tag}-to")
        rounds.append(pointers)
        left = pairs.join(pointers.select(F.col("id").alias("u"), F.col("root").alias("a")), "u")
        left = left.join(pointers.select(F.col("id").alias("v"), F.col("root").alias("b")), "v").filter("a <> b")
        folded = stored(left.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
        discard(pairs)
        pairs = folded
    found = rounds[0]
    for pointers in rounds[1:]:
        found = found.join(pointers.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left")
        found = found.select("id", F.coalesce("next", "root").alias("root"))
    found = stored(found, f"{tag}-roots")
    least = found.groupBy("root").agg(F.min("id").alias("component"))
    out = stored(found.join(least, "root").select("id", "component"), f"{tag}-ids")
    discard(pairs, found, *rounds)
    return out
