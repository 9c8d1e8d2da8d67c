"""Near-duplicate groups by one-permutation hashing with optimal densification.

A document's shingle set is hashed once; the top bits of a hash choose one of ``BINS`` bins and a
bin keeps its least hash. An empty bin borrows from the first filled bin of its own fixed random
order of bins, so equal sets borrow alike (densification). Runs of ``ROWS`` bins form band keys, and
documents of one key form a bucket.

Candidates are stars: a bucket's members are paired with its centre only, so a bucket adds no more pairs
than it has members. Pairs are confirmed on full sets and linked documents become one component. A bucket
that still holds several components is finished exactly: the members outside its largest component meet each
other and that component, block by block in numpy, by their parity sketches, and of the pairs between components
only those leave a task whose sizes and sketches allow a link (both are bounds, not estimates); they are confirmed
like the others. So every link of a bucket counts, and members of the largest component never meet each other: a
few strays in a bucket of a million cost a few million comparisons.

With 32 bands of 4 bins two sets that are 3/4 alike miss each other with a chance of 6 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm import common

BINS = 128
BIN_BITS = 7
ROWS = 4
BLOCK = 512
SKETCH_BITS = 11
#: Unequal sets of fewer shingles than this are never 3/4 alike.
LEAST = 3
SHINGLE = 5
_TABLE = common.byte_table()
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _orders() -> np.ndarray:
    """For each bin the fixed order in which it looks at the bins."""
    rng = np.random.default_rng(20240607)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words, the whole sequence as one."""
    words, at = common.word_hashes(texts, _TABLE)
    runs = common.chain(words, size)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            whole = common.chain(words[a:b], b - a)
            sets.append(common.mix64(whole + np.uint64(b - a)))
        else:
            sets.append(words[:0])
    return sets


def least_hashes(sets: list[np.ndarray], bits: int = BIN_BITS) -> np.ndarray:
    """The least hash of each of 2^bits bins, one row for each sorted set; an empty bin holds _NONE."""
    out = np.full((len(sets), 1 << bits), _NONE, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if len(row):
        values = np.concatenate(sets)
        place = (row << bits) + (values >> np.uint64(64 - bits)).astype(np.int64)
        new = np.append(True, place[1:] != place[:-1])  # sets are sorted, so a bin's first hash is its least
        out.ravel()[place[new]] = values[new]
    return out


def densified(sets: list[np.ndarray], orders: np.ndarray) -> np.ndarray:
    """Signatures (one row of BINS hashes for each set); a row of an empty set stays empty."""
    out = least_hashes(sets)
    filled = out != _NONE
    some = filled.any(axis=1)
    r, c = np.nonzero(~filled & some[:, None])
    for step in range(BINS):
        if not len(r):
            break
        source = orders[c, step]
        hit = filled[r, source]
        out[r[hit], c[hit]] = out[r[hit], source[hit]]
        r, c = r[~hit], c[~hit]
    return out


def parity_sketches(sets: list[np.ndarray], bits: int = SKETCH_BITS) -> np.ndarray:
    """For each set the parity of the number of hashes in each of 2^bits bins, packed into words.

    Hashes of both sets cancel in the exclusive or of two sketches, so its number of ones is a lower
    bound of the number of hashes that only one of the sets has.
    """
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets) if len(row) else np.zeros(0, np.uint64)
    place = (row << bits) + (values >> np.uint64(64 - bits)).astype(np.int64)
    odd = (np.bincount(place, minlength=len(sets) << bits) & 1).astype(np.uint8)
    return np.packbits(odd).reshape(len(sets), -1).view(np.uint64)


def band_keys(sets: list[np.ndarray], orders: np.ndarray) -> np.ndarray:
    """The bucket of each set in each band."""
    bands = BINS // ROWS
    signature = densified(sets, orders)
    keys = np.zeros((len(sets), bands), np.uint64)
    for band in range(bands):
        acc = np.full(len(sets), np.uint64(band + 1), np.uint64)
        for j in range(ROWS):
            acc = common.mix64(acc * common._P + signature[:, band * ROWS + j])
        keys[:, band] = acc
    return keys


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = _orders()
    bands = BINS // ROWS
    for batch in batches:
        for part in common.pieces(batch, 1000):
            sets = shingle_sets(part.column("text"))
            keys = band_keys(sets, orders)
            n = np.array([len(s) for s in sets], np.int64)
            k1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            k2 = np.array([common.mix64(s ^ common._P).sum(dtype=np.uint64) for s in sets], np.uint64)
            flat = pa.array(keys.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists],
                ["doc_id", "n_shingles", "k1", "k2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, parity sketch with the band keys behind it, and sorted hashes of each document's set."""
    orders = _orders()
    for batch in batches:
        for part in common.pieces(batch, 250):
            sets = shingle_sets(part.column("text"))
            sketch = [x.tobytes() for x in np.concatenate([parity_sketches(sets), band_keys(sets, orders)], axis=1)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketch, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["doc_id", "size", "sketch", "hashes"],
            )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs with 100 * intersection >= 75 * union of full sets."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("hashes_u"), batch.column("hashes_v"), strict=True):
            a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
            both = len(np.intersect1d(a, b, assume_unique=True)) if 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) else 0
            keep.append(len(a) > 0 and 100 * both >= 75 * (len(a) + len(b) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links among ``pairs`` (u, v). The pairs travel with the set of one end; a hub's pairs are split by adaptive execution."""
    wide = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("hashes").alias("hashes_u")), "u")
    wide = wide.join(sets.select(F.col("doc_id").alias("v"), F.col("hashes").alias("hashes_v")), "v")
    return common.stored(wide.select("u", "v", "hashes_u", "hashes_v").mapInArrow(_confirm, "u long, v long"), "nd-links")


def _stars(members: DataFrame) -> DataFrame:
    """(u, v) pairs of a bucket's members (doc_id, key, n_shingles) with its centre, of sizes that can link.

    The centre is the member that is least under one random order of all documents, so buckets of much
    the same members have the same centre and form the same pairs.
    """
    order = F.xxhash64("doc_id", F.lit(0))
    buckets = members.groupBy("key").agg(F.min_by(F.struct("doc_id", "n_shingles"), F.struct(order, "doc_id")).alias("centre"))
    star = members.join(buckets, "key").select("doc_id", "n_shingles", F.col("centre.doc_id").alias("centre"), F.col("centre.n_shingles").alias("n"))
    star = star.filter("doc_id <> centre AND 4 * least(n, n_shingles) >= 3 * greatest(n, n_shingles)")
    return star.select(F.greatest("doc_id", "centre").alias("u"), F.least("doc_id", "centre").alias("v")).distinct()


def _block_pairs(ids: np.ndarray, n: np.ndarray, component: np.ndarray, sketch: np.ndarray, own: np.ndarray, both: bool, key: int | None = None) -> Iterator[np.ndarray]:
    """Pairs of places of one meeting of blocks that may link: of different components and within both bounds.

    Band keys lie behind the sketches; a pair is given in the bucket ``key`` of the first band that it shares only.
    ``own`` says which rows are of the first block; with ``both`` only rows of different blocks are paired.
    3/4 alike sets have 1/7 of the sum of their sizes of hashes that only one of them has, at most.
    """
    parity, bands = np.split(sketch, [1 << (SKETCH_BITS - 6)], axis=1)
    rows = np.flatnonzero(own) if both else np.arange(len(ids))
    cols = np.flatnonzero(~own) if both else rows
    for r in rows.tolist():
        c = cols if both else cols[cols > r]
        c = c[(component[c] != component[r]) & (4 * np.minimum(n[c], n[r]) >= 3 * np.maximum(n[c], n[r]))]
        if len(c):
            c = c[7 * np.bitwise_count(parity[c] ^ parity[r]).sum(axis=1, dtype=np.int64) <= n[c] + n[r]]
        if len(c) and key is not None:
            c = c[bands[r][(bands[c] == bands[r]).argmax(axis=1)] == key]
        if len(c):
            yield np.stack([np.maximum(ids[c], ids[r]), np.minimum(ids[c], ids[r])], axis=1)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) pairs that may link among rows sorted by meeting (key, i, j)."""

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        get = lambda name: table.column(name).to_numpy()
        key, i, j, block, ids, n, component = (get(x) for x in ("key", "i", "j", "block", "doc_id", "size", "component"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(key), -1)
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            found = list(_block_pairs(ids[a:b], n[a:b], component[a:b], sketch[a:b], block[a:b] == i[a], bool(i[a] != j[a]), key[a].view(np.uint64)))
            if found:
                uv = np.concatenate(found)
                for at in range(0, len(uv), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(uv[at : at + 100_000, 0]), pa.array(uv[at : at + 100_000, 1])], ["u", "v"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, i, j = (batch.column(x).to_numpy() for x in ("key", "i", "j"))
        ends = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
        cut = int(ends[-1]) + 1 if len(ends) else 0  # the last meeting may go on in the next batch
        if held and (cut or (key[0], i[0], j[0]) != last):
            done = [*held, batch.slice(0, cut)] if cut else held
            yield from pairs(pa.Table.from_batches(done))
            held = []
        elif cut:
            yield from pairs(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
        last = (key[-1], i[-1], j[-1])
    if held:
        yield from pairs(pa.Table.from_batches(held))


def _blocks(members: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of every meeting (key, i, j) of two blocks of a bucket.

    ``members``: doc_id, key, component; ``sets``: doc_id, size, sketch. A bucket's largest component and its other
    members are dealt to blocks of about ``block`` (of the component they have numbers under 0). Blocks of others
    meet each other and those of the component, so a bucket of any size is spread over tasks.
    """
    parts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    buckets = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("large"), F.max_by("component", F.struct("n", "component")).alias("largest"))
    # of two members one is the other's centre
    buckets = buckets.filter("large < n AND n > 2")
    blocks = lambda n: F.ceil(n / block).cast("int")
    buckets = buckets.select("key", "largest", blocks(F.col("n") - F.col("large")).alias("blocks"), blocks(F.col("large")).alias("chunks"))
    rows = members.select("doc_id", "key", "component").join(buckets, "key").join(sets.select("doc_id", "size", "sketch"), "doc_id")
    dealt = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(-1)), n).cast("int")
    inside = F.col("component") == F.col("largest")
    rows = rows.withColumn("block", F.when(inside, -1 - dealt(F.col("chunks"))).otherwise(dealt(F.col("blocks"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(inside, 0).otherwise(-F.col("chunks")), F.col("blocks") - 1)))
    return rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "size", "component", "sketch")


def _remaining(members: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v) pairs of different components that share a bucket and may link by their sizes and sketches."""
    rows = _blocks(members, sets, block)
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(_meetings, "u long, v long")


def _named(ids: DataFrame, column: str, groups: DataFrame, to: str = "component") -> DataFrame:
    """``ids`` with the component of ``column``: the id itself where it is on no link."""
    found = ids.join(groups.select(F.col("id").alias(column), F.col("component").alias("_found")), column, "left")
    return found.withColumn(to, F.coalesce("_found", column)).drop("_found")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable), kept.

    Null or wordless texts have an empty set and link with nothing. A null doc_id takes part in no
    link: its component is null and it is kept. Repeated rows of one doc_id are one document and
    each row is returned; if their texts differ the least text stands for the id in confirmations.
    Of equally good roots the least id names a component. A very long text is one set, held in one task.
    Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = common.stored(
        docs.mapInArrow(_signatures, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "nd-signatures"
    )
    linkable = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # documents with equal sets are one class, so copies never form pairs
    classes = common.stored(linkable.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "nd-classes")
    reps = linkable.filter(F.col("n_shingles") >= LEAST).join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    banded = reps.select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = common.stored(banded.join(shared, "key").distinct(), "nd-members")

    # sets of bucket members, made once; ids grow with the documents, so this join shuffles at every size
    ids = members.select("doc_id").distinct().hint("merge")
    texts = docs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = common.stored(texts.mapInArrow(_sets, "doc_id long, size long, sketch binary, hashes binary"), "nd-sets")

    stars = common.stored(_stars(members), "nd-stars")
    links = _confirmed(stars, sets)
    groups = common.components(links, "nd-cc")

    # then every link that is left between components
    rest = _remaining(_named(members, "doc_id", groups), sets).join(stars, ["u", "v"], "left_anti")
    rest = common.stored(rest, "nd-rest")
    fresh = _confirmed(rest, sets)
    if not fresh.isEmpty():  # components are joined by the fresh links alone
        joined = _named(_named(fresh, "u", groups, "cu"), "v", groups, "cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        wider = common.components(joined, "nd-cc2")
        alone = wider.join(groups.select(F.col("component").alias("id")).distinct(), "id", "left_anti")
        wide = groups.unionAll(alone.select("id", F.col("id").alias("component")))
        groups = _named(wide.select("id", F.col("component").alias("of")), "of", wider).select("id", "component")
        groups = common.stored(groups, "nd-groups")
    common.discard(members, sets, stars, links, rest, fresh)

    named = _named(classes, "rep", groups)
    out = signed.select("doc_id", "k1", "k2", "n_shingles").join(named.drop("rep"), ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents less all but one of each near-duplicate group and all but one row of a repeated doc_id."""
    groups = common.stored(near_duplicates(documents), "nd-result")
    gone = groups.filter("NOT kept").select("doc_id").distinct()
    again = groups.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = common.stored(again, "nd-again")
    if again.isEmpty():
        return documents.join(gone.hint("merge"), "doc_id", "left_anti").select(*documents.columns)
    # the row of the least text, which stood for the id in confirmations
    once = documents.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*documents.columns), F.struct(F.col("text").isNull(), "text")).alias("row"))
    once = once.select("row.*")
    return documents.join(gone.unionAll(again).hint("merge"), "doc_id", "left_anti").unionByName(once).select(*documents.columns)
