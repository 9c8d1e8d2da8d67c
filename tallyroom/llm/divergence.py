"""Divergence of sources from each other and from their language, over a transducer vocabulary.

A first pass over the texts counts the documents of each term. The terms kept go, in ascending byte order of
language and term, into minimal acyclic transducers: each range of the sorted terms is built by one task, and
a term's ordinal is its range and its place in it. A second pass streams all texts through the transducers and
counts ordinals by source. Counts then meet in blocks of ordinals, where all sources of a language are
compared; ordinals break ties, since their order is the order of the terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm import common, transducer

MIN_DOCUMENTS = 30
TOP = 50
#: Terms of one transducer, about.
RANGE_TERMS = 200_000
#: Transducers that go to the tasks in one pass over the texts have at most so many bytes together, or are one.
PASS_BYTES = 64 << 20
#: Cells (sources x terms) of one block of ordinals, about.
BLOCK_CELLS = 4096
#: Entries that a task gathers before it hands them on.
HELD = 1 << 18
SCALE, ADDED = 10**9, 5
_RANGE_BITS = 32
_TABLE = common.byte_table(frozenset(range(0x41)) | frozenset(range(0x5B, 0x61)) | frozenset(range(0x7B, 0x80)))
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, documents) of the batches, partly summed."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        lang, term = zip(*held, strict=True) if held else ((), ())
        arrays = [pa.array(lang, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(arrays, ["lang", "term", "documents"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            text = text.as_buffer()
            seen: set[bytes] = set()
            for at, stop in _pieces(text):
                seen.update(_TERM.findall(bytes(text[at:stop]).lower()))
            for term in seen:
                held[lang, term] += 1
            if len(held) > HELD:
                yield out()
    yield out()


def _pieces(text: pa.Buffer, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Stretches of about ``size`` bytes that split no term."""
    at = 0
    while at < len(text):
        stop = min(at + size, len(text))
        while stop < len(text) and _TABLE[text[stop]]:
            stop += 1
        yield at, stop
        at = stop


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One transducer for the sorted keys of a partition."""
    keys = (k.as_buffer().to_pybytes() for batch in batches for k in batch.column("key"))
    machine = transducer.built(keys)
    if machine.size:
        row = [[machine.key(0)], [machine.size], [machine.nbytes()], [machine.dumps()]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["first", "terms", "bytes", "machine"])


def vocabulary(kept: DataFrame, range_terms: int = RANGE_TERMS) -> DataFrame:
    """(range, terms, bytes, machine): transducers over the keys language, NUL, term, numbered in key order.

    Terms hold no NUL, so keys differ where language or term does, and keys of one language are in the order
    of its terms.
    """
    keys = kept.select(F.concat(F.encode("lang", "UTF-8"), F.lit(b"\x00"), F.encode("term", "UTF-8")).alias("key"))
    ranges = max(1, -(-kept.count() // range_terms))
    built = keys.repartitionByRange(ranges, "key").sortWithinPartitions("key").mapInArrow(_build, "first binary, terms long, bytes long, machine binary")
    built = common.stored(built, "sd-built")
    # a row for each range
    numbered = built.withColumn("range", F.row_number().over(Window.orderBy("first")) - 1) if ranges > 1 else built.withColumn("range", F.lit(0))
    numbered = common.stored(numbered.select("range", "terms", "bytes", "machine"), "sd-vocabulary")
    common.discard(built)
    return numbered


def passes(vocabulary_: DataFrame, most: int = PASS_BYTES) -> list[list[int]]:
    """Ranges of each pass, so that a pass has at most ``most`` bytes of transducers (or one transducer)."""
    out: list[list[int]] = []
    room = 0
    for r in vocabulary_.select("range", "bytes").orderBy("range").toLocalIterator():
        if not out or r["bytes"] > room:
            out.append([])
            room = most
        out[-1].append(r["range"])
        room -= r["bytes"]
    return out


def _loaded(vocabulary_: DataFrame, ranges: list[int]) -> list[tuple[int, bytes]]:
    rows = vocabulary_.filter(F.col("range").between(ranges[0], ranges[-1])).select("range", "machine").orderBy("range").collect()
    return [(r["range"], bytes(r["machine"])) for r in rows]


def counted(documents: DataFrame, machines: list[tuple[int, bytes]]) -> DataFrame:
    """(lang, source, ordinal, n): occurrences in ``documents`` (lang, source, text) of the transducers' terms."""
    sent = documents.sparkSession.sparkContext.broadcast(machines)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [(r, transducer.Transducer.loads(x)) for r, x in sent.value]
        roots: dict[str, list[tuple[int, int]]] = {}
        groups: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def folded() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            group, place, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((place, group))
            group, place, n = group[order], place[order], n[order]
            new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (place[1:] != place[:-1])))
            return group[new], place[new], np.add.reduceat(n, new)

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                group, place, n = folded()
                names = list(groups)
                for at in range(0, len(group), 100_000):
                    g, p, c = (x[at : at + 100_000] for x in (group, place, n))
                    lang, source = (pa.array([x[i] for x in names], pa.string()).take(pa.array(g)) for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([lang, source, pa.array(p), pa.array(c)], ["lang", "source", "ordinal", "n"])
            held.clear()
            groups.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            of = np.array([groups.setdefault(x, len(groups)) for x in zip(langs, batch.column("source").to_pylist(), strict=True)], np.int64)
            for lang in {*langs} - roots.keys():
                roots[lang] = [m.prefix(lang.encode() + b"\x00") for _, m in loaded]
            starts_of = np.array([roots[x] for x in langs], np.int64).reshape(len(langs), len(loaded), 2)
            for data, starts, row in transducer.words(batch.column("text"), _TABLE):
                for i, (number, machine) in enumerate(loaded):
                    place = machine.ordinals(data, starts, starts_of[row, i, 0], starts_of[row, i, 1])
                    hit = place >= 0
                    if hit.any():
                        code, n = np.unique((of[row[hit]] << 40) | place[hit], return_counts=True)
                        held.append((code >> 40, (code & ((1 << 40) - 1)) | (number << _RANGE_BITS), n))
                if sum(len(x[0]) for x in held) > HELD:
                    held[:] = [folded()]
                    if len(held[0][0]) > HELD // 2:
                        yield from out()
                        of = np.array([groups.setdefault(x, len(groups)) for x in zip(langs, batch.column("source").to_pylist(), strict=True)], np.int64)
        yield from out()

    found = documents.select("lang", "source", "text").mapInArrow(count, "lang string, source string, ordinal long, n long")
    return found.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def share(count: np.ndarray, total: int | np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)) by long division in steps of 1,000, so that
    nothing overflows up to 9 * 10^15 occurrences."""
    base = np.asarray(total, np.int64) + ADDED * terms
    if np.any(base > 9 * 10**15):
        raise OverflowError("more than 9 * 10^15 occurrences in one group")
    whole, left = np.divmod(np.asarray(count, np.int64) + ADDED, base)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, base)
        whole = whole * 1000 + digit
    return whole + 1


def _compared(top: int):
    """Of blocks of ordinals: the sums of differences of each two sources, and each source's best terms."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "part", "item", "ordinal", "value"]
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        sums: dict[tuple[str, int], np.ndarray] = {}
        known: dict[str, list[str]] = {}

        def pairs() -> Iterator[pa.RecordBatch]:
            for (lang, first), total in sums.items():
                all_ = known[lang]
                for i, row in enumerate(total, first):
                    others = [j for j in range(len(all_)) if j != i]
                    k = len(others)
                    cells = ([lang] * k, [all_[i]] * k, ["pair"] * k, [all_[j] for j in others], [None] * k, row[others].tolist())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, kinds, strict=True)], names)
            sums.clear()
            known.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in ("lang", "sources", "total", "terms", "tile", "tile_size")}
                cells = batch.column("cells")[k].values
                lang, all_ = r["lang"], [x["source"] for x in r["sources"]]
                totals = np.array([x["total"] for x in r["sources"]], np.int64)
                ordinal, n = (cells.field(c).to_numpy() for c in ("ordinal", "n"))
                source = pc.index_in(cells.field("source"), value_set=pa.array(all_, pa.string())).to_numpy()
                terms, column = np.unique(ordinal, return_inverse=True)
                count = np.zeros((len(all_), len(terms)), np.int64)
                count[source, column] = n
                p = share(count, totals[:, None], r["terms"])
                if r["tile"] == 0:  # the terms once, the pairs by tiles of sources
                    gain = np.where(count > 0, p - share(count.sum(axis=0), r["total"], r["terms"]), 0)
                    for i in np.flatnonzero((gain > 0).any(axis=1)).tolist():
                        best = np.flatnonzero(gain[i] > 0)
                        best = best[np.lexsort((terms[best], -gain[i, best]))[:top]]
                        size = len(best)
                        out = ([lang] * size, [all_[i]] * size, ["term"] * size, [None] * size, terms[best].tolist(), gain[i, best].tolist())
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)
                first = r["tile"] * r["tile_size"]
                tile = p[first : first + r["tile_size"]]
                if (lang, first) not in sums and sum(x.size for x in sums.values()) + len(tile) * len(all_) > HELD:
                    yield from pairs()
                known[lang] = all_
                total = sums.setdefault((lang, first), np.zeros((len(tile), len(all_)), np.int64))
                for i, row in enumerate(tile):
                    total[i] += np.abs(p - row).sum(axis=1)
        yield from pairs()

    return compare


def _named(machines: list[tuple[int, bytes]]):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = {r: transducer.Transducer.loads(x) for r, x in machines}
        for batch in batches:
            ordinals = batch.column("ordinal").to_pylist()
            keys = [loaded[x >> _RANGE_BITS].key(x & ((1 << _RANGE_BITS) - 1)) for x in ordinals]
            item = pa.array([k[k.rindex(b"\x00") + 1 :] for k in keys], pa.binary()).cast(pa.string())
            yield batch.set_column(batch.schema.get_field_index("item"), "item", item)

    return name


def source_divergence(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) of ``documents``.

    Terms are runs of letters A-Z (lower-cased) and characters from U+0080; a language keeps those in at least
    ``min_documents`` of its documents. Part ``pair`` ranks the other sources of the language by the sum of
    absolute differences of shares over all kept terms; part ``term`` ranks up to ``top`` terms whose share in
    the group is over that in the language. All numbers are exact; ties go by item in ascending UTF-8 order.

    Null text, lang and source are read as empty; doc_id and other columns are ignored, whatever their names.
    Repeated rows are separate documents. A very long text is streamed in pieces. A language without kept terms
    has pairs of value 0 and no terms; an empty table gives no rows.
    """
    docs = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = docs.select("lang", "text").mapInArrow(_terms, "lang string, term string, documents long")
    kept = kept.groupBy("lang", "term").agg(F.sum("documents").alias("documents")).filter(F.col("documents") >= min_documents)
    kept = common.stored(kept.select("lang", "term"), "sd-kept")
    machines = vocabulary(kept)
    rounds = passes(machines)
    counts = [common.stored(counted(docs, _loaded(machines, ranges)), "sd-counts") for ranges in rounds]
    empty = documents.sparkSession.createDataFrame([], "lang string, source string, ordinal long, n long")
    cells = empty
    for part in counts:
        cells = cells.unionAll(part)

    groups = docs.select("lang", "source").distinct().join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.select("lang", F.struct("source", F.coalesce("total", F.lit(0)).alias("total")).alias("one"))
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list("one")).alias("sources"), F.sum("one.total").alias("total"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    size = F.greatest(F.lit(1), F.floor(F.lit(HELD) / F.size("sources"))).cast("int")
    langs = common.stored(langs.withColumn("tile_size", size), "sd-langs")

    # blocks have about BLOCK_CELLS cells: fewer ordinals where a language has more sources
    wide = langs.select("lang", F.greatest(F.lit(1), F.floor(F.lit(BLOCK_CELLS) / F.size("sources"))).alias("wide"))
    blocks = cells.join(wide, "lang").groupBy("lang", F.floor(F.col("ordinal") / F.col("wide")).alias("block"))
    blocks = blocks.agg(F.collect_list(F.struct("source", "ordinal", "n")).alias("cells")).join(langs, "lang")
    tiles = F.ceil(F.size("sources") / F.col("tile_size")).cast("int")
    blocks = blocks.withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1)))
    shape = "lang string, source string, part string, item string, ordinal long, value long"
    found = common.stored(blocks.drop("block").mapInArrow(_compared(top), shape), "sd-found")

    none = langs.filter("terms = 0").select("lang", F.explode("sources.source").alias("source"), F.col("sources.source").alias("items"))
    none = none.select("lang", "source", F.explode("items").alias("item"), F.lit(0).cast("long").alias("value")).filter("source <> item")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionAll(none)
    group = Window.partitionBy("lang", "source")
    pairs = pairs.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item")))
    best = found.filter("part = 'term'").withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "ordinal"))).filter(F.col("rank") <= top)
    best = common.stored(best, "sd-best")
    out = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    for ranges in rounds:
        number = F.shiftright("ordinal", _RANGE_BITS)
        named = best.filter(number.between(ranges[0], ranges[-1])).select("lang", "source", "part", "item", "value", "rank", "ordinal")
        named = named.mapInArrow(_named(_loaded(machines, ranges)), named.schema)
        out = out.unionAll(named.select("lang", "source", "part", "item", "value", "rank"))
    out = common.stored(out, "sd-result")
    common.discard(kept, machines, *counts, langs, found, best)
    return out
