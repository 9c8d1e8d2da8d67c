"""Benchmark decontamination by latent semantic retrieval.

TF-IDF vectors over hashed words are projected on the leading right singular vectors of a passage matrix,
found by distributed randomised SVD on every passage of all texts and items, and scaled by their damped
inverse singular values. Of every text, windows of about an item's own length whose cosine with the
item reaches MIN_COSINE are candidates; a candidate is a hit if the longest common subsequence of words and
the item's answer words confirm it. Retrieval is the index below together with the cosine: the index names the
stretches, the cosine takes away those of them that are far from the item in the latent space.

Windows are looked at only where a hit is possible at all. A hit has MIN_COMMON of an item's words in a
stretch, so of any m of its places all but the share that may be missing are met there. The rarest places
of all items are an inverted index; a text's words are looked up in it, and a stretch that meets too few of
an item's places is passed over. This loses nothing, whatever places are chosen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm import common

DIM_BITS = 14
DIM = 1 << DIM_BITS
RANK = 96
EXTRA = 16
PASSAGE = 48
#: Lengths of windows; an item is searched with the nearest (by ratio), a quarter of it apart.
WINDOWS = (8, 16, 32, 64, 128, 256)
MIN_COSINE = 0.3
#: Indexed places of an item that a hit must meet, where the item is long enough.
MET = 4
MIN_COMMON = 0.6
SURE_COMMON = 0.85
ANSWER_WORDS = 5
#: Passages whose products are summed together, and those of them that are a matrix of the HEAD most frequent buckets.
GROUP = 16_384
BLOCK = 256
HEAD = 512
#: Cells that are looked up together.
CELLS = 128
#: Bits of the buckets that words are counted in.
COUNT_BITS = 20
ITEM_BLOCK = 65_536
#: Windows of a stretch that are looked at together.
CHUNK = 32
#: Cells of the table of words by item words that ``held`` makes at most.
HELD_CELLS = 1 << 22
_ROWS = 256
_TABLE = common.byte_table(separators=frozenset(b for b in range(1, 128) if not chr(b).isalnum()))


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - DIM_BITS)).astype(np.int64)


def _counted(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _scan(wanted: np.ndarray | None = None):
    """The word buckets of each text, two bytes each; of a task, the document frequencies of buckets, after
    them the number of texts, and then how often the (wanted) finer buckets have a word."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIM + 1 + (1 << COUNT_BITS), np.int64)
        for batch in batches:
            words, at = common.word_hashes(batch.column("_lower"), _TABLE)
            bucket = _bucket(words)
            own = np.sort(np.repeat(np.arange(batch.num_rows), np.diff(at)) << DIM_BITS | bucket)
            df[:DIM] += np.bincount(own[_begins(own)] & (DIM - 1), minlength=DIM)
            df[DIM] += batch.num_rows
            df[DIM + 1 :] += np.bincount(_counted(words), minlength=1 << COUNT_BITS)
            buffers = [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(bucket.astype(np.uint16))]
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.Array.from_buffers(pa.binary(), batch.num_rows, buffers)], ["bucket", "df", "words"])
        if wanted is not None:
            df[DIM + 1 :] *= wanted
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some]), pa.nulls(len(some), pa.binary())], ["bucket", "df", "words"])

    return scan


def _begins(x: np.ndarray) -> np.ndarray:
    """Places where a sorted array has another value than before."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])


def _cells(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(passages, row, column, value) of groups of passages: their TF-IDF rows of length 1, without zeros, by row."""
    texts = batch.column("words").to_pylist()
    buckets, at = np.frombuffer(b"".join(texts), np.uint16), np.cumsum([0] + [len(x) // 2 for x in texts])
    n = -(-np.diff(at) // PASSAGE)
    begin = np.repeat(at[:-1], n) + PASSAGE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    end = np.minimum(begin + PASSAGE, np.repeat(at[1:], n))
    for i in range(0, len(begin), GROUP):
        size = end[i : i + GROUP] - begin[i : i + GROUP]
        own = np.repeat(np.arange(len(size)), size) << DIM_BITS | buckets[begin[i] : begin[i] + size.sum()]
        own = own[idf[own & (DIM - 1)] > 0]
        own.sort()
        at_cell = _begins(own)
        tf, own = np.diff(np.append(at_cell, len(own))), own[at_cell]
        row, column = own >> DIM_BITS, own & (DIM - 1)
        x = tf * idf[column]
        norm = np.sqrt(np.bincount(row, x * x, minlength=len(size)))
        yield len(size), row, column, (x / norm[row]).astype(np.float32)


def _sum_rows(out: np.ndarray, to: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    """Add to row to[i] of ``out``, ``to`` being sorted, value[i] times row at[i] of ``rows``.

    CELLS of them are one product; their runs of one row are found for all of them together.
    """
    begins = np.zeros(len(to), bool)
    begins[_begins(to)] = True
    begins[::CELLS] = True
    target = to[begins]
    run = np.cumsum(begins) - 1
    cuts = np.append(run[::CELLS], len(target)).tolist()
    cell = np.arange(len(to))
    flat = (run - run[cell // CELLS * CELLS]) * CELLS + cell % CELLS
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = slice(k * CELLS, (k + 1) * CELLS)
        pick = np.zeros((b - a) * CELLS, np.float32)
        pick[flat[part]] = value[part]
        own = rows.take(at[part], axis=0)
        out[target[a:b]] += pick.reshape(b - a, CELLS)[:, : len(own)] @ own


class _Product:
    """Products with A, the TF-IDF rows of passages: dense for the most frequent buckets, by cells for the others."""

    def __init__(self, basis: np.ndarray, idf: np.ndarray, df: np.ndarray) -> None:
        self.basis, self.idf = basis.astype(np.float32), idf
        self.head = np.argsort(np.where(idf > 0, -df, 1), kind="stable")[:HEAD]
        self.place = np.full(DIM, -1)
        self.place[self.head] = np.arange(HEAD)

    def rows(self, batch: pa.RecordBatch, back: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """A basis, for groups of passages; A^T (A basis) is added to ``back``."""
        top = self.basis[self.head]
        for n, row, column, value in _cells(batch, self.idf):
            out = np.zeros((n, self.basis.shape[1]), np.float32)
            place, blocks = self.place[column], np.arange(0, n + BLOCK, BLOCK)
            head, rest = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
            flat, top_value, top_cuts = row[head] * len(top) + place[head], value[head], np.searchsorted(row[head], blocks)
            row, column, value = row[rest], column[rest], value[rest]
            cuts = np.searchsorted(row, blocks)
            for k in range(len(cuts) - 1):
                own = out[k * BLOCK : (k + 1) * BLOCK]
                dense = np.zeros((len(own), len(top)), np.float32)
                part = slice(int(top_cuts[k]), int(top_cuts[k + 1]))
                dense.reshape(-1)[flat[part] - k * BLOCK * len(top)] = top_value[part]
                np.matmul(dense, top, out=own)
                part = slice(int(cuts[k]), int(cuts[k + 1]))
                _sum_rows(own, row[part] - k * BLOCK, self.basis, column[part], value[part])
                if back is not None:
                    back[self.head] += dense.T @ own
            if back is not None:
                column = column.astype(np.uint16)
                order = np.argsort(column, kind="stable")
                _sum_rows(back, column[order], out, row[order], value[order])
            yield out


def _half_step(product: _Product):
    """A task's part of A^T (A basis), in pieces of _ROWS features."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros(product.basis.shape)
        for batch in batches:
            for _ in product.rows(batch, z):
                pass
        pieces = [z[i : i + _ROWS].tobytes() for i in range(0, DIM, _ROWS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "part"])

    return step


def _square(product: _Product):
    """A task's part of (A basis)^T (A basis)."""

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros((product.basis.shape[1],) * 2)
        for batch in batches:
            for rows in product.rows(batch):
                z += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([z.tobytes()], pa.binary())], ["piece", "part"])

    return square


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts of each piece; a piece's parts are all in one task and never held together."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, part in zip(batch.column("piece").to_pylist(), batch.column("part"), strict=True):
            part = np.frombuffer(part.as_buffer())
            sums[piece] = sums[piece] + part if piece in sums else part
    pieces = [x.tobytes() for x in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "part"])


def _summed(passages: DataFrame, parts, size: int) -> np.ndarray:
    """The tasks' parts summed piece by piece in Spark: ``size`` rows, a number that DIM and RANK set."""
    kind, out = "piece int, part binary", np.zeros((size, RANK + EXTRA))
    for r in passages.mapInArrow(parts, kind).repartition("piece").mapInArrow(_add_parts, kind).collect():
        part = np.frombuffer(r["part"]).reshape(-1, RANK + EXTRA)
        out[r["piece"] * _ROWS :][: len(part)] = part
    return out


def _frequencies(seen: DataFrame) -> np.ndarray:
    """What ``_scan`` counted, of all tasks."""
    out = np.zeros(DIM + 1 + (1 << COUNT_BITS))
    sums = seen.filter("words IS NULL").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    out[sums["bucket"].to_numpy()] = sums["df"].to_numpy()
    return out


def latent_map(documents: DataFrame, items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(DIM x rank) map from word buckets to whitened latent space, idf included; and how often the documents
    have a word of each finer bucket that the items' words fall in.

    Both are of all documents: the SVD is fitted on every passage of PASSAGE words of every document and
    item. Products of passages are of single precision, their sums of double.
    """
    kind = "bucket long, df long, words binary"
    texts, own = (x.select(F.lower("text").alias("_lower")).filter("_lower IS NOT NULL") for x in (documents, items))
    own = common.stored(own.mapInArrow(_scan(), kind), "dc-items")
    in_items = _frequencies(own)
    seen = common.stored(texts.mapInArrow(_scan(in_items[DIM + 1 :] > 0), kind), "dc-scan")
    df = _frequencies(seen)
    counts = df[DIM + 1 :]
    # what every fifth document and every fifth of at least five items has says nothing; an item that many
    # documents copied keeps its words
    empty = (df[:DIM] > 0.2 * df[DIM]) & (in_items[:DIM] > max(0.2 * in_items[DIM], 4))
    idf = np.where(empty, 0.0, np.maximum(np.log((1.0 + df[DIM]) / (1.0 + df[:DIM])), 0.1))
    passages = seen.unionAll(own).filter("words IS NOT NULL").select("words")
    rng = np.random.default_rng(5)
    start = rng.standard_normal((DIM, RANK + EXTRA))
    basis = np.linalg.qr(_summed(passages, _half_step(_Product(start, idf, df[:DIM])), DIM))[0]
    inner = _summed(passages, _square(_Product(basis, idf, df[:DIM])), RANK + EXTRA)
    common.discard(seen, own)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(values)[::-1][:RANK]
    order = order[values[order] > 1e-9 * max(values.max(), 1e-300)]
    if not len(order):
        return np.zeros((DIM, 0), np.float32), counts
    scale = np.sqrt(values[order] + np.median(values[order]))  # damped, so that rare directions don't drown the others
    return (idf[:, None] * (basis @ vectors[:, order]) / scale).astype(np.float32), counts


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def window_of(length: int) -> int:
    """The length of windows that an item of ``length`` words is searched with."""
    return min(WINDOWS, key=lambda w: max(w, length) / min(w, length))


def _windows(words: np.ndarray, size: int, latent: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the windows of ``size`` words that begin every size / 4 words."""
    step = size // 4
    sums = np.add.reduceat(latent[_bucket(words)], np.arange(0, len(words), step), axis=0)
    total = sums.copy()
    for j in range(1, min(4, len(sums))):
        total[:-j] += sums[j:]
    return _unit(total)


def common_subsequence(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Bits of the item's words on a longest common subsequence's frontier: zero bits mark its words (bit-parallel)."""
    full = (1 << length) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return full & ~v


def _masks(words: np.ndarray) -> dict[int, int]:
    """For each word the bits of its places."""
    masks: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


class _Item:
    """An item's words, its telling words (``rare``, all if it has none) and its answer words."""

    def __init__(self, item_id: int, words: np.ndarray, answer: np.ndarray, rare: np.ndarray | None = None) -> None:
        telling = words if rare is None or not rare.any() else words[rare]
        answer = answer if len(answer) else words[-ANSWER_WORDS:]
        self.id, self.length, self.rare_length, self.answer_length = item_id, len(words), len(telling), len(answer)
        self.masks, self.rare, self.answer = _masks(words), _masks(telling), _masks(answer)
        self.sorted, self.times = np.unique(words, return_counts=True)

    def most(self, words: np.ndarray) -> int:
        """How many of the item's words, each as often as the item has it at most, some words hold together."""
        place = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        own = place[self.sorted[place] == words]
        return int(np.minimum(np.bincount(own, minlength=len(self.sorted)), self.times).sum())

    def held(self, words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How many of the item's words, each as often as the item has it at most, the stretches hold."""
        place = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        own = np.flatnonzero(self.sorted[place] == words)
        if (len(words) + 1) * len(self.sorted) > HELD_CELLS:  # a long item: one of its words after the other
            order = own[np.argsort(place[own], kind="stable")]
            cuts = np.searchsorted(place[order], np.arange(len(self.sorted) + 1))
            total = np.zeros(len(start), np.int64)
            for k in range(len(self.sorted)):
                at = order[cuts[k] : cuts[k + 1]]
                if len(at):
                    total += np.minimum(np.searchsorted(at, stop) - np.searchsorted(at, start), self.times[k])
            return total
        seen = np.zeros((len(words) + 1, len(self.sorted)), np.int32)
        seen[own + 1, place[own]] = 1
        np.cumsum(seen, axis=0, out=seen)
        return np.minimum(seen[stop] - seen[start], self.times).sum(axis=1)


def _confirm(item: _Item, words: np.ndarray) -> tuple[int, bool, bool]:
    """(common words, the answer is there, it is a hit); a hit also needs half of the telling words in order."""
    listed = [w for w in words.tolist() if w in item.masks or w in item.answer]
    if len(listed) < MIN_COMMON * item.length:  # too few words of the item for any subsequence
        return 0, False, False
    n = common_subsequence(item.masks, item.length, listed).bit_count()
    if n < MIN_COMMON * item.length or 2 * common_subsequence(item.rare, item.rare_length, listed).bit_count() < item.rare_length:
        return n, False, False
    answered = 5 * common_subsequence(item.answer, item.answer_length, listed).bit_count() >= 3 * item.answer_length
    return n, answered, n >= SURE_COMMON * item.length or answered


class _Index:
    """Items by their rarest places: sorted words, and for each the items that have it there."""

    def __init__(self, ids: list[int], words: list[np.ndarray], answers: list[np.ndarray], vectors: np.ndarray, vocabulary: np.ndarray, counts: np.ndarray) -> None:
        self.ids, self.words, self.answers, self.vectors = ids, words, answers, vectors
        self.need = np.zeros(len(ids), np.int64)
        pairs = []
        for i, own in enumerate(words):
            missing = len(own) - math.ceil(MIN_COMMON * len(own) - 1e-9)
            chosen = np.argsort(counts[np.searchsorted(vocabulary, own)], kind="stable")[: missing + MET]
            self.need[i] = len(chosen) - missing
            at = np.unique(own[chosen])
            pairs.append((at, np.full(len(at), i)))
        word, item = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, t) for k, t in ((0, np.uint64), (1, np.int64)))
        order = np.argsort(word, kind="stable")
        self.items = item[order]
        self.keys, self.first = np.unique(word[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.reach = np.array([window_of(len(w)) + 2 * len(w) for w in words], np.int64)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self._made: dict[int, _Item] = {}

    def item(self, i: int, latent: np.ndarray) -> _Item:
        if i not in self._made:
            own = self.words[i]
            self._made[i] = _Item(self.ids[i], own, self.answers[i], (latent[_bucket(own)] != 0).any(axis=1))
        return self._made[i]

    def places(self, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, last word) of stretches that meet enough of an item's indexed places."""
        if not len(self.keys):
            return
        some = np.flatnonzero(self.bits[(words >> np.uint64(44)).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, words[some]), len(self.keys) - 1)
        hit = self.keys[key] == words[some]
        some, key = some[hit], key[hit]
        n = self.first[key + 1] - self.first[key]
        place = np.repeat(some, n)
        item = self.items[np.arange(len(place)) + np.repeat(self.first[key] - np.cumsum(n) + n, n)]
        text = np.searchsorted(at, place, "right") - 1
        order = np.lexsort((place, item, text))
        text, item, place = text[order], item[order], place[order]
        last = np.arange(len(place)) + self.need[item] - 1
        ok = last < len(place)
        last = np.minimum(last, len(place) - 1)
        ok &= (text[last] == text) & (item[last] == item) & (place[last] - place < self.reach[item])
        begin = None
        for a in np.flatnonzero(ok).tolist():  # stretches of one item that may overlap are one, however long
            now = (int(text[a]), int(item[a]), int(place[a]), int(place[last[a]]))
            if begin and begin[:2] == now[:2] and now[2] - begin[3] < self.reach[item[a]]:
                begin = (*begin[:3], max(begin[3], now[3]))
            else:
                if begin:
                    yield begin
                begin = now
        if begin:
            yield begin


def _candidates(item: _Item, part: np.ndarray, size: int, latent: np.ndarray, vector: np.ndarray, min_cosine: float) -> Iterator[int]:
    """First words of the windows of a stretch that have enough of an item's words and are near it.

    Windows are looked at CHUNK at a time, with the words around them, so memory goes by the item's length
    however long the stretch is.
    """
    if item.most(part) < MIN_COMMON * item.length:  # then no window of the stretch has enough
        return
    step = size // 4
    starts = np.arange(0, len(part), step)
    for k in range(0, len(starts), CHUNK):
        begin = starts[k : k + CHUNK]
        low = max(int(begin[0]) - item.length, 0)
        near = part[low : int(begin[-1]) + size + item.length]
        held = item.held(near, np.maximum(begin - item.length, 0) - low, np.minimum(begin + size + item.length, len(part)) - low)
        enough = held >= MIN_COMMON * item.length  # else too few words of the item for any subsequence
        if not enough.any():
            continue
        if vector.any():  # an item without a telling word has no direction: all its windows are candidates
            enough &= _windows(part[int(begin[0]) : int(begin[-1]) + size], size, latent)[: len(begin)] @ vector >= min_cosine
        yield from begin[enough].tolist()


def _search(latent: np.ndarray, index: _Index, min_cosine: float):
    schema = ["doc_id", "item_id", "n_common", "item_words", "answered", "first_word", "last_word"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = common.word_hashes(batch.column("_lower"), _TABLE)
            ids = batch.column("doc_id").to_pylist()
            best: dict[tuple[int, int], tuple] = {}
            for row, i, first, last in index.places(words, at):
                item, reach, size = index.item(i, latent), int(index.reach[i]), window_of(len(index.words[i]))
                a, b, step = int(at[row]), int(at[row + 1]), size // 4
                lo = a + max(first - a - reach, 0) // step * step
                for w in _candidates(item, words[lo : min(last + reach, b)], size, latent, index.vectors[i], min_cosine):
                    found = best.get((row, i))
                    if found and found[2] == item.length:
                        break
                    start, stop = max(lo + w - item.length, a), min(lo + w + size + item.length, b)
                    n, answered, hit = _confirm(item, words[start:stop])
                    if hit and (not found or n > found[2]):
                        best[row, i] = (ids[row], item.id, n, item.length, answered, start - a, stop - a - 1)
            columns = list(zip(*best.values(), strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], schema)

    return search


def contaminated(documents: DataFrame, benchmark: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row per document and item of the benchmark that it holds: doc_id, item_id, n_common, item_words,
    answered, first_word, last_word (of the stretch that was compared).

    The benchmark is the stated query set and is searched in blocks of about ITEM_BLOCK items against all
    documents. An ``answer`` column, if it has one, gives the answers; else an item's last ANSWER_WORDS
    words do. Items without a word, null texts and empty texts give no rows, as do empty tables; a null
    doc_id is carried as null. Of equally good places of an item in a text the first is reported; repeated
    rows are searched and reported each. A very long text is hashed whole; its stretches that may hold an item
    are projected and compared CHUNK windows at a time. Other columns are ignored, whatever their names.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("_lower")).filter("_lower IS NOT NULL")
    items = benchmark.filter("text IS NOT NULL")
    answer = F.lower("answer") if "answer" in benchmark.columns else F.lit("")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"), F.coalesce(answer, F.lit("")).alias("answer"))
    blocks = -(-max(items.count(), 1) // ITEM_BLOCK)
    latent, counts = latent_map(docs.select(F.col("_lower").alias("text")), items)
    numbered = items.select("*", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    out = None
    for block in range(blocks):
        rows = numbered.filter(F.col("block") == block).orderBy("item_id", "text").collect()
        words, at = common.word_hashes(pa.array([r["text"] for r in rows], pa.string()), _TABLE)
        answers, answer_at = common.word_hashes(pa.array([r["answer"] for r in rows], pa.string()), _TABLE)
        vocabulary = np.unique(words)
        known = [i for i in range(len(rows)) if at[i + 1] > at[i]]
        own = [words[at[i] : at[i + 1]] for i in known]
        vectors = _unit(np.array([latent[_bucket(w)].sum(axis=0) for w in own], np.float32).reshape(len(own), latent.shape[1]))
        index = _Index([rows[i]["item_id"] for i in known], own, [answers[answer_at[i] : answer_at[i + 1]] for i in known], vectors, vocabulary, counts[_counted(vocabulary)])
        found = docs.mapInArrow(
            _search(latent, index, min_cosine),
            "doc_id long, item_id long, n_common int, item_words int, answered boolean, first_word int, last_word int",
        )
        if blocks > 1:  # only one block's items are held at a time
            found = common.stored(found, "dc-found")
        out = found if out is None else out.unionAll(found)
    return out


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item; rows with a null doc_id stay."""
    ids = common.stored(contaminated(documents, benchmark).select("doc_id").filter("doc_id IS NOT NULL").distinct(), "dc-ids")
    return documents.join(ids.hint("merge"), "doc_id", "left_anti").select(*documents.columns)
