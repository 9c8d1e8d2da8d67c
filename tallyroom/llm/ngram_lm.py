"""Scoring texts with a weighted backoff automaton over n-gram counts of the whole corpus.

A state is a context h of up to ``ORDER - 1`` training tokens (the root is the empty one). It has an arc for
each token w seen after it, of weight p(w|h) = (c(hw) + K p(w|h')) / (c(h) + K), to the longest end of hw
that is a state, and a failure arc of weight K / (c(h) + K) to the state h' without h's first token. The
root's arcs are add-one unigrams, also for unknown tokens. One left-to-right traversal carries the state,
follows failure arcs until the token has an arc, and accumulates log10 weights.

The automaton may be far larger than any one machine, so it is never gathered. Documents are packed into
blocks and stored; a block asks for the counts of its own distinct n-grams, requests are dealt by ranges of n-gram
hashes, summed, and answered. From the answers a block builds the states and arcs that its own texts can
reach. Its texts are cut into stretches that are traversed in lock step; a stretch inside a text begins
``ORDER - 1`` tokens early, after which its state is that of the whole traversal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.llm import common

ORDER = 3
K = 50.0
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
STRETCH = 64
_TABLE = common.byte_table()
_END = np.uint64(0x51ED270B7F4A7C15)
_BEGIN = np.uint64(0xB5297A4D3F8C1E27)
#: n-grams of two tokens and more are known by the upper 56 bits of their hash.
_UPPER = np.uint64(0xFFFFFFFFFFFFFF00)


def _tokens(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with order - 1 begin marks before each text and one end after, and row offsets."""
    words, at = common.word_hashes(texts, _TABLE)
    pad = order - 1
    n = np.diff(at)
    offsets = np.concatenate([[0], np.cumsum(n + pad + 1)])
    out = np.full(offsets[-1], _BEGIN, np.uint64)
    out[offsets[1:] - 1] = _END
    place = np.arange(len(words)) + np.repeat(offsets[:-1] + pad - at[:-1], n)
    out[place] = words
    return out, offsets


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and the number of each place's value."""
    by = common.order_of(grams)
    held = grams[by]
    new = np.append(True, held[1:] != held[:-1])
    number = np.empty(len(grams), np.int32)
    number[by] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return held[new], by[new], number


class _Grams:
    """Distinct k-grams of a block's texts, and which of them ends at each counted token.

    Begin marks are no counted tokens; the k-gram of k begin marks, for k under the order, is one more.
    """

    def __init__(self, texts: pa.Array, order: int) -> None:
        tokens, offsets = _tokens(texts, order)
        pad = order - 1
        counted = np.ones(len(tokens), bool)
        for j in range(pad):
            counted[offsets[:-1] + j] = False
        where = np.flatnonzero(counted)
        self.size = np.diff(offsets) - pad
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.first = np.cumsum(self.size) - self.size
        self.every: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        self.one: list[np.ndarray] = []  # a counted token at which each k-gram ends
        self.begin: list[int] = []
        for k in range(1, order + 1):
            runs = common.chain(tokens, k)
            grams = runs[where - (k - 1)]
            if k < order:
                grams = np.append(grams, runs[offsets[0] + pad - k])
            if k > 1:
                grams &= _UPPER
            every, one, at = _distinct(grams)
            self.every.append(every)
            self.one.append(one)
            self.at.append(at[: len(where)])
            self.begin.append(int(at[-1]) if k < order else -1)

    def before(self, k: int) -> np.ndarray:
        """The k-gram that ends just before each counted token; k is under the order."""
        out = np.roll(self.at[k - 1], 1)
        out[self.first] = self.begin[k - 1]
        return out


def _pack(grams: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by place, compressed: the upper bytes are mostly 0."""
    planes = np.ascontiguousarray(np.diff(grams, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(grams).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, those of 255 and more in full behind them, compressed."""
    plain = np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _unpack_counts(raw: bytes, size: int) -> np.ndarray:
    plain = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    counts = np.frombuffer(plain, np.uint8, size).astype(np.int64)
    counts[counts == 255] = np.frombuffer(plain[size:], np.int64)
    return counts


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a hash; buckets are ranges, so sorted hashes stay in order across buckets."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


_REQUEST = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("gram_order", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64())])
_ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("gram_order", pa.int32()), ("counts", pa.binary()), ("size", pa.int32()), ("types", pa.int64()), ("tokens", pa.int64())])


def _trained(docs: pa.Table) -> np.ndarray:
    return np.asarray(docs.column("train").combine_chunks().to_numpy(zero_copy_only=False), bool)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of about BLOCK_BYTES of text as compressed Arrow streams; a text is never cut."""
    options, held, size, number = pa.ipc.IpcWriteOptions(compression="zstd"), [], 0, TaskContext.get().partitionId() << 32

    def block() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, whole.schema, options=options) as out:
            out.write_table(whole)
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "bytes", "docs"])

    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            done = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + BLOCK_BYTES - size, "right")))
            held.append(batch.slice(lo, hi - lo))
            size += int(ends[hi - 1]) - done
            lo = hi
            if size >= BLOCK_BYTES or lo < batch.num_rows:
                yield block()
                held, size, number = [], 0, number + 1
    if held:
        yield block()


def _unpacked(raw: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(raw.as_buffer()).read_all().combine_chunks()


def _ask(order: int, buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs in zip(batch.column("block").to_pylist(), batch.column("docs"), strict=True):
                yield from _requests(block, _unpacked(docs), order, buckets).to_batches()

    return ask


def _requests(block: int, docs: pa.Table, order: int, buckets: int) -> pa.Table:
    """A row for each order and bucket that the block has n-grams of: these and their training counts."""
    grams, train = _Grams(docs.column("text"), order), _trained(docs)
    learn = train[grams.row]
    rows: dict[str, list] = {x: [] for x in _REQUEST.names}
    for k, every in enumerate(grams.every, 1):
        counts = np.bincount(grams.at[k - 1], weights=learn, minlength=len(every)).astype(np.int64)
        if k < order:
            counts[grams.begin[k - 1]] += int(train.sum())
        bucket = _bucket(every, buckets)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(every)]]).tolist()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            rows["bucket"].append(int(bucket[lo]))
            rows["block"].append(block)
            rows["gram_order"].append(k)
            rows["grams"].append(_pack(every[lo:hi]))
            rows["counts"].append(_pack_counts(counts[lo:hi]))
            rows["tokens"].append(int(learn.sum()) if k == 1 and lo == 0 else 0)
    return pa.table(rows, schema=_REQUEST)


def _answers(key, asked: pa.Table) -> pa.Table:
    """Sum one bucket's counts over all blocks and give each block the totals of what it asked for."""
    grams = [_unpack(x) for x in asked.column("grams").to_pylist()]
    counts = [_unpack_counts(x, len(g)) for x, g in zip(asked.column("counts").to_pylist(), grams, strict=True)]
    every, _, index = _distinct(np.concatenate(grams))
    total = np.bincount(index, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
    types = 0
    if key[1].as_py() == 1:
        types = int((total > 0).sum()) - int(np.any((every == _BEGIN) & (total > 0)))
    ends = np.cumsum([0, *(len(g) for g in grams)])
    back = total[index]
    return pa.table(
        {
            "block": asked.column("block"),
            "bucket": asked.column("bucket"),
            "gram_order": asked.column("gram_order"),
            "counts": [_pack_counts(back[a:b]) for a, b in zip(ends, ends[1:], strict=False)],
            "size": np.diff(ends).astype(np.int32),
            "types": [types, *[0] * (asked.num_rows - 1)],
            "tokens": asked.column("tokens"),
        },
        schema=_ANSWER,
    )


class Automaton:
    """States and arcs that a block's texts can reach: ``totals`` are the corpus counts of its n-grams.

    State 0 is the root; then come the 1-grams of the block, its 2-grams and so on up to the order less one, of
    which those with a count are states. Arcs lie sorted by source and token, those of state s from first[s] on.
    """

    def __init__(self, grams: _Grams, totals: list[np.ndarray], tokens: int, types: int, k_weight: float) -> None:
        order = len(totals)
        start = np.cumsum([1, *(len(t) for t in totals[: order - 1])])
        self.words = len(totals[0])
        self.failure = np.zeros(start[-1], np.int64)
        self.failure_weight = np.zeros(start[-1])
        weight = (totals[0] + 1.0) / (tokens + types + 1.0)
        self.base = np.log10(weight)
        target = np.where(totals[0] > 0, 1 + np.arange(self.words), 0) if order > 1 else np.zeros(self.words, np.int64)
        arcs = [(np.zeros(self.words, np.int64), np.arange(self.words), self.base, target)]
        for k in range(2, order + 1):
            # a k-gram's token, and the (k-1)-grams that it ends and begins with
            one = np.minimum(grams.one[k - 1], len(grams.row) - 1)
            last, end, head = grams.at[0][one], grams.at[k - 2][one], grams.before(k - 1)[one]
            if k < order:  # that of begin marks only
                end[grams.begin[k - 1]] = head[grams.begin[k - 1]] = grams.begin[k - 2]
                last[grams.begin[k - 1]] = grams.begin[0]
                ids = start[k - 1] + np.arange(len(totals[k - 1]))
                self.failure[ids] = start[k - 2] + end
            weight = (totals[k - 1] + k_weight * weight[end]) / (totals[k - 2][head] + k_weight)
            some = np.flatnonzero(totals[k - 1] > 0)
            to = start[k - 1] + some if k < order else start[k - 2] + end[some]
            arcs.append((start[k - 2] + head[some], last[some], np.log10(weight[some]), to))
        if order > 1:
            self.failure_weight[1:] = np.log10(k_weight / (np.concatenate(totals[: order - 1]) + k_weight))
        sources, words, weights, targets = (np.concatenate([a[i] for a in arcs]) for i in range(4))
        keys = sources * self.words + words
        by_key = common.order_of(keys.view(np.uint64))
        self.keys, self.weights, self.targets = keys[by_key], weights[by_key], targets[by_key]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sources, minlength=start[-1]))])
        begin = grams.begin[order - 2] if order > 1 else 0
        self.initial = int(start[order - 2] + begin) if order > 1 and totals[order - 2][begin] > 0 else 0

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after the token, log10 weight of the arcs on the way) for each of several traversals."""
        state, weight, left = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(left):
            source = state[left]
            key, arc = source * self.words + word[left], np.minimum(self.first[source], len(self.keys) - 1)
            there = self.keys[arc] == key
            more = np.flatnonzero(~there & (self.first[source + 1] - self.first[source] > 1))  # most states have one arc
            arc[more] = np.minimum(np.searchsorted(self.keys, key[more]), len(self.keys) - 1)
            there[more] = self.keys[arc[more]] == key[more]
            done, arc = left[there], arc[there]
            weight[done] += self.weights[arc]
            state[done] = self.targets[arc]
            left = left[~there]
            weight[left] += self.failure_weight[state[left]]
            state[left] = self.failure[state[left]]
        return state, weight

    def traverse(self, grams: _Grams, order: int, length: int = STRETCH) -> np.ndarray:
        """log10 probability of each text."""
        pieces = -(-grams.size // length)
        row = np.repeat(np.arange(len(pieces)), pieces)
        place = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
        begin, stop = grams.first[row] + place, grams.first[row] + np.minimum(place + length, grams.size[row])
        state, total = np.where(place == 0, self.initial, 0), np.zeros(len(row))
        for t in range(1 - order, length):
            # a stretch inside a text first reads the tokens that its state depends on
            on = np.flatnonzero((begin + t < stop) & ((t >= 0) | (place + t >= 0)))
            if not len(on):
                continue
            state[on], weight = self.step(state[on], grams.at[0][begin[on] + t])
            if t >= 0:
                total[on] += weight
        return np.bincount(row, weights=total, minlength=len(pieces))


def _scores(packed: pa.Table, answers: pa.Table, order: int, k_weight: float, tokens: int, types: int) -> pa.Table:
    """The traversal of one block's texts."""
    docs = _unpacked(packed.column("docs")[0])
    grams = _Grams(docs.column("text"), order)
    answers = answers.sort_by([("gram_order", "ascending"), ("bucket", "ascending")])
    orders, sizes = np.asarray(answers.column("gram_order").combine_chunks()), answers.column("size").to_pylist()
    counts = answers.column("counts").to_pylist()
    totals = [np.concatenate([_unpack_counts(counts[i], sizes[i]) for i in np.flatnonzero(orders == k)]) for k in range(1, order + 1)]
    automaton, n = Automaton(grams, totals, tokens, types, k_weight), len(grams.size)
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "train": docs.column("train"),
            "n_tokens": grams.size.astype(np.int64),
            "n_known": np.bincount(grams.row, weights=totals[0][grams.at[0]] > 0, minlength=n).astype(np.int64),
            "train_tokens": np.full(n, tokens, np.int64),
            "base_score": np.bincount(grams.row, weights=automaton.base[grams.at[0]], minlength=n),
            "score": automaton.traverse(grams, order),
        }
    )


def score_texts(documents: DataFrame, train: F.Column, order: int = ORDER, k_weight: float = K) -> DataFrame:
    """Score every text under an automaton learnt from the rows where ``train`` holds.

    Returns doc_id, train, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score; one
    row per input row. A null text is empty and has one token, its end; a null ``train`` is false.
    Without training rows every probability is that of an unknown word, 1. Rows repeat as given, and
    blocks are cut from each partition in its order, so copies spread as they lie. ``doc_id`` is only carried; other columns are
    left out, whatever their names. An empty table gives no rows. Work and memory: a block holds about
    BLOCK_BYTES of text (one longer text makes one larger block), a bucket the distinct n-grams of about
    BUCKET_BYTES. Requests are rows of a block and a bucket with at least one n-gram, so there are at most
    as many as tokens.
    """
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    packed = common.stored(docs.mapInArrow(_packed, "block long, bytes long, docs binary"), "lm-blocks")
    size = int(packed.agg(F.sum("bytes").alias("n")).first()["n"] or 0)
    buckets = max(common.partitions(docs), size // BUCKET_BYTES)
    asked = packed.select("block", "docs").mapInArrow(_ask(order, buckets), "bucket int, block long, gram_order int, grams binary, counts binary, tokens long")
    answered = asked.groupBy("bucket", "gram_order").applyInArrow(
        lambda key, t: _answers(key, t), "block long, bucket int, gram_order int, counts binary, size int, types long, tokens long"
    )
    answered = common.stored(answered, "lm-answers")
    corpus = answered.agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    tokens, types = int(corpus["tokens"] or 0), int(corpus["types"] or 0)
    return packed.select("block", "docs").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        lambda d, a: _scores(d, a, order, k_weight, tokens, types),
        "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
