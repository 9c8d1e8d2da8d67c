"""Ranked lexical search of many items at once, with their common subexpressions evaluated once.

One pass over the texts keeps each document's length and its counts of the items' terms. The items' terms are
mined for shared sets: pairs of terms, or of sets found before, that stand in several items become nodes of
a query-sharing DAG. For a block of documents every node's partial score is computed once from its two parts,
and an item's score is the sum of the few nodes that are left of it. Each task keeps the best documents of
each item, and these are ranked at the end.
"""

from __future__ import annotations

import dataclasses
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm import common, transducer

TOP = 20
#: Terms of the items that one pass over the texts looks for, about.
PASS_TERMS = 1 << 18
#: Items of one query-sharing DAG.
DAG_ITEMS = 256
#: Neighbours, in the order of an item's nodes by frequency, that a node is paired with.
NEAR = 8
#: Cells of the accumulators of one block of documents.
CELLS = 1 << 20
SCALE = 10**9
_TABLE = common.byte_table(frozenset(range(0x30)) | frozenset(range(0x3A, 0x41)) | frozenset(range(0x5B, 0x61)) | frozenset(range(0x7B, 0x80)))
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclasses.dataclass
class Dag:
    """Leaves (term number, repeats), then inner nodes level by level (two parts each); ``nodes`` of the items
    one after another with ``first`` of each; ``items`` by name."""

    items: list
    term: np.ndarray
    repeats: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    nodes: np.ndarray
    first: np.ndarray

    def width(self) -> int:
        return len(self.term) + sum(len(a) for a, _ in self.levels)


def shared(items: list, bags: list[dict[int, int]]) -> Dag:
    """The query-sharing DAG of items given as (term number: repeats).

    Level by level, pairs of nodes that stand near each other in two items or more are taken, those of the
    most items first, while neither part is taken in the item yet; the pair becomes a node in those items.
    Which pairs are looked at bears on the work alone, never on scores.
    """
    leaves = sorted({x for bag in bags for x in bag.items()})
    number = {x: i for i, x in enumerate(leaves)}
    held = [[number[x] for x in bag.items()] for bag in bags]
    size, levels = len(leaves), []
    while True:
        often = Counter(n for nodes in held for n in nodes)
        held = [sorted(nodes, key=lambda n: (-often[n], n)) for nodes in held]
        meets: dict[tuple[int, int], list[int]] = {}
        for i, nodes in enumerate(held):
            nodes = [n for n in nodes if often[n] > 1]
            for k, a in enumerate(nodes):
                for b in nodes[k + 1 : k + 1 + NEAR]:
                    meets.setdefault((min(a, b), max(a, b)), []).append(i)
        left, right = [], []
        taken: list[set[int]] = [set() for _ in held]
        fresh: list[list[int]] = [[] for _ in held]
        for (a, b), where in sorted(meets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(where) < 2:
                break
            where = [i for i in where if a not in taken[i] and b not in taken[i]]
            if len(where) < 2:
                continue
            for i in where:
                taken[i] |= {a, b}
                fresh[i].append(size + len(left))
            left.append(a)
            right.append(b)
        if not left:
            break
        held = [[n for n in nodes if n not in gone] + new for nodes, gone, new in zip(held, taken, fresh, strict=True)]
        levels.append((np.array(left), np.array(right)))
        size += len(left)
    lengths = np.array([len(nodes) for nodes in held], np.int64)
    term, repeats = (np.array([x[i] for x in leaves], np.int64) for i in (0, 1))
    return Dag(items, term, repeats, levels, np.array([n for nodes in held for n in nodes], np.int64), np.cumsum(lengths) - lengths)


def evaluated(dag: Dag, gains: np.ndarray) -> np.ndarray:
    """Scores (items x documents) from the terms' gains (terms x documents): every node is computed once."""
    sums = np.empty((dag.width(), gains.shape[1]), np.int64)
    at = len(dag.term)
    np.multiply(gains[dag.term], dag.repeats[:, None], out=sums[:at])
    for left, right in dag.levels:
        np.add(sums[left], sums[right], out=sums[at : at + len(left)])
        at += len(left)
    return np.add.reduceat(sums[dag.nodes], dag.first, axis=0)


class Best:
    """The ``top`` best (score, doc_id) of each item; of equal scores the least doc_id."""

    def __init__(self, items: int, top: int):
        self.top, self.score = top, np.zeros((items, top), np.int64)
        self.doc = np.full((items, top), np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        low, last = self.score[:, -1:], self.doc[:, -1:]
        item, d = np.nonzero((scores > low) | ((scores == low) & (low > 0) & (docs[None, :] < last)))
        if not len(item):
            return
        some = np.unique(item)
        who = np.concatenate([item, np.repeat(some, self.top)])
        score = np.concatenate([scores[item, d], self.score[some].ravel()])
        doc = np.concatenate([docs[d], self.doc[some].ravel()])
        order = np.lexsort((doc, -score, who))
        who, score, doc = who[order], score[order], doc[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < self.top
        self.score[who[keep], place[keep]] = score[keep]
        self.doc[who[keep], place[keep]] = doc[keep]


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats) of ``items`` (item_id, text)."""
    once = items.filter("item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_TERM), F.lit(0))
    return once.select("item_id", F.explode(found).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("repeats"))


def postings(documents: DataFrame, machine: bytes) -> DataFrame:
    """(doc_id, n, terms, counts) of documents with a term: number of terms, then the transducer's terms in it."""
    sent = documents.sparkSession.sparkContext.broadcast(machine)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = transducer.Transducer.loads(sent.value)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            codes, counts = [], []
            for data, starts, row in transducer.words(batch.column("text"), _TABLE):
                n += np.bincount(row, minlength=len(n))
                place = loaded.ordinals(data, starts, np.full(len(starts), loaded.root), np.zeros(len(starts), np.int64))
                hit = place >= 0
                code, count = np.unique((row[hit].astype(np.int64) << 32) | place[hit], return_counts=True)
                codes.append(code)
                counts.append(count)
            code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            code, at = np.unique(code, return_inverse=True)
            count = np.bincount(at, np.concatenate(counts) if counts else None, len(code)).astype(np.int64)
            ends = pa.array(np.searchsorted(code, np.arange(len(n) + 1) << 32).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array((code & 0xFFFFFFFF).astype(np.int32)), pa.array(count))]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(n > 0))

    return documents.select("doc_id", "text").mapInArrow(find, "doc_id long, n long, terms array<int>, counts array<long>")


def _search(found: DataFrame, dags: list[Dag], weight: np.ndarray, documents: int, total: int, top: int) -> DataFrame:
    """(item, score, doc_id): the best documents of each task for each item (numbered over all DAGs)."""
    sent = found.sparkSession.sparkContext.broadcast((dags, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dags, weight = sent.value
        best = [Best(len(d.items), top) for d in dags]
        block = max(1, CELLS // max(max(d.width() for d in dags), len(weight)))
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                n = part.column("n").to_numpy()
                size = np.diff(part.column("terms").offsets.to_numpy())
                doc = np.repeat(np.arange(len(n)), size)
                term, tf = (part.column(x).flatten().to_numpy() for x in ("terms", "counts"))
                m = 75 + (25 * n * documents) // total
                gains = np.zeros((len(weight), len(n)), np.int64)
                gains[term, doc] = weight[term] * ((SCALE * tf) // (1000 * tf + 12 * m[doc]))
                docs = part.column("doc_id").to_numpy()
                for dag, kept in zip(dags, best, strict=True):
                    kept.add(evaluated(dag, gains), docs)
        first = 0
        for kept in best:
            item, place = np.nonzero(kept.score > 0)
            yield pa.RecordBatch.from_arrays([pa.array(item + first), pa.array(kept.score[item, place]), pa.array(kept.doc[item, place])], ["item", "score", "doc_id"])
            first += len(kept.score)

    return found.filter("doc_id IS NOT NULL AND size(terms) > 0").mapInArrow(run, "item long, score long, doc_id long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each item, ranked: first among the rows of some tasks, then among what is left."""
    order = (F.desc("score"), "doc_id")
    salt = F.pmod(F.spark_partition_id(), F.lit(64))
    some = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order)))
    some = some.filter(F.col("rank") <= top).drop("salt", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)


def search(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest-scoring ``documents`` of each item, scores above 0.

    Terms are runs of digits, letters A-Z (lower-cased) and characters from U+0080. A null text has none. Rows
    of a null doc_id count in all statistics but are never returned; a null item_id is ignored, of several
    texts of one item_id the least counts. Repeated rows of documents are separate documents. Equal scores go
    by ascending doc_id. A very long text is read in pieces, and only the items' terms of it are kept. Without
    documents or items there are no rows. Other columns are ignored, whatever their names. Numbers are 64-bit;
    a document's terms times all documents must stay under 3 * 10^17.

    Items are taken in passes of about PASS_TERMS terms, by a hash of their id; a pass's terms and DAGs are
    what is broadcast.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select("item_id", F.col("text").cast("string").alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    wanted = common.stored(item_terms(asked), "ls-items")
    rounds = -(-wanted.count() // PASS_TERMS)
    out = None
    for i in range(rounds):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == i).collect()
        terms = sorted({r["term"].encode() for r in rows})
        number = {t: k for k, t in enumerate(terms)}
        bags: dict[object, dict[int, int]] = {}
        for r in sorted(rows, key=lambda r: (r["item_id"], r["term"])):
            bags.setdefault(r["item_id"], {})[number[r["term"].encode()]] = r["repeats"]
        found = common.stored(postings(docs, transducer.built(terms).dumps()), "ls-postings")
        n, total = found.agg(F.count("*"), F.sum("n")).first()
        if not n:
            break
        held = np.zeros(len(terms), np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
            held[r["term"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in held], np.int64)
        ids = list(bags)
        dags = [shared(ids[k : k + DAG_ITEMS], [bags[x] for x in ids[k : k + DAG_ITEMS]]) for k in range(0, len(ids), DAG_ITEMS)]
        best = _ranked(_search(found, dags, weight, n, total, top), top)
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind}")
        best = common.stored(best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ls-best")
        common.discard(found)
        out = best if out is None else out.unionAll(best)
    common.discard(wanted)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out
