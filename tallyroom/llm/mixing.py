"""Soft-membership mixing of documents to target domain weights.

A classifier trained on the labelled table gives each document posterior probabilities of the domains.
Nonnegative document rates are fitted so that expected domain token totals, the sum over documents of
rate * tokens * posterior, match the targets: distributed projected gradient on the squared misfit.

A document's gradient is its posterior times the misfit of the domains (in the metric of its tokens). From one
rate for all, rates take a projected gradient step whose gradient is that of its own end (an implicit step):
rate = max(0, budget - length * posterior @ misfit), where misfit is what those rates leave. The misfit of a
length is found by Newton's method on its few numbers, one aggregation over a compact table of token counts and
posteriors for each iteration. Lengths grow until a bound says that no rates do much better; then the step has
come to the least-squares rates that are nearest to the one rate. Targets that the posteriors can't reach leave a
misfit, which is returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroom.llm import common, langid

PER_DOMAIN = 1500
#: Domains differ by less than languages do, so the classifier keeps more of its weights.
L1 = 1e-4
BUDGET = 0.5
#: The fit ends when no rates can lessen the squared misfit by more than this share of it ...
GAP = 0.01
#: ... or when the misfit is this share of the budget at most.
TOLERANCE = 1e-4
#: Each step is so many times as long as the one before.
GROWTH = 8.0
#: Shares of a Newton step that are tried in one pass.
SHARES = (1.0, 0.5, 0.25, 0.125, 0.06, 0.03, 0.015, 0.004)
_TABLE = common.byte_table()


def labelled_sample(documents: DataFrame, labels: DataFrame, domain: F.Column, per_domain: int = PER_DOMAIN) -> tuple[DataFrame, list[str]]:
    """About ``per_domain`` labelled documents of each domain, and the domains by name.

    The label rows are drawn first, so a bounded number of ids meets the documents.
    """
    rows = labels.select(F.col("doc_id").alias("doc_id"), domain.cast("string").alias("_label")).filter("doc_id IS NOT NULL AND _label IS NOT NULL")
    rows = rows.groupBy("doc_id").agg(F.min("_label").alias("_label"))
    sizes = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).orderBy("_label").limit(langid.MAX_LABELS + 1).collect()}
    if len(sizes) > langid.MAX_LABELS:
        raise ValueError(f"more than {langid.MAX_LABELS} domains")
    names = sorted(sizes)
    if not names:
        return documents.sparkSession.createDataFrame([], "_lower string, _class int, _order long, _held boolean"), names
    share = F.create_map(*(F.lit(x) for k in names for x in (k, min(1.0, per_domain / sizes[k]))))
    number = F.create_map(*(F.lit(x) for i, k in enumerate(names) for x in (k, i)))
    order = F.xxhash64("doc_id", F.lit(11))
    drawn = rows.filter(F.pmod(order, F.lit(1_000_000)) / 1_000_000.0 < share[F.col("_label")])
    drawn = common.stored(drawn.select("doc_id", number[F.col("_label")].alias("_class"), order.alias("_order")), "mx-drawn")
    docs = documents.filter("text IS NOT NULL").select("doc_id", F.lower("text").alias("_lower"))
    # at most about per_domain rows of each of at most MAX_LABELS domains
    sample = docs.join(F.broadcast(drawn), "doc_id")
    sample = sample.groupBy("doc_id", "_class", "_order").agg(F.min("_lower").alias("_lower"))
    return common.stored(sample.select("_lower", "_class", "_order", langid.held_part("_order").alias("_held")), "mx-sample"), names


def domain_posteriors(documents: DataFrame, model: langid.Model) -> DataFrame:
    """row (all columns of ``documents``), n_tokens (whole words) and posteriors (one per domain)."""
    given = documents.select(F.struct(*documents.columns).alias("row"), F.coalesce(F.lower("text"), F.lit("")).alias("lower"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lowered = batch.column("lower")
            n = np.diff(common.word_hashes(lowered, _TABLE)[1])
            p = [x.tolist() for x in langid.posteriors(model, lowered)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n), pa.array(p, pa.list_(pa.float64()))], ["row", "n_tokens", "posteriors"])

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))]
    return given.mapInArrow(predict, T.StructType([given.schema["row"], *added]))


def stepped(posterior: np.ndarray, budget: float, length: float, misfit: np.ndarray) -> np.ndarray:
    """Rates after a projected gradient step from ``budget``; a column for each column of ``misfit``."""
    return np.maximum(0.0, budget - length * (posterior @ misfit))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
    return n, batch.column("posteriors").flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)


def _packed(table: DataFrame) -> DataFrame:
    """Tokens and posteriors of a batch of documents in one row, so that a pass over them is a pass over few rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, p = _matrix(batch)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (n, p)], ["n", "p"])

    return table.select("n_tokens", "posteriors").mapInArrow(pack, "n binary, p binary")


def _summed(packed: DataFrame, size: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all documents of ``of`` (tokens, posteriors); the last number is a minimum."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.append(np.zeros(size - 1), np.inf)
        for batch in batches:
            for n, p in zip(batch.column("n"), batch.column("p"), strict=True):
                n = np.frombuffer(n.as_buffer())
                got = of(n, np.frombuffer(p.as_buffer()).reshape(len(n), -1))
                acc = np.append(acc[:-1] + got[:-1], min(acc[-1], got[-1]))
        yield pa.RecordBatch.from_arrays([pa.array([acc.tolist()], pa.list_(pa.float64()))], ["sums"])

    out = np.append(np.zeros(size - 1), np.inf)
    # a row for each task
    for r in packed.mapInArrow(partial, "sums array<double>").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("total"), F.min("x").alias("least")).collect():
        out[r["i"]] = r["total"] if r["i"] < size - 1 else r["least"]
    return out


class Trial(NamedTuple):
    """Sums at one guess of the misfit: the dual value, the tokens reached, the Gram matrix of documents of a rate."""

    misfit: np.ndarray
    value: float
    reached: np.ndarray
    gram: np.ndarray


def _trials(packed: DataFrame, guesses: np.ndarray, budget: float, length: float, goal: np.ndarray, total: float) -> tuple[list[Trial], float]:
    """A trial for each column of ``guesses`` (domains x guesses), and the least gradient at the first one."""
    k, t = guesses.shape

    def of(n: np.ndarray, p: np.ndarray) -> np.ndarray:
        rate = stepped(p, budget, length, guesses)
        weight = n[:, None] * rate
        gram = (n[:, None] * (rate > 0)).T @ (p[:, :, None] * p[:, None, :]).reshape(len(n), k * k)
        least = (p[n > 0] @ guesses[:, 0]).min(initial=np.inf)
        return np.concatenate([(weight * rate).sum(axis=0), (weight.T @ p).ravel(), gram.ravel(), [least]])

    sums = _summed(packed, t * (1 + k + k * k) + 1, of)
    square, reached, gram = sums[:t] / total, sums[t : t + t * k].reshape(t, k) / total, sums[t + t * k : -1].reshape(t, k, k) / total
    value = (guesses**2).sum(axis=0) / 2 + goal @ guesses + square / (2 * length)
    return [Trial(guesses[:, i], value[i], reached[i], gram[i]) for i in range(t)], sums[-1]


def fitted(table: DataFrame, names: list[str], targets: dict[str, float], budget: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(length, misfit, goal, reached): the step whose rates fit the expected domain totals of ``table`` (n_tokens,
    posteriors) to ``targets`` * ``budget``, and both totals as shares of all tokens.

    The bound that ends it: the squared misfit is convex, so other rates lessen it by at most the gradient times
    the difference. Better rates have at most ``most`` tokens, none of a gradient under the least one.
    """
    k = len(names)
    share = np.array([max(0.0, targets.get(x, 0.0)) for x in names])
    goal = share / share.sum() * budget if share.sum() else np.zeros(k)
    total = float(table.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0)
    if not k or not total:
        return 1.0, np.zeros(k), goal, np.zeros(k)
    packed = common.stored(_packed(table), "mx-packed")
    length, guess = 1.0, np.zeros((k, 1))
    while True:
        now = min(_trials(packed, guess, budget, length, goal, total)[0], key=lambda x: x.value)
        while True:
            slope = now.misfit + goal - now.reached
            if np.linalg.norm(slope) <= 1e-3 * np.linalg.norm(now.reached - goal) + 1e-12:
                break
            step = -np.linalg.solve(np.eye(k) + length * now.gram, slope)
            safe = -slope / (1.0 + length)  # lowers the dual value wherever the slope isn't 0
            guesses = np.stack([*(step * x for x in SHARES), safe, 8 * safe], axis=1)
            tried, _ = _trials(packed, now.misfit[:, None] + guesses, budget, length, goal, total)
            best = min(tried, key=lambda x: x.value)
            if best.value >= now.value:
                break  # nothing is gained in double precision any more
            now = best
        miss = now.reached - goal
        least = _trials(packed, miss[:, None], budget, length, goal, total)[1]
        most = goal.sum() + np.sqrt(k) * np.linalg.norm(miss)
        gain = miss @ now.reached + most * max(0.0, -least)
        if np.abs(miss).sum() <= TOLERANCE * budget or gain <= GAP * (miss @ miss) / 2:
            common.discard(packed)
            return length, now.misfit, goal, now.reached
        if length > 1e15:
            raise ArithmeticError(f"no rates fit: misfit {np.linalg.norm(miss)} after a step of length {length}")
        # with the misfit kept, or with the rates kept
        length, guess = length * GROWTH, np.stack([now.misfit, now.misfit / GROWTH], axis=1)


def mixture(documents: DataFrame, labels: DataFrame, domain: F.Column, targets: dict[str, float], budget: float = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(``documents`` with n_tokens, posteriors, domain (the likeliest) and rate (0 or more); the fit).

    The fit has a row for each domain: domain, target and reached share of all tokens, and misfit, their
    difference. ``labels`` has doc_id and what ``domain`` needs; rows with a null doc_id or domain are ignored
    and of several labels of one document the least counts. ``targets`` are relative token weights by domain
    name, 0 for names left out; ``budget`` is the wanted share of all tokens. A null text has no tokens; it gets
    a rate like any other. A very long text is one row of a task. Of equally likely domains the first by name is
    the likeliest. Without labels all rates are ``budget`` and the domain is null; an empty table gives no rows.
    Repeated rows are separate documents. Columns of the added names are replaced, others pass through whatever
    their names.
    """
    kept = [c for c in documents.columns if c not in ("n_tokens", "posteriors", "domain", "rate")]
    sample, names = labelled_sample(documents.select("doc_id", "text"), labels, domain)
    idf = langid.inverse_frequencies(documents.select(F.coalesce(F.lower("text"), F.lit("")).alias("_lower")))
    model = langid.fit(sample, names, idf, L1)
    common.discard(sample)
    table = common.stored(domain_posteriors(documents.select(*kept), model), "mx-posteriors")
    length, misfit, goal, reached = fitted(table, names, targets, budget)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, p = _matrix(batch) if names and batch.num_rows else (None, np.zeros((batch.num_rows, 0)))
            best = [names[i] for i in p.argmax(axis=1)] if names and batch.num_rows else [None] * batch.num_rows
            rates = stepped(p, budget, length, misfit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(rates)], [*batch.schema.names, "domain", "rate"])

    added = [T.StructField("domain", T.StringType()), T.StructField("rate", T.DoubleType())]
    rated = table.mapInArrow(rate, T.StructType([*table.schema.fields, *added]))
    fit = [(x, float(a), float(b), float(b - a)) for x, a, b in zip(names, goal, reached, strict=True)]
    report = documents.sparkSession.createDataFrame(fit, "domain string, target double, reached double, misfit double")
    return rated.select(*(F.col("row").getField(c).alias(c) for c in kept), "n_tokens", "posteriors", "domain", "rate"), report


def mixed(documents: DataFrame, labels: DataFrame, domain: F.Column, targets: dict[str, float], budget: float = BUDGET) -> DataFrame:
    """The documents of ``mixture``."""
    return mixture(documents, labels, domain, targets, budget)[0]
