"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Every learnable document counts towards the document frequencies. The classifier is fitted on a bounded
sample (about PER_LABEL documents of each label) by follow-the-regularised-leader with elastic-net
penalties: shards of the sample are trained in parallel and their weights averaged. A further sample of
the same bound sets the softmax temperature. Prediction is one map over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroom.llm import common

DIM_BITS = 15
DIM = 1 << DIM_BITS
MAX_N = 3
PER_LABEL = 1500
MAX_LABELS = 200
SHARDS = 4
EPOCHS = 3
#: L1 leaves about a third of the weights of seen n-grams; held-out accuracy is that of a tenth or of all of them.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.3, 1e-6
UNDETERMINED = "und"


def _buckets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each lower-cased text the hash buckets of its character 1- to 3-grams, repeats included.

    ASCII characters that are no letters count as one blank each; runs of blanks are left as they are.
    """
    raw, rows = common.utf8(texts)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b == a:
            yield np.zeros(0, np.int64)
            continue
        chars = np.frombuffer(raw[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        ascii_other = (chars < 128) & ~((chars >= 97) & (chars <= 122))
        c = np.where(ascii_other, np.uint32(32), chars).astype(np.uint64)
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
        c = c[keep]
        parts, acc = [], np.zeros(len(c), np.uint64)
        for n in range(1, MAX_N + 1):
            if len(c) < n:
                break
            acc = acc[: len(c) - n + 1] * common._P + c[n - 1 :]
            parts.append((common.mix64(acc + np.uint64(n)) >> np.uint64(64 - DIM_BITS)).astype(np.int64))
        yield np.concatenate(parts)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's document frequencies; bucket -1 has its number of rows."""
    df, rows = np.zeros(DIM, np.int64), 0
    for batch in batches:
        rows += batch.num_rows
        for b in _buckets(batch.column("_lower")):
            df += np.bincount(b, minlength=DIM) > 0
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], rows))], ["bucket", "df"])


def _features(texts: pa.Array, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sparse unit vectors (indexes, values) of 1 + log tf, times idf."""
    for b in _buckets(texts):
        counts = np.bincount(b, minlength=DIM)
        at = np.flatnonzero(counts)
        x = (1.0 + np.log(counts[at])) * idf[at]
        yield at, x / (np.linalg.norm(x) or 1.0)


def _softmax(logits: np.ndarray) -> np.ndarray:
    if not logits.size:
        return logits
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, l1: float = L1) -> np.ndarray:
    """Weights (classes x DIM) after EPOCHS passes of FTRL-proximal with L1 and L2 penalties."""
    z, n = np.zeros((classes, DIM)), np.zeros((classes, DIM))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for e in rng.permutation(len(examples)):
            at, x = examples[e]
            zi, ni = z[:, at], n[:, at]
            w = weights(zi, ni)
            p = _softmax(w @ x)
            p[labels[e]] -= 1.0
            g = p[:, None] * x
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[:, at] = zi + g - s * w
            n[:, at] = ni + g * g
    return weights(z, n)


def _train(table: pa.Table, idf: np.ndarray, classes: int, l1: float) -> pa.Table:
    table = table.sort_by("_order")
    examples = list(_features(table.column("_lower"), idf))
    w = ftrl(examples, np.asarray(table.column("_class").combine_chunks()), classes, l1)
    k, at = np.nonzero(w)
    return pa.table({"class": k.astype(np.int32), "bucket": at.astype(np.int32), "w": w[k, at]})


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    lo, hi, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model(NamedTuple):
    """A fitted classifier; its size depends on DIM and the number of labels alone."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def inverse_frequencies(lowered: DataFrame) -> np.ndarray:
    """Smoothed idf of each bucket over all rows of the column ``_lower``."""
    df, total = np.zeros(DIM), 0
    for r in lowered.mapInArrow(_document_frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        if r["bucket"] < 0:
            total = r["df"]
        else:
            df[r["bucket"]] = r["df"]
    return np.log((1.0 + total) / (1.0 + df)) + 1.0


def fit(sample: DataFrame, labels: list[str], idf: np.ndarray, l1: float = L1) -> Model:
    """Fit on a bounded sample with columns _lower, _class (place in ``labels``), _order and _held.

    Rows with _held set the temperature; the others train, in SHARDS groups whose weights are averaged.
    """
    if not labels:
        return Model([], idf, np.zeros((DIM, 0), np.float32), 1.0)
    classes = len(labels)
    shards = sample.filter("NOT _held").withColumn("_shard", F.pmod(F.xxhash64("_order", F.lit(3)), F.lit(SHARDS)))
    fitted = shards.groupBy("_shard").applyInArrow(lambda key, tb: _train(tb, idf, classes, l1), "class int, bucket int, w double")
    weights = np.zeros((DIM, classes))
    for r in fitted.groupBy("class", "bucket").agg((F.sum("w") / SHARDS).alias("w")).collect():
        weights[r["bucket"], r["class"]] = r["w"]

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [(x @ weights[at]).tolist() for at, x in _features(batch.column("_lower"), idf)]
            yield pa.RecordBatch.from_arrays([batch.column("_class"), pa.array(z, pa.list_(pa.float64()))], ["_class", "z"])

    held = sample.filter("_held").select("_lower", "_class").mapInArrow(logits, "_class int, z array<double>").collect()
    t = temperature(np.array([r["z"] for r in held]).reshape(-1, classes), np.array([r["_class"] for r in held], int))
    return Model(labels, idf, weights.astype(np.float32), t)


def posteriors(model: Model, lowered: pa.Array) -> Iterator[np.ndarray]:
    """Calibrated class probabilities of each lower-cased text."""
    for at, x in _features(lowered, model.idf):
        yield _softmax((x.astype(np.float32) @ model.weights[at]).astype(np.float64) / model.temperature)


def held_part(order: str) -> F.Column:
    """One row in five, chosen by hash."""
    return F.pmod(F.xxhash64(order), F.lit(5)) == 0


def identify(documents: DataFrame, learn: F.Column, label: str = "lang") -> DataFrame:
    """``documents`` with lang_pred (a learnt label or ``und``) and score (calibrated, 0 to 1).

    Learns from the rows where ``learn`` holds and ``label`` is not null; a prediction depends on the
    text alone. A null text or one without a letter is ``und`` with score 0, as is every text when
    nothing could be learnt. Columns named lang_pred or score are replaced; all other columns, whatever their
    names, repeated rows and null ids pass through. Of two equally likely labels the first by name wins. A very
    long text is one row of a task; an empty table gives no rows. More than MAX_LABELS labels are refused.
    """
    kept = [c for c in documents.columns if c not in ("lang_pred", "score")]
    text = F.col("text").cast("string")
    learnable = documents.filter(F.coalesce(learn, F.lit(False)) & F.col(label).isNotNull() & text.isNotNull())
    learnable = learnable.select(F.lower(text).alias("_lower"), F.col(label).cast("string").alias("_label"), F.xxhash64(text, F.lit(11)).alias("_order"))
    sizes = {r["_label"]: r["n"] for r in learnable.groupBy("_label").agg(F.count("*").alias("n")).orderBy("_label").limit(MAX_LABELS + 1).collect()}
    if len(sizes) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    labels = sorted(sizes)
    if labels:
        share = F.create_map(*(F.lit(x) for k in labels for x in (k, min(1.0, PER_LABEL / sizes[k]))))
        number = F.create_map(*(F.lit(x) for i, k in enumerate(labels) for x in (k, i)))
        draw = F.pmod(F.col("_order"), F.lit(1_000_000)) / 1_000_000.0
        sample = learnable.filter(draw < share[F.col("_label")])
        sample = sample.select("_lower", number[F.col("_label")].alias("_class"), "_order", held_part("_order").alias("_held"))
        sample = common.stored(sample, "li-sample")
        model = fit(sample, labels, inverse_frequencies(learnable.select("_lower")))
        common.discard(sample)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column("letter").to_pylist()
            if labels:
                found = [p if ok else None for ok, p in zip(letters, posteriors(model, batch.column("lower")), strict=True)]
            else:
                found = [None] * batch.num_rows
            names = [UNDETERMINED if p is None else labels[int(p.argmax())] for p in found]
            scores = [0.0 if p is None else float(p.max()) for p in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"]
            )

    # the caller's columns travel as one, so that names can't clash
    given = documents.select(F.struct(*kept).alias("row"), F.lower(text).alias("lower"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("letter"))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    out = given.mapInArrow(predict, T.StructType([given.schema["row"], *added]))
    return out.select(*(F.col("row").getField(c).alias(c) for c in kept), "lang_pred", "score")
