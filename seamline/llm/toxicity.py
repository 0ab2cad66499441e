"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the presence of hashed byte n-grams of the whole lower-cased text (runs of
ASCII separators become one blank, so n-grams see word ends).  Each present feature has
the value of its log-count ratio r = log((a + n_toxic) / |.|) - log((a + n_clean) / |.|);
features whose ratio the sample doesn't support (a likelihood-ratio screen) have value 0.
A logistic regression over these values gives the score.

The fit uses at most ``max_rows`` labelled rows, taken by a hash of doc_id, of at most
``max_bytes`` bytes each (a documented bound of the fit alone).  Executors read them: what
reaches the driver is the number of texts of each class that hold a hashed n-gram (2^18
rows at most) and, of every text, the places of the n-grams that the screen left (at most
``MAX_FEATURES``: 16 KB a text, 160 MB for a full sample; some hundreds of bytes a text on
the test tables).  The model, a vector of 2^18 floats, is of fixed size.  Scoring streams
over every document, whole, without a shuffle.

Cases.  Null and empty texts have no features and get the score of the bias.  Documents
without a label are scored like others; rows with a null label, or with both labels, are
left out of the fit.  Without a labelled row of both classes the score is the smoothed
share of toxic rows.  Repeated rows repeat their score; a null doc_id stays null and is
never a training row.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDERS = (3, 4, 5, 6)
BITS = 18
MAX_ROWS = 10_000
MAX_BYTES = 32_768
#: Features that a model may have: those with the highest statistic.
MAX_FEATURES = 4_096
#: Likelihood-ratio statistic that a feature needs (chi-square, one degree: p of about 1e-4).
SCREEN = 15.0

_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)


def features(body: bytes, orders=ORDERS, bits: int = BITS) -> np.ndarray:
    """Hashed n-grams of a text, with repeats."""
    x = _FOLD[np.frombuffer(b" " + body + b" ", np.uint8)]
    blank = x == 0x20
    x = x[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint32)
    found, rolling, n = [], x, 1
    for order in range(2, max(orders) + 1):
        if len(x) < order:
            break
        rolling = rolling[:-1] * np.uint32(0x01000193) + x[order - 1 :]
        if order in orders:
            h = (rolling ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            found.append((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


class Model:
    """Weights by hashed n-gram, and a bias."""

    def __init__(self, weights: np.ndarray, bias: float, orders=ORDERS, bits: int = BITS):
        self.weights, self.bias, self.orders, self.bits = weights, bias, tuple(orders), bits

    def score(self, body: bytes) -> float:
        x = features(body, self.orders, self.bits)
        total = self.bias
        if len(x):
            w = self.weights[x]
            (hit,) = np.nonzero(w)  # only weighted features need their repeats removed
            if len(hit):
                total += float(self.weights[np.unique(x[hit])].sum())
        return 1.0 / (1.0 + float(np.exp(-np.clip(total, -500, 500))))


def presence(bodies: Iterable[bytes], labels: Iterable[int], orders=ORDERS, bits: int = BITS) -> np.ndarray:
    """Number of texts of each class (clean, toxic) that hold a hashed n-gram."""
    count = np.zeros((2, 1 << bits), np.int64)
    for body, label in zip(bodies, labels):
        count[int(label), np.unique(features(body, orders, bits))] += 1
    return count


def screened(count: np.ndarray, clean: float, toxic: float, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Features that the sample supports, and the log-count ratios of all."""
    p, q = alpha + count[1], alpha + count[0]
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    # likelihood ratio of presence against the label, from the two-by-two table
    statistic, present, size = np.zeros(count.shape[1]), count.sum(0), clean + toxic
    for row, held in ((1, toxic), (0, clean)):
        for cell, marginal in ((count[row], present), (held - count[row], size - present)):
            expected = np.maximum(marginal * held / size, 1e-12)
            statistic += 2 * cell * np.log(np.maximum(cell, 1e-12) / expected)
    kept = np.flatnonzero(statistic >= SCREEN)
    best = kept[np.argsort(-statistic[kept], kind="stable")[:MAX_FEATURES]]
    return np.sort(best), ratio


def places(body: bytes, place: np.ndarray, orders=ORDERS, bits: int = BITS) -> np.ndarray:
    """The kept features of a text, by their place among them."""
    found = place[features(body, orders, bits)]
    return np.unique(found[found >= 0])


def regress(kept: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression over present features, each worth its ratio."""
    size, toxic = len(labels), float(labels.sum())
    prior = (toxic + 1.0) / (size + 2.0)
    rows = np.repeat(np.arange(size), [len(c) for c in kept])
    cols = np.concatenate(kept)
    value = ratio[cols]
    w, bias = np.zeros(len(ratio)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam over the whole sample: no order of rows to depend on
        z = np.bincount(rows, value * w[cols], size) + bias
        error = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - labels
        grad = np.bincount(cols, value * error[rows], len(ratio)) / size + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * error.mean(), 0.999 * vb + 0.001 * error.mean() ** 2
        rate = 0.05 / (1 + step / 200)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return ratio * w, bias


def prior_model(clean: int, toxic: int) -> Model:
    """What is known without both classes, or without any supported feature."""
    prior = (toxic + 1.0) / (clean + toxic + 2.0)
    return Model(np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int) -> DataFrame:
    """At most ``max_rows`` documents with a label, by a hash of doc_id: body, label."""
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    one = clean.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows small rows: a proven bound
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("body"))
    return source.join(F.broadcast(picked), "doc_id").where(F.octet_length("body") <= max_bytes).select("doc_id", "body", "label")


def _presence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body, label) to the counts of a partition: feature, clean, toxic."""
    count = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        count += presence((b.as_py() for b in batch.column(0)), batch.column(1).to_pylist())
    held = np.flatnonzero(count.sum(0))
    for a in range(0, len(held), 65_536):
        part = held[a : a + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(count[0, part]), pa.array(count[1, part])], names=["feature", "clean", "toxic"])


def _places(shared):
    """(doc_id, body, label) to doc_id, label and the text's kept features."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([places(b.as_py(), shared.value).astype(np.int32) for b in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), found], names=["doc_id", "label", "kept"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on labelled documents; texts stay with the executors."""
    spark = docs.sparkSession
    common.prepare(spark)
    rows = common.materialise(training_rows(docs, labels, label, max_rows, max_bytes), "toxic-training")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return prior_model(clean, toxic)
    counted = rows.select("body", "label").mapInArrow(_presence, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    count = np.zeros((2, 1 << BITS))
    count[:, counted.column("feature").to_numpy()] = counted.column("clean").to_numpy(), counted.column("toxic").to_numpy()
    kept, ratio = screened(count, clean, toxic)
    if not len(kept):
        return prior_model(clean, toxic)
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    shared = spark.sparkContext.broadcast(place)
    held = rows.select("doc_id", "body", "label").mapInArrow(_places(shared), "doc_id long, label int, kept array<int>").toArrow().sort_by("doc_id")
    lists = held.column("kept").combine_chunks()
    texts = np.split(lists.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(lists).to_numpy())[:-1])
    fitted, bias = regress(texts, held.column("label").to_numpy().astype(np.float64), ratio[kept])
    weights = np.zeros(1 << BITS, np.float32)
    weights[kept] = fitted
    return Model(weights, bias)


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _scores(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(b.as_py()) for b in batch.column(1)], pa.float64())], schema=_OUT)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, score (0 to 1; higher: toxic likelier)."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.orders, model.bits))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("body"))
    return source.mapInArrow(_scores(shared), "doc_id long, score double")
