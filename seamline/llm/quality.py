"""Quality: a weak-label model and a hashed linear scorer.

1. Heuristic labellers vote good, bad or nothing on every whole document.
2. Vote patterns are counted over all documents (at most 3^labellers patterns reach the
   driver) and expectation-maximisation estimates each labeller's accuracy by class,
   without any gold label.
3. Posterior labels of a bounded, documented sample train a logistic scorer over hashed
   shape n-grams (letters, capitals, digits and other bytes folded to classes).
4. The scorer reads every document; those that it holds likelier bad than good are rejected.

Cases.  Null texts, and those of white space alone, have nothing to keep: they get the
score 0 and are rejected, and neither vote nor train.  Very long texts are read whole.
Repeated rows repeat their result; a null doc_id stays null.  Extra columns are ignored.
An empty table gives an empty result (and a scorer that knows only its prior).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROWS = 6_000
MAX_BYTES = 32_768
BITS = 13
ORDERS = (2, 3, 4)

#: Frequent function words of English, German, French and Spanish: fixed values.
STOP_WORDS = frozenset(
    b"the of and to in is was for that with on are as by it be this an at from or a "
    b"der die das und in den von zu mit ist des auf ein eine nicht dem im sich auch "
    b"le la les de des et en un une du que est dans pour sur par qui au avec "
    b"el los las y del se por con una su para es al lo como".split()
)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
# classes: 0 white space, 1 lower-case or beyond ASCII, 2 capitals, 3 digits, 4 sentence marks, 5 other signs
_CLASS = np.array(
    [
        0 if b in b" \t\n\r\x0b\x0c" else 2 if 0x41 <= b <= 0x5A else 1 if b >= 0x80 or 0x61 <= b <= 0x7A else 3 if 0x30 <= b <= 0x39 else 4 if b in b".,;:?'\"-()" else 5
        for b in range(256)
    ],
    np.uint8,
)
#: Bytes to shapes: runs of letters keep their case, digits fold, signs stay themselves.
_SHAPE = np.array([0x61 if c == 1 else 0x41 if c == 2 else 0x30 if c == 3 else 0x20 if c == 0 else b for b, c in enumerate(_CLASS)], np.uint32)

#: Labellers; those that ``False`` marks only ever object, so their silence counts as evidence.
TWO_SIDED = {"signs": False, "capitals": False, "sign_endings": False, "pipes": False, "repetition": False, "vocabulary": False, "function_words": True, "sentences": True}
LABELLERS = tuple(TWO_SIDED)


def _graded(value: float, bad: float, good: float) -> int:
    """-1: bad, 1: good, 0: no vote."""
    return -1 if value >= bad else 1 if value <= good else 0


def repetition(words: list[bytes]) -> float:
    """Share of three-word runs that occurred before in the document."""
    return 1 - len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2) if len(words) > 2 else 0.0


def votes(body: bytes) -> list[int]:
    """A vote of each labeller on a whole text."""
    words = body.split()
    if not words:
        return [0] * len(LABELLERS)
    n = np.bincount(_CLASS[np.frombuffer(body, np.uint8)], minlength=6)
    black, letters, count = max(1, int(n[1:].sum())), max(1, int(n[1] + n[2])), len(words)
    repeated = repetition(words)
    stops = sum(w.strip(b".,;:") in STOP_WORDS for w in body.translate(_LOWER).split()) / count
    endings = sum(len(w) > 2 and w[-1] in b"*%&$#!@^~" and w[-2] in b"*%&$#!@^~" for w in words) / count
    ends = sum(w[-1] in b".!?" for w in words) / count
    return [
        -int(n[5] / black >= 0.10),
        -int(letters > 20 and n[2] / letters >= 0.5),
        -int(endings >= 0.3),
        -int(words.count(b"|") / count >= 0.15),
        -int(count >= 20 and repeated >= 0.4),
        -int(count >= 20 and len(set(words)) / count ** 0.8 <= 0.5),
        -_graded(stops, 0.08, 0.01) if count >= 30 else 0,
        (1 if 0.01 <= ends <= 0.4 else -1) if count >= 60 else 0,
    ]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior P(good) of each pattern; P(vote | class) by labeller; prior P(good).

    ``patterns`` holds votes (-1, 0, 1) by row, ``counts`` how many documents have them.
    """
    votes_, counts = np.asarray(patterns, int).reshape(len(counts), len(LABELLERS)) + 1, np.asarray(counts, float)
    if not len(counts):
        return np.zeros(0), np.zeros((2, 0, 3)), 0.5
    # labellers are built to be precise where they object: one objection starts a pattern as bad
    posterior = np.where((votes_ == 0).any(1), 0.1, 0.9)
    likelihood, prior = None, 0.5
    for _ in range(rounds):
        by_class = np.stack([counts * (1 - posterior), counts * posterior])
        prior = float((by_class[1].sum() + 1) / (counts.sum() + 2))
        likelihood = np.stack([[[by_class[k][votes_[:, j] == v].sum() + 1.0 for v in range(3)] for j in range(votes_.shape[1])] for k in (0, 1)])
        likelihood /= likelihood.sum(2, keepdims=True)
        for j, both in enumerate(TWO_SIDED.values()):
            if both:  # too short a text to judge says nothing: only votes that were given count
                likelihood[:, j, 1] = 0
                likelihood[:, j] /= likelihood[:, j].sum(1, keepdims=True)
                likelihood[:, j, 1] = 1
        logs = [np.log(p) + sum(np.log(likelihood[k][j][votes_[:, j]]) for j in range(votes_.shape[1])) for k, p in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior, likelihood, prior


def features(body: bytes, orders=ORDERS, bits: int = BITS) -> np.ndarray:
    """Square-rooted shares of hashed shape n-grams, and the repetition tenth; or zeros."""
    x = _SHAPE[np.frombuffer(body, np.uint8)]
    total = np.zeros(1 << bits, np.float32)
    rolling = x
    for order in range(2, max(orders) + 1):
        if len(x) < order:
            break
        rolling = rolling[:-1] * np.uint32(0x01000193) + x[order - 1 :]
        if order in orders:
            h = (rolling ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            total += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits), minlength=1 << bits)
    n = total.sum()
    if not n:
        return total
    total = np.sqrt(total / n)
    words = body.split()
    if len(words) >= 30:  # how much repeats, as one more hashed feature per tenth
        h = (0x72657031 + int(10 * repetition(words))) * 0x9E3779B1 & 0xFFFFFFFF
        total[h >> (32 - bits)] += 1.0
    return total


def fit(texts: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, bits: int = BITS, ridge: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression of soft targets on features (places, values) of texts: weights and bias."""
    targets = np.asarray(targets, np.float64)
    if not len(targets):
        return np.zeros(1 << bits, np.float32), 0.0
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c, _ in texts])
    cols, values = np.concatenate([c for c, _ in texts]), np.concatenate([x for _, x in texts])
    w, bias = np.zeros(1 << bits), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(rows, values * w[cols], len(targets)) + bias
        error = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - targets
        grad = np.bincount(cols, values * error[rows], len(w)) / len(targets) + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * error.mean(), 0.999 * vb + 0.001 * error.mean() ** 2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= 0.1 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return w.astype(np.float32), float(bias)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("body"))


def _patterns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vote patterns of a partition with their counts: pre-aggregated before the shuffle."""
    counted: dict[tuple, int] = {}
    for batch in batches:
        for body in batch.column(0):
            data = body.as_py()
            if data.strip():
                key = tuple(votes(data))
                counted[key] = counted.get(key, 0) + 1
    if counted:
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in counted], pa.list_(pa.int32())), pa.array(list(counted.values()), pa.int64())], names=["votes", "n"])


class Model:
    """The weak-label model's estimates and the scorer trained on its posteriors."""

    def __init__(self, likelihood, prior: float, weights: np.ndarray, bias: float):
        self.likelihood, self.prior, self.weights, self.bias = likelihood, prior, weights, bias

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """P(objects | bad) and P(does not object | good), by labeller; none without documents."""
        if self.likelihood is None or not self.likelihood.size:
            return {}
        return {name: (float(self.likelihood[0][j][0]), 1 - float(self.likelihood[1][j][0])) for j, name in enumerate(LABELLERS)}


def _training(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, body) to doc_id, votes and sparse features of the texts that have words."""
    for batch in batches:
        ids, voted, places, values = [], [], [], []
        for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = body.as_py()
            if data.strip():
                x = features(data)
                (held,) = np.nonzero(x)
                ids.append(doc_id)
                voted.append(votes(data))
                places.append(held.astype(np.int32))
                values.append(x[held])
        columns = [pa.array(ids, pa.int64()), pa.array(voted, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "votes", "places", "values"])


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    flat = column.combine_chunks()
    return np.split(flat.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(flat).to_numpy())[:-1])


def train(docs: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Estimate labellers over all documents; fit the scorer on at most ``max_rows`` of them.

    The sample is the ``max_rows`` rows with the smallest hash of doc_id, of at most
    ``max_bytes`` bytes each.  Their texts stay with the executors; a text's features are
    at most 2^BITS pairs of 8 bytes, so a full sample takes the driver 400 MB at the very
    most (on the test tables 14 KB a text, 80 MB).
    """
    common.prepare(docs.sparkSession)
    source = _source(docs)
    counted = source.select("body").mapInArrow(_patterns, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).toArrow()
    patterns, counts = counted.column("votes").to_pylist(), counted.column("n").to_pylist()
    posterior, likelihood, prior = estimate(np.array(patterns), np.array(counts))
    by_pattern = dict(zip(map(tuple, patterns), posterior))
    ids = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    last = ids.orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    rows = source.where((F.xxhash64("doc_id") <= F.lit(last if last is not None else 0)) & (F.octet_length("body") <= max_bytes))
    # few rows: dealt anew, as the limit leaves them in one partition
    rows = rows.orderBy(F.xxhash64("doc_id")).limit(max_rows).repartition(32).mapInArrow(_training, "doc_id long, votes array<int>, places array<int>, values array<float>").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return Model(likelihood, prior, *fit([], np.zeros(0)))
    targets = [by_pattern.get(tuple(v), prior) for v in rows.column("votes").to_pylist()]
    return Model(likelihood, prior, *fit(list(zip(_lists(rows.column("places")), _lists(rows.column("values")))), np.array(targets)))


def _scores(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            scores = []
            for body in batch.column(1):
                data = body.as_py()
                z = float(features(data) @ weights) + bias if data.strip() else -500.0
                scores.append(1 / (1 + float(np.exp(-np.clip(z, -500, 500)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, score = P(good), from whole texts."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))
    return _source(docs).mapInArrow(_scores(shared), "doc_id long, score double")


def keep_good(docs: DataFrame, threshold: float = 0.5, **bounds) -> DataFrame:
    """The rows of ``docs`` that the scorer holds good, with all their columns, in one pass.

    Rows are scored where they are read (``mapInArrow`` over all columns), so filtering
    needs no join and repeated or null identifiers cannot mix rows up.
    """
    spark = docs.sparkSession
    model = train(docs, **bounds)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))

    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            good = []
            for text in batch.column(at):
                data = (text.as_py() or "").encode("utf-8", "replace")
                good.append(bool(data.strip()) and float(features(data) @ weights) + bias >= np.log(threshold / (1 - threshold)))
            yield batch.filter(pa.array(good, pa.bool_()))

    # by place: mapInArrow takes no names with dots
    placed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return placed.mapInArrow(run, placed.schema).toDF(*docs.columns)
