"""Near duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles (words lower-cased, ASCII punctuation dropped).
Order MinHash labels every shingle with its occurrence number and, for each of ``BANDS``
samples, keeps the ``ELL`` labelled shingles with the smallest hashes in the order of the
text; texts that agree in a sample are candidates.  Agreement needs common shingles in the
same order, which follows edit similarity.  A candidate pair is verified by aligning the
two shingle sequences within a diagonal band wide enough for every alignment that reaches
the threshold: similarity = aligned / (shingles of both - aligned), at least 0.8.

Scale.  Equal texts collapse to one node first.  A bucket of agreeing nodes isn't expanded
into pairs: its members are aligned with the bucket's hub, the node that shares most
buckets with others (the likely original of its copies).  Links become classes by iterated
joins, never on the driver.  Where members of a bucket are then in several classes, an
exact search finds every pair across classes that may still be near.  Shingles that no other
class has bound what a text can share, and drop most texts.  The rest are joined on prefixes:
two texts near enough share one of their rarest shingles, so many of them as the threshold
and both lengths leave open.  Around each shingle only texts outside of its commonest class
meet the others, so a large class never meets itself.

Cases.  Null text counts as empty.  Texts of fewer than five words are one shingle; texts
without words are near only to equal texts.  Very long texts are read whole.  Repeated rows
are copies of one node.  Null identifiers sort last: a class of only null identifiers has a
null class_id.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
BANDS, ELL = 16, 4
LEAST = 0.8
#: Lengths of texts are told apart in steps of this ratio, for the prefixes that they need.
STEP = 1.05

_TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(body: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's word shingles, in order."""
    x = np.frombuffer(b" " + body.translate(_TO_WORDS) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff((x != 0x20).view(np.int8)))
    if not len(edge):
        return np.zeros(0, np.uint64)
    start, stop = edge[::2] + 1, edge[1::2] + 1
    power, inverse = _powers(len(x))
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)))
    word = mixed((upto[stop] - upto[start]) * inverse[start])
    n = max(1, len(word) - words + 1)
    found = np.zeros(n, np.uint64)
    for k in range(min(words, len(word))):
        found = found * np.uint64(0x9FB21C651E98DF25) + word[k : k + n]
    return mixed(found)


_SALTS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def order_minhash(found: np.ndarray, bands: int = BANDS, ell: int = ELL) -> np.ndarray:
    """One key for each sample: its smallest occurrence-labelled shingles, in text order."""
    n = len(found)
    if not n:
        return np.zeros(0, np.int64)
    held = labelled(found)
    keys = np.zeros(bands, np.uint64)
    take = min(ell, n)
    step = max(1, (1 << 20) // n)  # keeps the matrix of very long texts small
    for a in range(0, bands, step):
        h = held[None, :] * _SALTS[a : min(bands, a + step), None]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        least = np.argpartition(h, take - 1, axis=1)[:, :take] if take < n else np.broadcast_to(np.arange(n), h.shape)
        picked = held[np.sort(least, axis=1)]
        for k in range(take):
            keys[a : a + len(picked)] = mixed(keys[a : a + len(picked)] * np.uint64(0x9FB21C651E98DF25) + picked[:, k])
    return keys.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Aligned share of two shingle sequences, exact if at least ``least``, else 0.

    A longest common subsequence by bit-parallel dynamic programming, restricted to the
    diagonals that an alignment reaching ``least`` can visit.
    """
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    needed = int(np.ceil(least * total / (1 + least) - 1e-9))
    if min(len(a), len(b)) < needed:
        return 0.0
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    x, y = a[head:], b[head:]
    n = min(len(x), len(y))
    tail = 0
    if n:
        same = x[len(x) - n :][::-1] == y[len(y) - n :][::-1]
        tail = n if same.all() else int(same.argmin())
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    done = head + tail
    if len(x) and len(y):
        if done + min(len(x), len(y)) < needed:
            return 0.0
        common_ = np.intersect1d(x, y)
        if not len(common_):
            return done / (total - done) if done >= needed else 0.0
        if done + min(int(np.isin(x, common_).sum()), int(np.isin(y, common_).sum())) < needed:
            return 0.0
        masks: dict[int, int] = {}
        for i, s in enumerate(x.tolist()):
            masks[s] = masks.get(s, 0) | (1 << i)
        band = total - 2 * needed  # unaligned shingles allowed: the farthest diagonal
        full, window = (1 << len(x)) - 1, (1 << (2 * band + 1)) - 1
        v = full
        for j, s in enumerate(y.tolist()):
            m = masks.get(s)
            if m is None:
                continue
            low = j - band
            m &= window << low if low >= 0 else window >> -low
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        done += len(x) - v.bit_count()
    return done / (total - done) if done >= needed else 0.0


_SIGNED = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [order_minhash(shingles(b.as_py())) for b in batch.column(2)]
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], schema=_SIGNED)


def labelled(found: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence numbers hashed in: a text's multiset as a set."""
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(found)), 0))
    occurrence = np.empty(len(found), np.uint64)
    occurrence[order] = (np.arange(len(found)) - first).astype(np.uint64)
    return mixed(found + occurrence * np.uint64(0xA0761D6478BD642F))


def _list(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, body) to (node, labelled shingles)."""
    for batch in batches:
        found = [labelled(x) if len(x := shingles(b.as_py())) else x for b in batch.column(1)]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        values = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["node", "shingles"])


def _verify(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(node: int, body: pa.BinaryScalar) -> np.ndarray:
            if node not in known:
                if len(known) > 256:
                    known.clear()
                known[node] = shingles(body.as_py())
            return known[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [similarity(of(i, x), of(j, y), least) for i, j, x, y in zip(a, b, batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each node's component of ``edges`` (a, b).

    Rounds of minimum labels over edges with pointer jumping, each written to the shared
    folder, until no label changes.
    """
    both = common.materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = common.materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "near-labels")
    while True:
        heard = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("comp").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp"))
        lower = common.materialise(lower, "near-labels")
        if lower.where("comp != old").isEmpty():
            return labels
        jump = lower.select("node", "comp").join(lower.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp")
        labels = common.materialise(jump.select("node", F.least("comp", "root").alias("comp")), "near-labels")


class NearDuplicates:
    """Nodes (different texts), verified links and classes of a table of documents."""

    def __init__(self, docs: DataFrame, least: float = LEAST):
        self.spark, self.least = docs.sparkSession, least
        common.prepare(self.spark)
        self.source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("body")).withColumn("key", F.unhex(F.sha2("body", 256)))
        signed = self.source.select("doc_id", "key", "body").mapInArrow(_sign, "doc_id long, key binary, bands array<long>")
        self.signed = common.materialise(signed, "near-signed")
        nodes = self.signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
        self.nodes = common.materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
        self.comps: DataFrame | None = None  # of the links, where already known
        self.links = self._link()

    def _buckets(self) -> DataFrame:
        """(bucket, node, score) of the buckets with several nodes."""
        posted = self.nodes.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket"))
        # written before it is joined, so that adaptive execution can split a bucket with many members
        shared = common.materialise(posted.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "near-shared")
        members = common.materialise(posted.join(shared, "bucket"), "near-posted")
        score = members.groupBy("node").agg(F.sum("n").alias("score"))
        return common.materialise(members.select("bucket", "node").join(score, "node"), "near-buckets")

    def _aligned(self, pairs: DataFrame, bodies: DataFrame) -> DataFrame:
        """Similarities of the pairs (a, b), a < b; 0 below the threshold."""
        left, right = bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), bodies.select(F.col("node").alias("b"), F.col("body").alias("y"))
        both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y")
        return common.materialise(both.mapInArrow(_verify(self.least), "a long, b long, similarity double"), "near-aligned")

    def _bodies(self, members: DataFrame) -> DataFrame:
        """(node, body) of the nodes that have candidates."""
        wanted = members.select("node").distinct().join(self.nodes.select("node", "doc_id", "key"), "node")
        s, w = self.source.alias("s"), wanted.alias("w").hint("merge")
        found = s.join(w, (F.col("s.key") == F.col("w.key")) & F.col("s.doc_id").eqNullSafe(F.col("w.doc_id"))).select("w.node", "s.body").dropDuplicates(["node"])
        return common.materialise(found, "near-bodies")

    def _link(self) -> DataFrame:
        """Verified links (a, b, similarity) between nodes."""
        members = self._buckets()
        bodies = self._bodies(members)
        hubs = members.groupBy("bucket").agg(F.max(F.struct("score", (-F.col("node")).alias("m"))).alias("hub"))
        hubs = common.materialise(hubs.select("bucket", (-F.col("hub.m")).alias("hub")), "near-hubs")
        met = common.materialise(members.select("bucket", "node").join(hubs, "bucket").where("node != hub"), "near-met")
        pairs = met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        tested = self._aligned(pairs, bodies)
        links = tested.where("similarity > 0")
        self.comps = components(links)
        pairs = self._feasible(self._mates(met), bodies).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        new = self._aligned(pairs, bodies).where("similarity > 0")
        if not new.isEmpty():
            links, self.comps = links.unionByName(new), None
        return links

    def _mates(self, met: DataFrame) -> DataFrame:
        """(node, comp) of the nodes that share a bucket, besides its hub, with another class."""
        placed = met.select("bucket", "node").join(self.comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        placed = common.materialise(placed, "near-placed")
        several = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("bucket")
        several = common.materialise(several, "near-several")
        return common.materialise(placed.join(several, "bucket", "left_semi").select("node", "comp").distinct(), "near-mates")

    def _feasible(self, mates: DataFrame, bodies: DataFrame) -> DataFrame:
        """Every pair (a, b) of ``mates`` (node, comp) in different classes that may be near.

        With c common shingles (labelled, so that repeats count), similarity is at most
        c / (n_a + n_b - c); so c is at least ``needed``.  A pair's common shingles are
        among those that another class has; in the order of their number of texts, the
        first common one stands among the first (shared - needed + 1) of either text.
        """
        share = self.least / (1 + self.least)
        step = math.log(STEP)
        listed = bodies.join(mates.select("node"), "node", "left_semi").mapInArrow(_list, "node long, shingles array<long>")
        listed = common.materialise(listed.join(mates, "node"), "near-listed")
        each = listed.select("node", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
        abroad = each.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("texts"))
        abroad = common.materialise(abroad.where("low != high").select("shingle", "texts"), "near-abroad")
        ranked = each.join(abroad.hint("merge"), "shingle").groupBy("node", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "shingle"))).alias("rare"))
        # a text whose shared shingles are too few for any partner has no prefix and goes here
        ranked = ranked.withColumn("shared", F.size("rare")).where(F.col("shared") >= self.least * F.col("n") - 1e-9)
        bin_of = lambda n: F.floor(F.log(n) / F.lit(step) + 1e-9).cast("int")
        ranked = ranked.withColumn("bin", bin_of(F.col("n"))).withColumn("other", F.explode(F.sequence(bin_of(F.col("n") * self.least), bin_of(F.col("n") / self.least))))
        least_other = F.exp(F.col("other") * step) * (1 - 1e-6)
        needed = F.ceil(share * (F.col("n") + F.greatest(least_other, F.col("n") * self.least)) - 1e-6)
        ranked = ranked.withColumn("prefix", (F.col("shared") - needed + 1).cast("int")).where("prefix > 0")
        posted = ranked.select("node", "comp", "n", "shared", "bin", F.least("bin", "other").alias("low"), F.greatest("bin", "other").alias("high"), F.explode(F.slice("rare", 1, F.col("prefix"))).alias("r"))
        key = ["shingle", "low", "high"]
        posted = common.materialise(posted.withColumn("shingle", F.col("r.shingle")).drop("r"), "near-prefixes")
        homes = posted.groupBy(*key, "comp").agg(F.count("*").alias("texts")).groupBy(*key)
        homes = homes.agg(F.max(F.struct("texts", "comp"))["comp"].alias("home"), F.count("*").alias("classes")).where("classes > 1").drop("classes")
        homes = common.materialise(homes, "near-homes")
        met = common.materialise(posted.join(homes.hint("merge"), key), "near-prefixes-met")
        names = ("node", "comp", "n", "shared", "bin")
        x = met.where("comp != home").select(*key, *(F.col(c).alias(f"x_{c}") for c in names))
        y = met.select(*key, "home", *(F.col(c).alias(f"y_{c}") for c in names))
        apart = (F.col("x_comp") != F.col("y_comp")) & ((F.col("y_comp") == F.col("home")) | (F.col("x_node") < F.col("y_node")))
        facing = (F.col("x_bin") != F.col("y_bin")) | (F.col("low") == F.col("high"))
        near = F.least("x_shared", "y_shared") >= share * (F.col("x_n") + F.col("y_n")) - 1e-6
        pairs = x.join(y.hint("merge"), key).where(apart & facing & near)
        return common.materialise(pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct(), "near-feasible")

    def _placed(self) -> DataFrame:
        """Nodes with their class: key, doc_id, copies, comp, links."""
        comps = components(self.links) if self.comps is None else self.comps
        degree = self.links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
        placed = self.nodes.select("node", "key", "doc_id", "copies").join(comps, "node", "left").join(degree, "node", "left")
        placed = placed.select("key", "doc_id", "copies", F.coalesce("comp", "node").alias("comp"), F.coalesce("links", F.lit(0)).alias("links"))
        return common.materialise(placed, "near-nodes-placed")

    def classes(self) -> DataFrame:
        """One row per row: doc_id, class_id, group_size, kept, links."""
        placed = self._placed()
        # written before they are joined, so that adaptive execution can split a large class or group of copies
        groups = common.materialise(placed.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("group_size")), "near-groups")
        known = common.materialise(placed.drop("doc_id", "copies").join(groups, "comp").drop("comp"), "near-known")
        out = self.signed.select("doc_id", "key").join(known, "key")
        return out.select("doc_id", "class_id", "group_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "links")

    def representatives(self) -> DataFrame:
        """One text of each class, told by its smallest identifier (nulls last) and its digest: doc_id, key."""
        first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
        return self._placed().groupBy("comp").agg(F.min(first).alias("r")).select("r.doc_id", "r.key")


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of each near-duplicate class of ``docs``, with all its columns: that of the smallest doc_id.

    Rows are told by doc_id and text, so an identifier that comes with several texts is
    several documents; of rows alike in both one stays.
    """
    kept_id, kept_key, key = common.free_names(docs, "_kept_id", "_kept_key", "_key")
    kept = NearDuplicates(docs.select("doc_id", "text"), least).representatives()
    kept = common.materialise(kept.select(F.col("doc_id").alias(kept_id), F.col("key").alias(kept_key)), "near-kept")
    keyed = docs.withColumn(key, F.unhex(F.sha2(common.text_bytes(), 256)))
    here = keyed.join(kept, (F.col(key) == F.col(kept_key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)))
    return here.dropDuplicates([kept_key]).select(common.own_columns(docs))


def near_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, text), one row per row.

    Returns doc_id, class_id (smallest doc_id of the class), group_size, kept, and links
    (verified links of its text to other texts).
    """
    return NearDuplicates(docs, least).classes()
