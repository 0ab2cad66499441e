"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``PREFIX`` nearest pivots in order (a prefix of its
permutation) and posted in the inverted file of each of them with its place.  A query reads
the files of its own nearest pivots and adds up, over those that a vector shares with it,
what the places spare of the footrule distance between the two prefixes; so vectors are
ranked by footrule distance while only (vector, place) entries are read.  The best
``SHORTLIST`` share is read as vectors and reranked by exact cosine in double precision.

Scale.  Equal vectors share one index entry that keeps as many of their smallest
identifiers as a result can use, which loses nothing; a vector that a third of all rows
hold is thus searched and posted once.  The index is dealt by hash into blocks of bounded
bytes, each with the inverted files of its entries, and queries into blocks of
``QUERY_BLOCK``; a task has one of each.  As blocks are random parts of the index, the best
share of every block makes up the best share of the whole.  Pivots grow as the root of the
index, so files get no longer than that; they are a bounded sample (at most ``MAX_PIVOTS``),
no two of them near copies, and the only thing broadcast.  A query to which a block's files give too few candidates
reads the whole block.

Cases.  Null or zero vectors, those with null or non-finite components take no part, as
queries or candidates; nor does a null vec_id.  Cosine is defined between vectors of one
length, so vectors of another length than a query's are no candidates for it; those of
lengths other than the commonest are compared one by one, without pivots.  Repeated rows
(same vec_id and vector) count once.  A vec_id with several vectors is one row of every
result: it is as near as the nearest pair, as query and as candidate.  A row is never its
own neighbour.  With fewer candidates than asked all are returned.  Scores are correctly
rounded sums, alike in every block and rerun; ties go to the smaller vec_id.  Extra columns
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

K = 5
PREFIX = 64
SHORTLIST, LEAST_SHORTLIST = 0.08, 384
LEAST_PIVOTS, MAX_PIVOTS = 16, 16_384
#: Bytes of the sample that pivots are chosen from, and the cosine that two of them stay below.
SAMPLE_BYTES, APART = 32 << 20, 0.9
BLOCK_BYTES, QUERY_BLOCK = 8 << 20, 32_768


def pivot_count(n: int) -> int:
    """Eight times the root of the index, as a power of two."""
    return int(min(MAX_PIVOTS, max(LEAST_PIVOTS, 2 ** round(math.log2(max(1.0, 8 * math.sqrt(n)))))))


def distinct(vectors: np.ndarray, count: int, apart: float = APART) -> np.ndarray:
    """The first ``count`` unit vectors that have no earlier one at a cosine of ``apart`` or more: a group of near copies gives one."""
    chosen = np.zeros((0, vectors.shape[1]))
    for a in range(0, len(vectors), 256):
        block = vectors[a : a + 256]
        if len(chosen):
            block = block[(block @ chosen.T).max(1) < apart]
        near, kept = block @ block.T >= apart, np.zeros(len(block), bool)
        for i in range(len(block)):
            kept[i] = not (near[i, :i] & kept[:i]).any()
        chosen = np.concatenate((chosen, block[kept]))
        if len(chosen) >= count:
            break
    return chosen[:count]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, largest component between 0.5 and 1: exact, and safe to square."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def cosine(a: list[float], b: list[float]) -> float:
    """Cosine of two scaled vectors by correctly rounded sums."""
    total = math.fsum(x * y for x, y in zip(a, b))
    return total / (math.sqrt(math.fsum(x * x for x in a)) * math.sqrt(math.fsum(y * y for y in b)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The ``prefix`` nearest pivots of each vector, nearest first."""
    far = -(unit(vectors) @ pivots.T)
    prefix = min(prefix, far.shape[1])
    some = np.argpartition(far, prefix - 1, axis=1)[:, :prefix]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1).astype(np.uint16)


def _represent(shared):
    """Rows (id, ids, vec, length) with their permutation prefixes; none for other lengths than the pivots'."""

    def run(batches):
        pivots = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            perms = [None] * batch.num_rows
            same = np.flatnonzero(batch.column(3).to_numpy() == pivots.shape[1])
            if len(same):
                for i, perm in zip(same.tolist(), permutations(_matrix(batch.column(2).take(pa.array(same))), pivots)):
                    perms[i] = perm.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(perms, pa.binary())], names=[*batch.schema.names, "perm"])

    return run


_ENTRY = "id long, ids array<long>, vec array<double>, length int, perm binary"
_HITS = "query long, vec_id long, score double"


class Files:
    """Inverted files over permutation prefixes: for each pivot the rows that it is near to, and its place with them."""

    def __init__(self, perms: np.ndarray, pivots: int):
        self.rows, self.prefix = perms.shape
        order = np.argsort(perms.reshape(-1), kind="stable")
        self.row, place = np.divmod(order.astype(np.int32), np.int32(self.prefix))
        self.place = place.astype(np.int16)
        self.start = np.searchsorted(perms.reshape(-1)[order], np.arange(pivots + 1))

    def ranked(self, perm: np.ndarray, most: int) -> np.ndarray:
        """At most about ``most`` rows with the least footrule distance to ``perm``: ties at the end all come along."""
        spared = np.zeros(self.rows, np.int32)
        for k, pivot in enumerate(perm.tolist()):
            a, b = self.start[pivot], self.start[pivot + 1]
            if a < b:
                spared[self.row[a:b]] += self.prefix - np.abs(self.place[a:b] - np.int16(k))
        upwards = np.bincount(spared)[::-1].cumsum()  # rows that spare at least so much, from the most on
        cut = len(upwards) - 1 - int(np.searchsorted(upwards, min(most, self.rows)))
        return np.flatnonzero(spared >= max(1, cut))


def _cell(pivots: int, wanted: int, shortlist: float, least: int):
    """Hits of a block of queries in a block of the index."""
    kind = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(posted: pa.Table, asked: pa.Table) -> pa.Table:
        if not posted.num_rows or not asked.num_rows:
            return kind.empty_table()
        exact, ids = scaled(_matrix(posted.column("vec"))), posted.column("ids").to_pylist()
        sought = scaled(_matrix(asked.column("vec")))
        vectors, queries, n = unit(exact), unit(sought), len(ids)
        perms = posted.column("perm")
        files = None if perms.null_count else Files(np.frombuffer(b"".join(perms.to_pylist()), np.uint16).reshape(n, -1), pivots)
        take = max(least, math.ceil(shortlist * n))
        found: tuple[list, list, list] = ([], [], [])
        for i, (query, perm) in enumerate(zip(asked.column("id").to_pylist(), asked.column("perm").to_pylist())):
            near = None
            if files is not None and take < n:
                near = files.ranked(np.frombuffer(perm, np.uint16), take)
            if near is None or len(near) < min(n, least):
                near = np.arange(n)
            scores = vectors[near] @ queries[i]
            # every entry has at least one identifier, but a vec_id may have several entries: go down until enough differ
            best: dict[int, float] = {}
            some = min(len(near), wanted + 2)
            while True:
                limit = np.partition(scores, len(near) - some)[len(near) - some] - 1e-9
                own = sought[i].tolist()
                for b in near[scores >= limit].tolist():
                    score = cosine(own, exact[b].tolist())
                    for v in ids[b]:
                        best[v] = max(score, best.get(v, -2.0))
                if len(best) >= wanted or some == len(near):
                    break
                some = min(len(near), 4 * some)
            hits = sorted((-s, v) for v, s in best.items())[:wanted]
            found[0].extend([query] * len(hits))
            found[1].extend(v for _, v in hits)
            found[2].extend(-s for s, _ in hits)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(found, kind.types)], schema=kind)

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # -0.0 is 0.0: else equal vectors would differ
    rows = typed.where(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0))
    return rows.select("vec_id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec"))


def search(vectors: DataFrame, is_query, k: int = K, shortlist: float = SHORTLIST, least: int = LEAST_SHORTLIST, seed: int = 0) -> DataFrame:
    """The ``k`` nearest rows of each row that ``is_query`` (a column over vec_id) marks.

    ``vectors``: vec_id, embedding.  Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    common.prepare(spark)
    wanted = k + 1  # one of them may be the query itself
    rows = usable(vectors).dropDuplicates(["vec_id", "vec"])
    # The smallest identifiers of each different vector; the rank is limited before the shuffle.
    place = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    entries = rows.withColumn("place", place).where(F.col("place") <= wanted).groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    index = common.materialise(entries.select(F.xxhash64("vec").alias("id"), "ids", "vec", F.size("vec").alias("length")), "ann-vectors")
    asked = common.materialise(rows.where(is_query), "ann-asked")
    different = common.materialise(asked.select("vec").distinct().withColumn("id", F.monotonically_increasing_id()), "ann-asked-vectors")
    lengths = index.groupBy("length").count().orderBy(F.desc("count"), "length").limit(1).collect()
    if not lengths:
        return common.local_frame(spark, [], "query_id long, rank int, vec_id long, score double")
    dimension, size = lengths[0]
    # at most 4 * MAX_PIVOTS vectors, and SAMPLE_BYTES, reach the driver
    most = max(LEAST_PIVOTS, min(4 * pivot_count(size), SAMPLE_BYTES // (8 * dimension)))
    sample = index.where(F.col("length") == dimension).orderBy(F.xxhash64(F.lit(seed), "id"), "id").select("vec").limit(most).toArrow()
    pivots = distinct(unit(_matrix(sample.column("vec"))), pivot_count(size))
    shared = spark.sparkContext.broadcast(pivots)
    blocks = math.ceil(size / max(256, min(65_536, BLOCK_BYTES // (8 * dimension))))
    posted = common.materialise(index.mapInArrow(_represent(shared), _ENTRY), "ann-index")
    queries = different.select("id", F.array("id").alias("ids"), "vec", F.size("vec").alias("length"))
    queries = common.materialise(queries.mapInArrow(_represent(shared), _ENTRY), "ann-queries")
    query_blocks = math.ceil(queries.count() / QUERY_BLOCK)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n))).cast("int")
    left = posted.withColumn("a", dealt(blocks)).withColumn("b", upto(query_blocks))
    right = queries.withColumn("b", dealt(query_blocks)).withColumn("a", upto(blocks)).drop("ids")
    cells = left.groupBy("length", "a", "b").cogroup(right.groupBy("length", "a", "b")).applyInArrow(_cell(len(pivots), wanted, shortlist, least), _HITS)
    hits = common.materialise(cells, "ann-hits")
    by_query = asked.join(different.withColumnRenamed("id", "query"), "vec").select(F.col("vec_id").alias("query_id"), "query")
    pairs = by_query.join(hits, "query").where(F.col("query_id") != F.col("vec_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
