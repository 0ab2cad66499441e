"""Product codes of vectors in integers, with the nearest entry found by annular norm pruning.

A component x counts as the integer floor(4096 x).  A vector is cut into 8 equal
consecutive parts; each part position has a codebook of 16 entries, which starts as that
part of the 16 smallest vec_ids and is refined in rounds: every part is assigned to its
nearest entry (squared distance, ties to the lower index), every entry that was used
becomes the componentwise floor of its parts' mean.

Assignment sorts a codebook's entries by norm.  A part first meets the entry of nearest
norm; its distance allows an interval of norms, found by binary search, and only entries
in that annulus, borders included, are evaluated, in integers.  While the best distance
falls, entries that leave the annulus are passed over.  Norms are floats, so the interval
is widened by more than their error; which entries it holds never changes a result.

A round is one pass over the vectors: tasks add up their parts by (position, entry), Spark
adds up the tasks' sums, and 16 x 8 entries, whatever the input, come to the driver and go
out with the next pass.

Cases.  A vector that is null or holds null or non-finite components takes no part; nor
does an empty one, or one whose length is no multiple of 8 or not that of the smallest
vec_id that takes part.  A null vec_id is coded but comes after all others in the first
codebook; equal vec_ids come there by their vectors.  Fewer than 16 vectors make as
many entries.  Components of any size are exact (Python integers where 64 bits could
overflow); an error over a long's range is returned as the largest long.  Null labels are one
label.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components and entries under this are computed in 64-bit integers.
SMALL = 1 << 26
#: Widening of norm intervals, relative; floats err by less.
EASE = 1e-9
#: Sums travel in digits of so many bits.
DIGIT = 48
LONGEST = (1 << 63) - 1
#: Label totals up to this many are broadcast; more are joined by a shuffle.
FEW_LABELS = 100_000


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(4096 x) of each component: int64, or Python integers where a component is large."""
    scaled = np.floor(vectors * float(SCALE))
    if not vectors.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    # from 2**52 on a double is an integer itself
    exact = [int(x) * SCALE if abs(x) >= 2.0**52 else math.floor(x * SCALE) for x in vectors.ravel().tolist()]
    return np.array(exact, object).reshape(vectors.shape)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry, and its squared distance."""
    if parts.dtype == object or book.dtype == object or np.abs(book).max() >= SMALL:
        # norms of such sizes may not fit a float: the annulus is every entry
        parts, book = parts.astype(object), book.astype(object)
        far = np.stack([((parts - entry) ** 2).sum(axis=1) for entry in book], axis=1)
        index = np.array([min(range(len(book)), key=lambda j, row=row: (row[j], j)) for row in far], np.int64)
        return index, far[np.arange(len(parts)), index]
    norms = np.sqrt((book * book).sum(axis=1).astype(np.float64))
    by_norm = np.argsort(norms, kind="stable")
    norms = norms[by_norm]
    own = np.sqrt((parts * parts).sum(axis=1).astype(np.float64))

    def distance(rows, at):
        gap = parts[rows] - book[by_norm[at]]
        return (gap * gap).sum(axis=1)

    after = np.searchsorted(norms, own).clip(1, max(1, len(norms) - 1))
    before = after - 1
    after = np.minimum(after, len(norms) - 1)
    first = np.where(own - norms[before] <= norms[after] - own, before, after)
    best, index = distance(slice(None), first), by_norm[first]
    reach = np.sqrt(best.astype(np.float64)) * (1 + EASE) + own * EASE
    low, high = np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")
    for step in range(int((high - low).max(initial=0))):
        at = low + step
        (rows,) = np.nonzero(at < high)
        at = at[rows]
        inside = np.abs(norms[at] - own[rows]) <= np.sqrt(best[rows].astype(np.float64)) * (1 + EASE) + own[rows] * EASE
        rows, at = rows[inside], at[inside]
        if len(rows):
            found, entry = distance(rows, at), by_norm[at]
            better = (found < best[rows]) | ((found == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = found[better], entry[better]
    return index, best


@dataclass
class Codebooks:
    """Entries by part position: lists of Python integers."""

    width: int
    books: list[list[list[int]]]

    def arrays(self) -> list[np.ndarray]:
        found = []
        for book in self.books:
            small = all(abs(x) < SMALL for entry in book for x in entry)
            found.append(np.array(book, np.int64 if small else object).reshape(len(book), self.width))
        return found

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """vec_id, vector, label of the rows that take part, whatever their length."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), (F.col(label_col) if label_col else F.lit(None).cast("int")).alias("label"))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0) & finite)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width * PARTS))


def _digits(value: int) -> list[int]:
    """Digits of ``DIGIT`` bits, least first; the last has the sign."""
    found = []
    while not -(1 << 62) < value < 1 << 62:
        found.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*found, value]


def _sums(model: Codebooks):
    """Vectors to (part, entry, place, digit, value): sums of parts by entry; place -1 counts them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, total = model.arrays(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(0), model.width)
            for p, book in enumerate(books):
                parts = vectors[:, p * model.width : (p + 1) * model.width]
                index, _ = nearest(parts, book)
                for entry in np.unique(index).tolist():
                    mine = parts[index == entry]
                    sums = total.setdefault((p, entry), [0] * (model.width + 1))
                    for place, value in enumerate([*mine.sum(axis=0).tolist(), len(mine)]):
                        sums[place] += value
        rows = [(p, entry, place, digit, value) for (p, entry), sums in total.items() for place, x in enumerate(sums) for digit, value in enumerate(_digits(x))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["part", "entry", "place", "digit", "value"])

    return run


def train(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks over ``rows`` as ``usable`` gives them; None where there is no row."""
    common.prepare(rows.sparkSession)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    if not first:
        return None
    length = len(first[0]["vector"])
    same = rows.where(F.size("vector") == length)
    start = same.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    seeds, width = integers(np.array([r["vector"] for r in start], np.float64)).tolist(), length // PARTS
    model = Codebooks(width, [[seed[p * width : (p + 1) * width] for seed in seeds] for p in range(PARTS)])
    for _ in range(rounds):
        added = same.select("vector").mapInArrow(_sums(model), "part long, entry long, place long, digit long, value long")
        added = added.groupBy("part", "entry", "place", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        sums: dict[tuple, list[int]] = {}
        for r in added.collect():  # parts x entries x (width + 1) numbers, whatever the input
            mine = sums.setdefault((r["part"], r["entry"]), [0] * (width + 1))
            mine[r["place"]] += int(r["value"]) << (DIGIT * r["digit"])
        for (p, entry), values in sums.items():
            model.books[p][entry] = [x // values[-1] for x in values[:-1]]
    return model


def encode(rows: DataFrame, model: Codebooks) -> DataFrame:
    """vec_id, label, code, error of ``rows`` as ``usable`` gives them."""
    common.prepare(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = model.arrays()
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(2), model.width)
            found = [nearest(vectors[:, p * model.width : (p + 1) * model.width], book) for p, book in enumerate(books)]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            errors = [min(sum(x), LONGEST) for x in zip(*(d.tolist() for _, d in found))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    same = rows.where(F.size("vector") == model.width * PARTS)
    return same.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add ``label_error``: errors summed over equal labels."""
    coded = common.materialise(coded, "codes")
    wide = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = coded.groupBy("label").agg(F.least(wide, F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    totals = common.materialise(totals.withColumnRenamed("label", "of_label"), "code-totals")
    few = totals.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    totals = F.broadcast(totals) if few else totals.hint("merge")
    return coded.join(totals, coded["label"].eqNullSafe(totals["of_label"])).drop("of_label")


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of ``vectors`` (vec_id, embedding, label) under codebooks trained on them: vec_id, code, error, label_error, codebooks_sha256."""
    rows = common.materialise(usable(vectors), "code-vectors")
    model = train(rows, entries, rounds)
    if model is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = with_label_errors(encode(rows, model))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(model.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in SQL: one pair of named tables a round."""
    step = [
        """
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, embedding
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), component AS (
            SELECT row, CAST(floor(4096 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v,
                   generate_subscripts(embedding, 1) - 1 AS place, len(embedding) // 8 AS width
            FROM kept
        ), p AS (
            SELECT row, place // width AS part, list(v ORDER BY place) AS vs FROM component GROUP BY row, place // width
        ), book0 AS (
            SELECT part, row - 1 AS entry, vs FROM p WHERE row <= 16
        )"""
    ]
    for k in range(ROUNDS + 1):
        step.append(f"""
        near{k} AS (
            SELECT p.row, p.part, arg_min(b.entry, CAST(d AS HUGEINT) * 16 + b.entry) AS entry, min(d) AS d
            FROM p JOIN book{k} b USING (part),
            LATERAL (SELECT list_sum(list_transform(list_zip(p.vs, b.vs), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d)
            GROUP BY p.row, p.part
        )""")
        if k < ROUNDS:
            step.append(f"""
        mean{k} AS (
            SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS vs
            FROM (
                SELECT part, entry, place, CAST(sum(v) AS BIGINT) AS s, count(*) AS n
                FROM (SELECT part, entry, unnest(vs) AS v, generate_subscripts(vs, 1) AS place FROM p JOIN near{k} USING (row, part))
                GROUP BY part, entry, place
            )
            GROUP BY part, entry
        ), book{k + 1} AS (
            SELECT part, entry, coalesce(m.vs, b.vs) AS vs FROM book{k} b LEFT JOIN mean{k} m USING (part, entry)
        )""")
    return (
        ",".join(step)
        + f""", coded AS (
            SELECT row, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM near{ROUNDS} GROUP BY row
        ), digest AS (
            SELECT sha256(string_agg(array_to_string(vs, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS}
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM kept JOIN coded USING (row), digest
        """
    )


ORACLE_SQL = _oracle()
