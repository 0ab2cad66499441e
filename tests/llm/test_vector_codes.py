import hashlib
import random

import numpy as np
import pytest

from seamline.llm import vector_codes

DDL = "vec_id long, embedding array<double>, label int, code string, vector int, error long, part int"


def brute(rows, entries=16, rounds=6):
    """Plain Python over (vec_id, vector, label) rows that take part: {row number: (code, error)}, label totals, hash."""
    from fractions import Fraction
    from math import floor

    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[floor(Fraction(x) * 4096) for x in r[1]] for r in rows]
    width = len(ints[0]) // 8
    parts = [[v[p * width : (p + 1) * width] for p in range(8)] for v in ints]
    books = [[list(v[p]) for v in parts[:entries]] for p in range(8)]

    def assign(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(8):
            mine = {}
            for v in parts:
                mine.setdefault(assign(p, v[p])[1], []).append(v[p])
            for j, members in mine.items():
                books[p][j] = [sum(c) // len(c) for c in zip(*members)]
    final = [[assign(p, v[p]) for p in range(8)] for v in parts]
    out, totals = [], {}
    for r, found in zip(rows, final):
        error = sum(d for d, _ in found)
        out.append([r[0], "".join(f"{j:02x}" for _, j in found), min(error, 2**63 - 1), r[2]])
        totals[r[2]] = totals.get(r[2], 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, min(totals[lab], 2**63 - 1), digest) for i, c, e, lab in out), key=str)


def vectors(n, width=2, seed=1):
    r = random.Random(seed)
    return [(i, [r.choice([r.gauss(0, 1), round(r.gauss(0, 1), 1)]) for _ in range(8 * width)], r.choice([None, 1, 2])) for i in range(n)]


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, lab, "x", 1, 2, 3) for i, v, lab in rows], DDL).repartition(3)
    return sorted((tuple(r) for r in vector_codes.compress(df, **more).collect()), key=str)


def test_equals_brute_force(spark):
    rows = vectors(150)
    rows += [rows[3], (7, rows[9][1], 2), (None, rows[11][1], None), (None, [0.0] * 16, 1)]
    odd = [(900, None, 1), (901, [1.0] * 15 + [None], 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 2), (904, [], 1), (905, [1.0] * 24, 1), (906, [1.0] * 3, 1)]
    assert run(spark, rows + odd) == brute(rows)


def test_large_components_are_exact(spark):
    rows = vectors(20) + [(100, [1e9] * 16, 1), (101, [-3.4e38] * 16, 1), (102, [1e300] * 8 + [1.5] * 8, None), (103, [2e9 + 0.3] * 16, 2)]
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    rows = vectors(3)
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == []


@pytest.mark.parametrize("seed", range(6))
def test_the_annulus_holds_the_nearest(seed):
    r = np.random.default_rng(seed)
    book = r.integers(-4000, 4000, (16, 3))
    book[5] = book[2]
    book[7] = -book[2]
    parts = np.concatenate([r.integers(-6000, 6000, (500, 3)), book, np.zeros((2, 3), int)])
    index, best = vector_codes.nearest(parts, book)
    far = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    assert (best == far.min(axis=1)).all() and (index == far.argmin(axis=1)).all()


def test_the_annulus_prunes():
    # entries on spheres far apart: only those of the part's own sphere are evaluated
    r = np.random.default_rng(0)
    book = np.array([[10_000 * (k + 1), 0, 0] for k in range(16)])
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if self.ndim == 2 and isinstance(at, np.ndarray):
                seen.append(np.size(at))
            return super().__getitem__(at)

    parts = np.array([[10_000 * (k % 16 + 1) + 3, 4, 0] for k in range(160)]) + r.integers(0, 3, (160, 3))
    index, _ = vector_codes.nearest(parts, book.view(Watched))
    assert (index == np.arange(160) % 16).all()
    assert sum(seen) <= 3 * len(parts)


def test_registered(spark, small):
    import duckdb

    from seamline.llm.queries import ORACLE_SQL, op13_vector_codes

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{small}/embeddings.parquet')")
    want = con.execute(ORACLE_SQL["op13_vector_codes"]).fetchall()
    assert sorted(tuple(r) for r in op13_vector_codes(spark, small).collect()) == sorted(want)
