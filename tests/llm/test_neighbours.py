from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from seamline.llm import neighbours


def table(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    return df.withColumns({"id": F.lit("x"), "vec": F.lit("y"), "pivot": F.lit(0)})


def brute(rows, query, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q, v in good.items():
        if not query(q):
            continue
        s = sorted((-(v @ w) / np.sqrt((v @ v) * (w @ w)), i) for i, w in good.items() if i != q)
        out[q] = [(i, -x) for x, i in s[:k]]
    return out


def recall(df, want):
    found = {}
    for r in df.collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == set(want)
    hits = 0
    for q, best in want.items():
        got = [found[q][k] for k in sorted(found[q])]
        assert [k for k in sorted(found[q])] == list(range(1, len(best) + 1)) and q not in {i for i, _ in got}
        scores = [s for _, s in got]
        assert scores == sorted(scores, reverse=True)
        hits += len({i for i, _ in got} & {i for i, _ in best}) / len(best)
    return hits / len(want)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)]
    want = brute(rows, lambda i: i % 50 == 0)
    assert recall(neighbours.search(table(spark, rows), F.col("vec_id") % 50 == 0), want) == 1.0


def test_recall_with_pruned_files_and_copies(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.5 * rng.standard_normal(16)).tolist()) for i in range(3000)]
    hot = rng.standard_normal(16).tolist()
    rows = [(i, hot if i % 3 == 0 else v) for i, v in rows]
    want = brute(rows, lambda i: i % 50 == 0)
    assert recall(neighbours.search(table(spark, rows), F.col("vec_id") % 50 == 0), want) > 0.9


def test_odd_rows(spark):
    # 9 has a length of its own
    rows = [(0, [1, 0]), (50, [1, 1]), (3, None), (4, []), (5, [0, 0]), (6, [None, 1]), (7, [float("nan"), 1]), (8, [float("inf"), 1]), (None, [1, 0]), (9, [1, 2, 3]), (10, [1, 1]), (10, [1, 1]), (11, [2, 2])]
    got = [tuple(r) for r in neighbours.search(table(spark, rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 10), (0, 2, 11), (0, 3, 50), (50, 1, 10), (50, 2, 11), (50, 3, 0)]
    assert abs(got[0][3] - np.sqrt(0.5)) < 1e-12 and abs(got[3][3] - 1) < 1e-12
    assert neighbours.search(table(spark, rows[:0]), F.col("vec_id") % 50 == 0).isEmpty()


def test_lengths_and_repeated_identifiers(spark):
    rows = [(0, [1, 0]), (1, [1, 0.1]), (2, [1, 2, 3]), (50, [1, 2, 3.1]), (3, [3, 2, 1]), (100, [1, 0]), (100, [0, 1]), (4, [0.1, 1]), (4, [1, 0.2])]
    got = [tuple(r) for r in neighbours.search(table(spark, rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 100), (0, 2, 1), (0, 3, 4), (50, 1, 2), (50, 2, 3), (100, 1, 0), (100, 2, 1), (100, 3, 4)]
    assert got[0][3] == got[5][3] == 1.0 and abs(got[6][3] - got[7][3]) < 1e-12  # 1 and 4 are as near to one of 100's vectors


def test_extreme_components_and_signed_zeros(spark):
    df = spark.createDataFrame([(0, [1e300, 1e300]), (1, [1e-310, 1e-310]), (2, [0.0, -5e200]), (3, [-0.0, -1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert [(r, v) for _, r, v, _ in got] == [(1, 1), (2, 2), (3, 3)] and got[0][3] == pytest.approx(1) and got[1][3] == got[2][3] == pytest.approx(-(0.5**0.5))


def test_few_vectors_are_read_for_the_recall(spark):
    """Vectors without any structure, the hardest: 20,000 in one block."""
    rng = np.random.default_rng(3)
    vectors = neighbours.unit(rng.standard_normal((20_000, 64)))
    pivots = neighbours.distinct(vectors, neighbours.pivot_count(len(vectors)))
    perms = neighbours.permutations(vectors, pivots)
    files, read, hits = neighbours.Files(perms, len(pivots)), 0, 0
    for q in range(0, 2_000, 20):
        scores = vectors @ vectors[q]
        scores[q] = -2
        near = files.ranked(perms[q], int(neighbours.SHORTLIST * len(vectors)))
        read += len(near)
        hits += len(set(np.argsort(-scores)[:5]) & set(near))
    assert read < 0.1 * 100 * len(vectors) and hits > 0.9 * 500


def test_pivots_are_no_near_copies():
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    vectors = neighbours.unit(np.concatenate((centre + 0.01 * rng.standard_normal((600, 16)), rng.standard_normal((900, 16))))[rng.permutation(1500)])
    pivots = neighbours.distinct(vectors, 400)
    assert len(pivots) == 400 and (pivots @ pivots.T - 2 * np.eye(400)).max() < neighbours.APART


def test_footrule_ranking_is_exact():
    rng = np.random.default_rng(4)
    perms = np.array([rng.permutation(40)[:8] for _ in range(500)], np.uint16)
    files = neighbours.Files(perms, 40)

    def spared(a, b):
        places = {p: k for k, p in enumerate(b.tolist())}
        return sum(8 - abs(k - places[p]) for k, p in enumerate(a.tolist()) if p in places)

    for q in range(20):
        near = set(files.ranked(perms[q], 30).tolist())
        scores = [spared(perms[q], x) for x in perms]
        cut = max(1, sorted(scores, reverse=True)[29])
        assert near == {i for i, s in enumerate(scores) if s >= cut}


def test_recall_on_the_test_table(spark):
    path = Path("/root/testdata/sf0.1/embeddings.parquet")
    if not path.exists():
        pytest.skip("test tables are not here")
    held = pq.read_table(path)
    rows = list(zip(held.column("vec_id").to_pylist(), held.column("embedding").to_pylist()))
    want = brute(rows, lambda i: i % 50 == 0)
    assert recall(neighbours.search(spark.read.parquet(str(path)), F.col("vec_id") % 50 == 0), want) >= 0.9
