import itertools
import random
import time

import pytest
from conftest_llm import ODD, prose

from seamline.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    t = mixing.targets([10, 1000, 1000], [1, 2, 3])
    assert t[0] == 30.0 and sum(t) == pytest.approx(2010) and t[2] / t[1] == pytest.approx(1.5)
    assert mixing.targets([0, 0], [1, 2]) == [0.0, 0.0] and mixing.targets([], []) == []


def cost(flow, patterns, quotas, repeats):
    """Unmet tokens dominate; then repeats by convex cost."""
    routed = [sum(a for (i, _), a in flow.items() if i == p) for p in range(len(patterns))]
    met = sum(flow.values())
    price = sum((2 * k + 1) for p, r in enumerate(routed) for k in range(repeats) for _ in range(max(0, min(patterns[p][1], r - k * patterns[p][1]))))
    return -met, price


def test_flow_is_cheapest():
    rng = random.Random(2)
    for _ in range(60):
        patterns = [(sorted(rng.sample(range(2), rng.randrange(1, 3))), rng.randrange(1, 4)) for _ in range(2)]
        quotas = [rng.randrange(6) for _ in range(2)]
        found = mixing.min_cost_flow(patterns, quotas, 2)
        routes = [(i, s) for i, (sources, _) in enumerate(patterns) for s in sources]
        best = None
        for amounts in itertools.product(range(7), repeat=len(routes)):
            flow = dict(zip(routes, amounts))
            if any(sum(a for (i, _), a in flow.items() if i == p) > 2 * n for p, (_, n) in enumerate(patterns)):
                continue
            if any(sum(a for (_, t), a in flow.items() if t == s) > q for s, q in enumerate(quotas)):
                continue
            c = cost(flow, patterns, quotas, 2)
            best = c if best is None or c < best else best
        assert cost(found, patterns, quotas, 2) == best


def test_flow_of_many_patterns():
    """Twice as many patterns as sources can be told apart by eye, overlapping and alone: met quotas, linear time."""
    rng = random.Random(3)
    n = 200_000
    patterns = [([s], rng.randrange(1, 50)) for s in range(n)]
    began = time.perf_counter()
    flow = mixing.min_cost_flow(patterns, [2 * size for _, size in patterns])
    assert all(flow[s, s] == 2 * size for s, (_, size) in enumerate(patterns)) and time.perf_counter() - began < 20
    patterns = [(sorted(rng.sample(range(300), rng.randrange(1, 5))), rng.randrange(1, 100)) for _ in range(20_000)]
    whole = sum(size for _, size in patterns)
    quotas = [whole // 300] * 300
    flow = mixing.min_cost_flow(patterns, quotas)
    assert sum(flow.values()) == sum(quotas)
    routed = [0] * len(patterns)
    for (i, s), amount in flow.items():
        assert s in patterns[i][0]
        routed[i] += amount
    assert all(r <= 3 * size for r, (_, size) in zip(routed, patterns)) and time.perf_counter() - began < 60


def test_plans_that_are_not_broadcast(make, monkeypatch):
    rows = [(i, prose(i, 1 + i % 40), f"s{i % 30}") for i in range(600)]
    want = sorted(map(tuple, mixing.by_weight(make(rows)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 5)
    assert sorted(map(tuple, mixing.by_weight(make(rows)).collect())) == want


def test_mix_comes_near_targets(make):
    rng = random.Random(1)
    rows = [(i, prose(i, rng.randrange(1, 90)), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(1500)]
    a = mixing.by_weight(make(rows)).collect()
    b = mixing.by_weight(make(rows).repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    by = {}
    for r in a:
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], [0, 0, r]).__setitem__(0, by[r["source"]][0] + r["taken"])
        by[r["source"]][1] += r["size"]
    for taken, size, r in by.values():
        assert r["source_size"] == size
        assert abs(taken - r["target"]) <= max(3, 0.005 * r["target"])


def test_overlapping_sources(spark):
    rows = [(i, ["a", "b"] if i % 2 else ["a"], 10) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, members array<string>, size long")
    out = mixing.mix(df, quotas={"a": 500, "b": 700}).collect()
    assert sum(r["taken"] for r in out) == 1200
    assert sum(r["taken"] for r in out if r["members"] == ["a"]) == 500  # b can only use the shared ones


def test_odd_rows(odd, make):
    rows = mixing.by_weight(odd).collect()
    assert len(rows) == len(ODD)
    sizes = {r["doc_id"]: r["size"] for r in rows}
    assert (sizes[1], sizes[2], sizes[3], sizes[8]) == (0, 0, 0, 1)
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.by_weight(make([])).isEmpty()
