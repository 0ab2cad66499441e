import random

import numpy as np
import pytest
from conftest_llm import ODD, prose
from pyspark.sql import functions as F

from seamline.llm import common
from seamline.llm import near_dedup as n


def edited(words, rng, k):
    w = list(words)
    for _ in range(k):
        at = rng.randrange(len(w))
        w[at : at + 1] = rng.choice([[], [f"zz{rng.randrange(10**6)}"], [w[at], f"yy{rng.randrange(10**6)}"]])
    return w


def brute(texts):
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    s = {i: n.shingles((t or "").encode()) for i, t in texts.items()}
    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and ((texts[a] or "") == (texts[b] or "") or n.similarity(s[a], s[b]) >= n.LEAST):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_classes_match_brute_force(make):
    rng = random.Random(9)
    texts = {}
    for g in range(12):
        base = prose(g * 11, rng.randrange(40, 200)).split()
        texts[len(texts)] = " ".join(base)
        for _ in range(rng.randrange(6)):
            texts[len(texts)] = " ".join(edited(base, rng, max(1, int(len(base) * rng.choice([0.01, 0.015, 0.2])))))
    for i in range(40):
        texts[len(texts)] = prose(4000 + 7 * i, rng.randrange(3, 80), 3)
    shared = prose(77, 30)
    for i in range(30):  # one passage that many texts share
        texts[len(texts)] = shared + " " + prose(6000 + 13 * i, 60, 5)
    rows = n.near_classes(make([(i, t, "s") for i, t in texts.items()])).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == brute(texts)


def test_hot_group_of_edited_copies(make):
    rng = random.Random(2)
    base = prose(3, 120).split()
    texts = {0: " ".join(edited(base, rng, 1))} | {1: " ".join(base)} | {i: " ".join(edited(base, rng, 2)) for i in range(2, 150)} | {i: prose(i * 31, 50, 7) for i in range(150, 300)}
    rows = n.near_classes(make([(i, t, "s") for i, t in texts.items()]).repartition(7)).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == brute(texts)
    assert sum(r["kept"] for r in rows) == len({r["class_id"] for r in rows})


class OneBucket(n.NearDuplicates):
    """All nodes in one bucket, led by the smaller doc_ids."""

    def _buckets(self):
        return common.materialise(self.nodes.select(F.lit(0).cast("long").alias("bucket"), "node", (-F.col("doc_id")).alias("score")), "near-buckets")


@pytest.mark.parametrize("families,length", [(1, 3), (5, 4)])
def test_chains_that_the_first_hub_does_not_match(make, families, length):
    texts = {}
    for f in range(families):
        words = prose(f * 50, 100, 3).split()[:60]
        for k in range(length):  # each near the one before, no two steps apart
            texts[len(texts)] = " ".join(words)
            words[10 + 15 * k] = f"zz{f}x{k}"
    rows = OneBucket(make([(i, t, "s") for i, t in texts.items()])).classes().collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == brute(texts) == {i: i - i % length for i in texts}


@pytest.mark.parametrize("kind", ["edits", "window"])
def test_drifting_copies(make, kind):
    """Chains of ten texts, each an edit, or a move by 30 words, of the one before; hubs take members from one another."""
    rng, texts = random.Random(5), {}
    for c in range(25):
        pool = [f"w{rng.randrange(10**7)}" for _ in range(700)]
        words = pool[:300]
        for k in range(10):
            texts[len(texts)] = " ".join(words if kind == "edits" else pool[30 * k : 30 * k + 300])
            words = [f"e{rng.randrange(10**7)}" if i in spots else w for spots in [set(rng.sample(range(300), 5))] for i, w in enumerate(words)]
    want = {}
    for c in range(25):
        want |= brute({i: texts[i] for i in range(10 * c, 10 * c + 10)})
    rows = n.near_classes(make([(i, t, "s") for i, t in texts.items()])).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == want


def test_feasible_pairs_hold_every_near_pair(make):
    """The search across classes misses no pair, whatever its lengths, and leaves most others out."""
    rng, texts = random.Random(6), {}
    for g in range(12):
        base = prose(g * 29, rng.randrange(40, 200), 3).split()
        for _ in range(8):
            a = rng.randrange(len(base) // 8)
            texts[len(texts)] = " ".join(edited(base[a:], rng, rng.randrange(1 + len(base) // 50)))
    near = OneBucket(make([(i, t, "s") for i, t in texts.items()]))
    ids = {r["node"]: r["doc_id"] for r in near.nodes.collect()}
    mates = near.nodes.select("node", F.col("node").alias("comp"))  # every text a class of its own
    pairs = {(ids[r["a"]], ids[r["b"]]) for r in near._feasible(mates, near._bodies(mates)).collect()}
    pairs = {(min(p), max(p)) for p in pairs}
    s = {i: n.shingles(t.encode()) for i, t in texts.items()}
    held = set(ids.values())  # one of equal texts
    true = {(a, b) for a in held for b in held if a < b and n.similarity(s[a], s[b]) >= n.LEAST}
    assert len(true) > 20 and true <= pairs and len(pairs) < len(texts) ** 2 / 8


def test_similarity_against_plain_alignment():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        b = edited([*a], rng, 0)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(6)] * rng.randrange(2)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        lcs = table[-1, -1]
        want = lcs / (len(a) + len(b) - lcs) if b else 0
        assert abs(n.similarity(np.array(a, np.uint64), np.array(b, np.uint64)) - (want if want >= 0.8 - 1e-12 else 0)) < 1e-9


def test_moved_text_is_not_an_edit():
    first, second = prose(1, 60), prose(30, 60)
    a, b = n.shingles((first + " " + second).encode()), n.shingles((second + " " + first).encode())
    assert n.similarity(a, b) == 0 and n.similarity(a, a) == 1


def test_odd_rows(odd, make):
    rows = n.near_classes(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["class_id"] == by[2]["class_id"] == 1 and by[3]["class_id"] == 3
    assert by[5]["class_id"] == by[6]["class_id"] == 5 and by[5]["group_size"] == 3
    assert by[None]["class_id"] is None and by[None]["kept"]
    assert n.near_classes(make([])).isEmpty()
