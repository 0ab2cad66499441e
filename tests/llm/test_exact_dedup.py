import hashlib
import random
from collections import defaultdict

import pytest
from conftest_llm import ODD

from seamline.llm import exact_dedup as x


def brute(rows, keep=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [j for j in groups[t or ""] if j is not None]
        winner = keep(ids) if ids else None
        out.append((i, winner, len(groups[t or ""]), i == winner, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in df.collect()), key=str)


def test_odd_rows(odd):
    rows = [(i, t) for i, t, _ in ODD]
    assert got(x.exact_groups(odd)) == brute(rows)
    assert got(x.exact_groups(odd, "smallest")) == brute(rows, min)


def test_empty_table_and_bad_argument(make):
    assert x.exact_groups(make([])).isEmpty()
    with pytest.raises(ValueError):
        x.exact_groups(make([]), "newest")


@pytest.mark.parametrize("budget", [2_000, 20_000, 1 << 30])
def test_hot_group_with_flushes_and_spills(make, budget):
    rng = random.Random(budget)
    texts = ["same prefix " * 20 + str(rng.randrange(40)) for _ in range(300)] + ["hot"] * 300
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = make([(i, t, "s") for i, t in rows]).repartition(5)
    assert got(x.exact_groups(df, trie_bytes=budget)) == brute(rows)


def test_trie_spills_and_returns_everything():
    rng = random.Random(1)
    trie, want = x.RadixTrie(budget=3_000), defaultdict(list)
    for i in range(2_000):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12)))
        want[data].append(i)
        trie.insert(data, x.Entry(i, i, 1, [i]))
    assert trie.files
    found = {}
    for data, e in trie.items():
        assert data not in found
        found[data] = (e.smallest, e.largest, e.count, sorted(e.owners))
    assert found == {d: (min(v), max(v), len(v), v) for d, v in want.items()}


def drained(trie):
    found = {}
    for data, e in trie.items():
        assert data not in found
        found[data] = (e.smallest, e.largest, e.count, sorted(e.owners))
    return found


@pytest.mark.parametrize("length", [1, 3, 50])
def test_texts_longer_than_the_budget(length):
    budget = 1_000
    base = bytes(i * 7919 % 251 for i in range(length * budget))
    texts = [base, base + b"tail", base[:-1] + b"!", b"x" + base, base[: len(base) // 2], base[: len(base) // 2] + b"?", b"", b"x"] * 3
    trie, want = x.RadixTrie(budget), defaultdict(list)
    for i, data in enumerate(texts):
        want[data].append(i)
        trie.insert(data, x.Entry(i, i, 1, [i]))
    assert trie.files and trie.held <= budget
    assert drained(trie) == {d: (min(v), max(v), len(v), v) for d, v in want.items()}


def test_nested_spills_of_a_caterpillar():
    rng = random.Random(3)
    spine = bytes(rng.randrange(256) for _ in range(12_000))
    trie, want = x.RadixTrie(2_000), defaultdict(list)
    for i in range(500):  # texts that leave a long common one anywhere, some twice
        cut = rng.randrange(len(spine))
        data = spine[:cut] + bytes([rng.randrange(4)]) * rng.randrange(3)
        want[data].append(i)
        trie.insert(data, x.Entry(i, i, 1, [i]))
    assert drained(trie) == {d: (min(v), max(v), len(v), v) for d, v in want.items()}
    assert trie.files > 5


def test_long_texts_through_the_operator(make):
    long = "abcdefghij" * 3_000
    rows = list(enumerate([long, long + "x", long, "short", long[:-1], None, long + "x", long]))
    assert got(x.exact_groups(make([(i, t, "s") for i, t in rows]).repartition(3), trie_bytes=10_000)) == brute(rows)
