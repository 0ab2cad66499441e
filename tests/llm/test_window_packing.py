import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import ODD, prose
from tokenizers import Tokenizer

from seamline.llm import queries, window_packing as w

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def padding(n, capacity):
    return 0 if n & (n - 1) == 0 else capacity - n


def cost_of(cuts, places, penalties, capacity, window):
    by = dict(zip(places, penalties))
    ends = [0, *cuts]
    return sum(padding(b - a, capacity) + by[b] + window for a, b in zip(ends, ends[1:]))


@pytest.mark.parametrize("seed", range(40))
def test_cuts_are_the_cheapest(seed):
    r = random.Random(seed)
    capacity, window = r.choice([8, 16, 32]), r.choice([0, 1, 3])
    places = [0]
    for _ in range(r.randint(1, 80)):
        places.append(places[-1] + r.randint(1, min(capacity, r.choice([2, 5, 9]))))
    penalties = [0, *(r.choice([0, 1, 4, 9]) for _ in places[2:]), 0]
    best = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        best[j] = min(best[i] + padding(places[j] - places[i], capacity) + penalties[j] + window for i in range(j) if places[j] - places[i] <= capacity)
    cuts = w.window_cuts(np.array(places), np.array(penalties), capacity, window)
    assert cuts[-1] == places[-1] and all(0 < b - a <= capacity for a, b in zip([0, *cuts], cuts))
    assert cost_of(cuts, places, penalties, capacity, window) == best[-1]


def check(rows, docs, plain, capacity=2048, end=1):
    """Every id once, in its place; sequences gapless; documents in the order of their partition."""
    ids = {}
    for i, text in docs:
        ids.setdefault(i, []).append(plain.encode(text or "", add_special_tokens=False).ids + [end])
    sequences, held = {}, {}
    for r in rows:
        assert r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append(r)
        held.setdefault(r["doc_id"], []).append(r)
    for spans in sequences.values():
        spans.sort(key=lambda r: r["offset"])
        at = 0
        for r in spans:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    for i, wanted in ids.items():
        assert sum(r["length"] for r in held[i]) == sum(map(len, wanted))
        if len(wanted) == 1:
            spans = sorted(held[i], key=lambda r: r["start"])
            assert {r["doc_tokens"] for r in spans} == {len(wanted[0])}
            at = 0
            for r in spans:
                piece = np.array(wanted[0][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
                assert r["start"] == at and (r["ids"] == piece if "ids" in r.asDict() else r["ids_crc32"] == zlib.crc32(piece))
                at += r["length"]
    assert held.keys() == ids.keys()
    return sequences


def test_odd_rows(odd, make, plain):
    check(w.pack(odd, PATH).collect(), [(i, t) for i, t, _ in ODD], plain)
    assert w.pack(make([]), PATH).isEmpty()


def test_order_and_sentences(make, plain):
    rows = [(i, ". ".join(prose(i + k, 12).capitalize() for k in range(30)) + ".", "a") for i in range(60)]
    got = w.pack(make(rows).coalesce(1), PATH).collect()
    sequences = check(got, [(i, t) for i, t, _ in rows], plain)
    stream = [r for s in sorted(sequences) for r in sequences[s]]
    assert [(r["doc_id"], r["start"]) for r in stream] == sorted((r["doc_id"], r["start"]) for r in stream)
    ids = {i: plain.encode(t, add_special_tokens=False).ids + [1] for i, t, _ in rows}
    for r in got:  # cut documents go on where a sentence begins
        assert r["start"] == 0 or plain.decode([ids[r["doc_id"]][r["start"] - 1]]).endswith(".")
    lost = sum(padding(sum(r["length"] for r in s), 2048) for s in sequences.values())
    assert lost <= 0.02 * sum(map(len, ids.values())) + 2048


def test_blocks_go_on(make, plain):
    # no window ends because a block does: only the last is short
    rows = [(i, prose(i, 150), "a") for i in range(80)]
    df = make(rows).coalesce(1)
    for block in (3_000, 40_000):
        sequences = check(w.pack(df, PATH, block=block).collect(), [(i, t) for i, t, _ in rows], plain)
        sizes = [sum(r["length"] for r in sequences[s]) for s in sorted(sequences)]
        assert sum(padding(n, 2048) for n in sizes[:-1]) <= 0.03 * sum(sizes), (block, sizes)


def test_no_boundaries(make, plain):
    rows = [(1, "x" * 30_000, "a"), (2, "漢" * 9_000, "a")]
    check(w.pack(make(rows), PATH).collect(), [(i, t) for i, t, _ in rows], plain)


def test_registered(spark, small, plain):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    sequences = check(queries.op11_window_packing(spark, small).collect(), docs, plain)
    sizes = [sum(r["length"] for r in s) for s in sequences.values()]
    assert sum(padding(n, 2048) for n in sizes) <= 0.02 * sum(sizes)
