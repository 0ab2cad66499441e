import random
import zlib
from collections import Counter, defaultdict

from conftest_llm import ODD, prose

from seamline.llm import sharding


def check(rows, n, shards=8):
    assert len(rows) == n
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))


def test_groups_stay_together_and_bytes_are_even(make):
    rng = random.Random(3)
    texts = [prose(i, rng.randrange(20, 60)) for i in range(1200)]
    for g in range(60):
        for _ in range(rng.randrange(1, 6)):
            texts[rng.randrange(1200)] = prose(5000 + g, 40)
    docs = [(i, t, "s") for i, t in enumerate(texts)]
    rows = sharding.shard_documents(make(docs)).collect()
    check(rows, 1200)
    loads, where = Counter(), defaultdict(set)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
        loads[r["shard"]] += r["size"]
        where[t].add(r["shard"])
    even = sum(loads.values()) / 8
    assert max(abs(x - even) for x in loads.values()) < 0.01 * even
    assert sum(len(v) > 1 for v in where.values()) <= 2


def test_hot_group_fills_few_shards(make):
    docs = [(i, prose(1, 40) if i % 3 == 0 else prose(i, 40), "s") for i in range(1500)]
    rows = sharding.shard_documents(make(docs)).collect()
    check(rows, 1500)
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) < 1.03 * sum(loads.values()) / 8
    hot = Counter(r["shard"] for r in rows if r["doc_id"] % 3 == 0)
    assert sum(n for _, n in hot.most_common(4)) > 0.9 * 500


def test_links_cut_against_brute_force(make):
    """Groups of all sizes that fit a shard: at most one is cut for evenness, and reruns agree."""
    rng = random.Random(8)
    texts = [prose(9000 + g, 30) for g in range(40) for _ in range(2 + g)] + [prose(i, rng.randrange(20, 50)) for i in range(700)]
    rng.shuffle(texts)
    docs = make([(i, t, "s") for i, t in enumerate(texts)])
    rows = sharding.shard_documents(docs).collect()
    check(rows, len(texts))
    shard = {r["doc_id"]: r["shard"] for r in rows}
    cut = sum(1 for a in range(len(texts)) for b in range(a) if texts[a] == texts[b] and shard[a] != shard[b])
    links = sum(1 for a in range(len(texts)) for b in range(a) if texts[a] == texts[b])
    assert cut <= 0.05 * links
    assert sorted(sharding.shard_documents(docs.repartition(5)).select("doc_id", "shard").collect()) == sorted((i, s) for i, s in shard.items())


def spread(rows):
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    return loads


def test_rows_alike_are_placed_apart(spark, make):
    alike = make([(7, "same words", "s")]).crossJoin(spark.range(2000)).drop("id")
    docs = alike.unionByName(make([(1000 + i, prose(i, 12), "s") for i in range(2000)])).repartition(5)
    rows = sharding.shard_documents(docs).collect()
    check(rows, 4000)
    loads = spread(rows)
    even = sum(loads.values()) / 8
    assert max(abs(loads[k] - even) for k in range(8)) <= 0.01 * even
    again = sharding.shard_documents(docs.repartition(3)).collect()
    assert Counter((r["doc_id"], r["shard"]) for r in again) == Counter((r["doc_id"], r["shard"]) for r in rows)


def test_a_table_of_nulls_is_even(make, spark):
    rows = sharding.shard_documents(make([(None, None, None)]).crossJoin(spark.range(400)).drop("id")).collect()
    check(rows, 400)
    assert sorted(spread(rows).values()) >= [49] * 8


def test_pairs_of_alike_rows_stay_together(make):
    docs = [(i, prose(i, 30), "s") for i in range(600) for _ in range(2)] + [(1000 + i, prose(700 + i, 30), "s") for i in range(800)]
    rows = sharding.shard_documents(make(docs)).collect()
    check(rows, 2000)
    where = defaultdict(set)
    for r in rows:
        where[r["doc_id"]].add(r["shard"])
    assert sum(len(v) > 1 for v in where.values()) <= 3


def test_odd_rows(odd, make):
    rows = sharding.shard_documents(odd).collect()
    check(rows, len(ODD))
    assert sharding.shard_documents(make([])).isEmpty()
