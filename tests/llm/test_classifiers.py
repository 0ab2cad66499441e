import random

import numpy as np
from conftest_llm import ODD, prose

from seamline.llm import queries, quality, toxicity


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng.randrange(500), rng.randrange(10, 60)).split()
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grufflebad", "snarkvile", "mudbrained"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, make):
    rows, labels = corpus()
    docs = make(rows)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, table.where("doc_id % 3 <> 1"))
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(found[i], y) for i, y in labels if i % 3 == 1]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.95


def test_toxicity_odd_rows(spark, odd, make):
    for labels in ([], [(5, 1)], [(5, 1), (7, 0), (8, None), (None, 1), (1, 0), (1, 1)]):
        model = toxicity.train(odd, spark.createDataFrame(labels, "doc_id long, toxic int"))
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        by = [r["score"] for r in rows if r["doc_id"] == 5]
        assert by[0] == by[1]
    assert toxicity.score(make([]), model).isEmpty()


def test_labels_held_out_of_the_fit(spark, small):
    scores = {r["doc_id"]: r for r in queries.op1_toxicity(spark, small).collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in scores.items())
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in scores.values())


def junk(i):
    rng = random.Random(i)
    words = prose(rng.randrange(500), 60).split()
    kind = i % 4
    if kind == 0:
        return " ".join(w + rng.choice(["%%%", "***", "$$$"]) for w in words)
    if kind == 1:
        return "!! ".join(words).upper()
    if kind == 2:
        return " | ".join(words)
    return " ".join(w for w in words[:3] for _ in range(25))


def sentences(i):
    words = prose(i, 80).split()
    return ". ".join("the " + " of ".join(words[k : k + 4]).capitalize() for k in range(0, 80, 4)) + "."


def test_quality_finds_junk_without_labels(make):
    rows = [(i, junk(i) if i % 8 == 0 else sentences(i), "s") for i in range(400)]
    rows = [(i, junk(i // 8) if i % 8 == 0 else t, s) for i, t, s in rows]
    docs = make(rows)
    kept = {r["doc_id"] for r in quality.keep_good(docs).select("doc_id").collect()}
    bad = {i for i, *_ in rows if i % 8 == 0}
    assert not kept & bad
    assert len(kept) >= 0.98 * (400 - len(bad))


def test_estimated_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    one_sided = lambda hit: np.where(~good & (rng.random(4000) < hit), -1, 0)
    two_sided = lambda right: np.where(rng.random(4000) < right, np.where(good, 1, -1), np.where(good, -1, 1))
    votes = np.stack([one_sided(h) for h in (0.7, 0.5, 0.4, 0.6, 0.5, 0.3)] + [two_sided(0.95), two_sided(0.9)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, likelihood, prior = quality.estimate(patterns, counts)
    assert abs(prior - 0.8) < 0.03
    assert [abs(likelihood[0][j][0] - h) < 0.08 for j, h in enumerate((0.7, 0.5, 0.4, 0.6, 0.5, 0.3))] == [True] * 6
    assert posterior.shape == counts.shape


def test_quality_odd_rows(odd, make):
    model = quality.train(odd)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) and {r["doc_id"] for r in rows if r["score"] < 0.01} >= {1, 2, 3}
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.where("trim(text) = '' OR text IS NULL").isEmpty()
    assert quality.keep_good(make([])).isEmpty()


def plain_features(text):
    """Hashed n-grams of a text, a character at a time."""
    folded = []
    for b in b" " + text.encode() + b" ":
        b = b + 32 if 0x41 <= b <= 0x5A else b
        b = b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
        if b != 0x20 or not folded or folded[-1] != 0x20:
            folded.append(b)
    found = set()
    for order in toxicity.ORDERS:
        for i in range(len(folded) - order + 1):
            h = 0
            for b in folded[i : i + order]:
                h = (h * 0x01000193 + b) & 0xFFFFFFFF
            h = ((h ^ (order * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0xC2B2AE35) & 0xFFFFFFFF
            found.add(h >> (32 - toxicity.BITS))
    return found


def test_toxicity_model_against_plain_counts(spark, make):
    rows, labels = corpus(90, 3)
    docs = make(rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    sets, said = {i: plain_features(t) for i, t, _ in rows}, dict(labels)
    toxic = sum(said.values())
    count = {f: [0, 0] for s in sets.values() for f in s}
    for i, s in sets.items():
        for f in s:
            count[f][said[i]] += 1
    table = np.zeros((2, 1 << toxicity.BITS))
    for f, (clean, bad) in count.items():
        table[:, f] = clean, bad
    assert (toxicity.presence([t.encode() for _, t, _ in rows], [said[i] for i, *_ in rows]) == table).all()
    # the naive Bayes ratios and the screen, feature by feature
    kept, ratio = toxicity.screened(table, len(rows) - toxic, toxic)
    whole = [sum(1 + table[c, f] for f in range(table.shape[1])) for c in (0, 1)]
    for f in kept:
        assert abs(ratio[f] - np.log((1 + table[1, f]) / whole[1] / ((1 + table[0, f]) / whole[0]))) < 1e-9
        cells = [(table[1, f], toxic, True), (toxic - table[1, f], toxic, False), (table[0, f], len(rows) - toxic, True), (len(rows) - toxic - table[0, f], len(rows) - toxic, False)]
        present = table[0, f] + table[1, f]
        g = sum(2 * c * np.log(c * len(rows) / (h * (present if p else len(rows) - present))) for c, h, p in cells if c)
        assert g >= toxicity.SCREEN - 1e-6
    assert set(np.flatnonzero(model.weights)) <= set(kept) and len(kept) > 20
    # scores are the bias and the weights of the n-grams that are there, each once
    for r in toxicity.score(docs, model).collect():
        z = model.bias + sum(float(model.weights[f]) for f in sets[r["doc_id"]])
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-6


def test_expectation_maximisation_against_plain_loops():
    rng = np.random.default_rng(2)
    patterns = np.unique(rng.integers(-1, 2, (12, len(quality.LABELLERS))), axis=0)
    patterns[:, :6] = np.minimum(patterns[:, :6], 0)
    counts = rng.integers(1, 40, len(patterns)).tolist()
    post = [0.1 if -1 in p else 0.9 for p in patterns.tolist()]
    for _ in range(100):
        mass = [[n * (1 - q) for n, q in zip(counts, post)], [n * q for n, q in zip(counts, post)]]
        prior = (sum(mass[1]) + 1) / (sum(counts) + 2)
        chance = []
        for k in (0, 1):
            chance.append([])
            for j, both in enumerate(quality.TWO_SIDED.values()):
                seen = {v: 1 + sum(m for m, p in zip(mass[k], patterns.tolist()) if p[j] == v) for v in (-1, 0, 1)}
                total = seen[-1] + seen[1] if both else sum(seen.values())  # a two-sided labeller's silence says nothing
                chance[k].append({v: 1.0 if both and v == 0 else seen[v] / total for v in seen})
        new = []
        for p in patterns.tolist():
            like = [1 - prior, prior]
            for k in (0, 1):
                for j, v in enumerate(p):
                    like[k] *= chance[k][j][v]
            new.append(like[1] / (like[0] + like[1]))
        if max(abs(a - b) for a, b in zip(new, post)) < 1e-9:
            break
        post = new
    found, likelihood, found_prior = quality.estimate(patterns, counts)
    assert np.allclose(found, post, atol=1e-6) and abs(found_prior - prior) < 1e-6


def test_accuracies_of_an_empty_table(make):
    assert quality.train(make([])).accuracies() == {}
    assert set(quality.train(make([(1, sentences(1), "s")])).accuracies()) == set(quality.LABELLERS)
