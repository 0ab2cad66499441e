import random
import re
import time

from conftest_llm import ODD, prose

from seamline.llm import licenses

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_labels(text, notices=licenses.NOTICES):
    """Labels and score by comparing every run of words with every notice."""
    words = [w.encode() for w in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    longest = {}
    for phrase, label, *_ in [*((p, x, 0, "") for p, x in PHRASES.items()), *notices]:
        longest[label] = max(longest.get(label, 1), len(phrase))
    *_, base = brute(text)
    labels, score = set(filter(None, base.split(","))), float(bool(base))
    known = {}
    for i in range(len(words)):
        for phrase, label, edits, after in notices:
            for j in range(i + 1, min(len(words), i + len(phrase.split()) + edits) + 1):
                run = b" ".join(words[i:j])
                if abs(len(run) - len(phrase)) <= edits and re.match(after.encode() + b"(?![^ ])", b"".join(b" " + w for w in words[j:])):
                    if (phrase, run) not in known:
                        known[phrase, run] = distance(phrase.encode(), run)
                    if known[phrase, run] <= edits:
                        labels.add(label)
                        score = max(score, 1 - known[phrase, run] / longest[label])
    return ",".join(sorted(labels)), score


NOTED = {
    "SPDX-License-Identifier: MIT": "mit",
    "spdx-licence-identifier: Apache-2.0 OR x": "apache-2.0",
    "under the ISC License": "isc",
    "BSD 3-Clause": "bsd-3-clause",
    "the BSD 2-Clause licence": "bsd-2-clause",
    "GNU Affero General Public License v3": "agpl,agpl-3.0",
    "GNU Lesser General Public License, version 2.1": "lgpl,lgpl-2.1",
    "the GNU General Public License, version 2.0": "gpl,gpl-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
    "Boost Software License": "bsl-1.0",
    "see the UNLICENSE": "unlicense",
    "Apche Lisense": "",
    "Apache Lisense": "apache",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
    "CC BY-NC-SA": "cc-by,cc-by-nc-sa",
    "CC BY-ND": "cc-by,cc-by-nd",
    "Mozila Public License 2.0": "mpl,mpl-2.0",
    "Creative Commons Attribution-ShareAlike": "cc-by,cc-by-sa",
    "All rights reserved": "all-rights-reserved",
    "a general public licence plate": "",
    "bsd 4 clause": "",
    "this is free and unencumbered sofware released in to the public domain": "unlicense",
}


def test_short_notices(make):
    texts = [prose(1, 9) + " " + t + " " + prose(2, 9) for t in NOTED]
    rows = licenses.digest(licenses.license_spans(make([(i, t, "s") for i, t in enumerate(texts)]))).collect()
    assert {texts[r["doc_id"]]: r["labels"] for r in rows} == dict(zip(texts, NOTED.values()))
    for r in rows:
        assert (r["labels"], r["score"]) == brute_labels(texts[r["doc_id"]])


def test_errors_match_a_plain_edit_search(make):
    rng, texts = random.Random(11), []
    for _ in range(150):
        phrase, _, edits, _ = rng.choice(licenses.NOTICES)
        t = list(phrase + rng.choice(["", " 2", " version 3 0", " v2 1", " nc", " mit"]))
        for _ in range(rng.randrange(edits + 3)):
            at = rng.randrange(len(t))
            t[at : at + rng.choice([0, 1])] = rng.choice(["", "q", " ", "e"])
        texts.append(" ".join(["some", "words", "".join(t), "mit", "licence", "end"][rng.randrange(2) :]))
    rows = licenses.digest(licenses.license_spans(make([(i, t, "s") for i, t in enumerate(texts)]))).collect()
    for r in rows:
        assert (r["labels"], r["score"]) == brute_labels(texts[r["doc_id"]]), texts[r["doc_id"]]
    assert sum(r["labels"] != r["base_labels"] for r in rows) > 100


def test_base_matches_brute_force(spark, make):
    texts = [None, "", "CC BY CC-BY cc by-sa", "The MIT License; mit license, Apache  License", "xmit license mit licenses", "GNU general Public LICENSE é mit license",
             prose(1, 5000) + " apache license " + prose(2, 10), "cc\nby", "ccby cc  9 by"]
    df = make([(i, t, "s") for i, t in enumerate(texts)])
    rows = {r["doc_id"]: r for r in licenses.digest(licenses.license_spans(df)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert r["score"] == 1.0 if r["n_base"] else r["score"] < 1


def test_notices_with_errors(make):
    texts = {
        1: prose(1, 20) + " released under the gnu genral public licence, version 3",
        2: "Permission is hereby granted, free of charge to any persn obtaining a cpy of this",
        3: "redistribution and use in source and binary forms, with or without modifications",
        4: "apache licence",
        5: "mad licence of generic public interest " + prose(3, 30),
    }
    rows = {r["doc_id"]: r for r in licenses.digest(licenses.license_spans(make([(i, t, "s") for i, t in texts.items()]))).collect()}
    assert {i: r["labels"] for i, r in rows.items()} == {1: "gpl,gpl-3.0", 2: "mit", 3: "bsd", 4: "apache", 5: ""}
    assert all(r["n_base"] == 0 for r in rows.values()) and 0.8 < rows[1]["score"] < 1


def test_pigeonhole_pieces_find_every_bounded_error():
    import random

    rng = random.Random(5)
    phrase = "gnu general public license"
    for _ in range(200):
        t = list(phrase)
        for _ in range(rng.randrange(3)):
            k, at = rng.randrange(3), rng.randrange(1, len(t) - 1)
            if k == 0:
                t[at] = "q"
            elif k == 1:
                t.insert(at, "q")
            else:
                del t[at]
        spans = licenses.scan_words(b"aa " + " ".join("".join(t).split()).encode() + b" bb")
        assert any(s[0] == "gpl" for s in spans), "".join(t)


def test_many_hits_in_one_text_take_linear_time():
    began = time.perf_counter()
    spans = licenses.scan_words(b" ".join([b"mit license"] * 40_000))
    assert [s[1] for s in spans] == list(range(0, 80_000, 2)) and time.perf_counter() - began < 10


def test_neighbouring_notices_are_all_found():
    spans = licenses.scan_words(b"mit licence mit license mit licens apache licence")
    assert sorted((label, first, exact) for label, first, _, _, exact in spans) == [("apache", 6, False), ("mit", 0, False), ("mit", 2, True), ("mit", 4, False)]


def test_odd_rows(odd, make):
    assert licenses.license_spans(odd).count() == len(ODD)
    assert licenses.license_spans(make([])).isEmpty()
