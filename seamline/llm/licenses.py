"""License scan: exact phrases, and short notices found with a bounded number of errors.

A notice that may carry k errors is cut into k + 1 pieces: by the pigeonhole principle one
of them survives unchanged wherever the notice occurs with at most k edits.  The pieces of
all notices are searched at once by an Aho-Corasick automaton; around each hit
the regex library's bounded-error matching verifies the whole notice, from every word where
it may start, and yields its span and edit count.  A notice may ask for more after its phrase, without errors, such as a
version, so that versions and variants a single letter apart are not taken for each other;
families (plain, lesser, affero) are further apart than the edits allowed.

Texts are read whole, as words: A-Z lower-cased, every other ASCII character but letters
and digits separates, and everything beyond ASCII belongs to words.

Cases.  Null and empty texts have no words and no labels.  Rows are treated one by one, so
repeated rows repeat their result and a null doc_id stays null.  Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Exact phrases and their labels: fixed values.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


def _version(*numbers: str) -> str:
    """What follows a name, as words: a version, and the end of its number."""
    return r" (?:version |v |v)?(?:" + "|".join(numbers) + r")(?! \d)"


#: What an SPDX identifier says, as words, and its label.
SPDX = (
    ("mit", "mit"), ("isc", "isc"), ("unlicense", "unlicense"), ("zlib", "zlib"), ("cc0 1 0", "cc0-1.0"), ("bsl 1 0", "bsl-1.0"),
    ("apache 2 0", "apache-2.0"), ("bsd 2 clause", "bsd-2-clause"), ("bsd 3 clause", "bsd-3-clause"), ("mpl 2 0", "mpl-2.0"), ("epl 2 0", "epl-2.0"),
    ("gpl 2 0", "gpl-2.0"), ("gpl 3 0", "gpl-3.0"), ("lgpl 2 1", "lgpl-2.1"), ("lgpl 3 0", "lgpl-3.0"), ("agpl 3 0", "agpl-3.0"),
)

#: Notices searched with errors: (phrase, label, edits allowed in the phrase, pattern of what must follow).
NOTICES = (
    ("gnu general public license", "gpl", 2, ""),
    ("gnu general public license", "gpl-2.0", 2, _version("2", "2 0")),
    ("gnu general public license", "gpl-3.0", 2, _version("3", "3 0")),
    ("gnu lesser general public license", "lgpl", 3, ""),
    ("gnu library general public license", "lgpl", 3, ""),
    ("gnu lesser general public license", "lgpl-2.1", 3, _version("2 1")),
    ("gnu lesser general public license", "lgpl-3.0", 3, _version("3", "3 0")),
    ("gnu affero general public license", "agpl", 3, ""),
    ("gnu affero general public license", "agpl-3.0", 3, _version("3", "3 0")),
    ("apache license", "apache", 1, ""),
    ("apache license", "apache-2.0", 1, _version("2", "2 0")),
    ("mozilla public license", "mpl", 2, ""),
    ("mozilla public license", "mpl-2.0", 2, _version("2", "2 0")),
    ("eclipse public license", "epl", 2, ""),
    ("eclipse public license", "epl-2.0", 2, _version("2", "2 0")),
    ("common development and distribution license", "cddl", 3, ""),
    ("boost software license", "bsl-1.0", 2, ""),
    ("artistic license", "artistic", 1, ""),
    ("python software foundation license", "psf", 2, ""),
    ("european union public licence", "eupl", 2, ""),
    ("mit license", "mit", 1, ""),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 4, ""),
    ("isc license", "isc", 1, ""),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 5, ""),
    ("zlib license", "zlib", 1, ""),
    ("bsd license", "bsd", 1, ""),
    ("bsd 2 clause", "bsd-2-clause", 0, ""),
    ("bsd 3 clause", "bsd-3-clause", 0, ""),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 4, ""),
    ("the names of its contributors may be used to endorse or promote products", "bsd-3-clause", 4, ""),
    ("the unlicense", "unlicense", 1, ""),
    ("this is free and unencumbered software released into the public domain", "unlicense", 4, ""),
    ("creative commons attribution", "cc-by", 2, ""),
    ("creative commons attribution share alike", "cc-by-sa", 3, ""),
    ("creative commons attribution non commercial", "cc-by-nc", 3, r"(?! (?:sharealike|share alike|noderiv|no deriv))"),
    ("cc by sa", "cc-by-sa", 0, ""),
    ("cc by nd", "cc-by-nd", 0, ""),
    ("cc by nc", "cc-by-nc", 0, r"(?! (?:sa|nd)(?![^ ]))"),
    ("cc by nc sa", "cc-by-nc-sa", 0, ""),
    ("cc by nc nd", "cc-by-nc-nd", 0, ""),
    ("creative commons zero", "cc0-1.0", 2, ""),
    ("cc0 1 0", "cc0-1.0", 0, ""),
    ("all rights reserved", "all-rights-reserved", 1, ""),
    *(("spdx license identifier", label, 2, f" {words}") for words, label in SPDX),
)

#: Bytes to words: lower case, separators to blanks.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def pieces(phrase: bytes, edits: int) -> list[tuple[int, bytes]]:
    """``edits`` + 1 pieces of nearly equal length, each with its offset."""
    cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


#: Most bytes that a pattern after a phrase can take.
AFTER = 64


@lru_cache(maxsize=8)
def _compiled(notices: tuple):
    """An automaton of all pieces, which gives (phrase, offset), and each phrase's length, edits and (label, pattern)."""
    phrases: dict[tuple[str, int], list] = {}
    for phrase, label, edits, after in notices:
        # the blank before it is matched too: the library takes no insertion at a match's very start
        fuzzy = b" (?:" + regex.escape(phrase.encode(), literal_spaces=True) + b"){e<=%d}" % edits
        phrases.setdefault((phrase, edits), []).append((label, regex.compile(fuzzy + after.encode() + b"(?![^ ])", regex.BESTMATCH)))
    of_piece: dict[str, list[tuple[int, int]]] = {}
    for at, (phrase, edits) in enumerate(phrases):
        for offset, part in pieces(phrase.encode(), edits):
            of_piece.setdefault(part.decode("latin-1"), []).append((at, offset))
    automaton = ahocorasick.Automaton()
    for part, places in of_piece.items():
        automaton.add_word(part, (len(part), places))
    if of_piece:
        automaton.make_automaton()
    return automaton, [(len(phrase.encode()), edits, patterns) for (phrase, edits), patterns in phrases.items()]


def scan_words(words: bytes, base=BASE, notices=NOTICES) -> list[tuple[str, int, int, int, bool]]:
    """Spans in text given as words joined by single blanks: (label, first word, words, edits, is base)."""
    padded, found = b" " + words + b" ", []
    blanks: np.ndarray | None = None  # places of the blanks, once a span asks for a word's number

    def word_at(place: int) -> int:
        nonlocal blanks
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20)
        return int(np.searchsorted(blanks, place))

    for phrase, label in base:
        wanted, at = b" " + phrase.encode() + b" ", -1
        while (at := padded.find(wanted, at + 1)) >= 0:
            found.append((label, word_at(at), phrase.count(" ") + 1, 0, True))
    exact = {(label, start) for label, start, *_ in found}
    automaton, phrases = _compiled(notices)
    # where a notice may start: blanks of ``padded`` at most its edits away from where a piece puts it
    starts: dict[int, set[int]] = {}
    for last, (size, places) in automaton.iter(words.decode("latin-1")) if len(automaton) else ():
        begin = last + 1 - size
        for at, offset in places:
            edits = phrases[at][1]
            blank = padded.find(b" ", max(0, begin - offset - edits))
            while 0 <= blank <= begin - offset + edits:
                starts.setdefault(at, set()).add(blank)
                blank = padded.find(b" ", blank + 1)
    spans = set()
    for at, opened in starts.items():
        length, edits, patterns = phrases[at]
        for start in opened:
            high = padded.find(b" ", start + 1 + length + edits + AFTER)
            for label, pattern in patterns:
                match = pattern.match(padded, start, len(padded) if high < 0 else high + 1)
                if match:
                    spans.add((label, start, match.end() - 1, sum(match.fuzzy_counts)))
    for label, start, end, errors in sorted(spans):
        first = word_at(start)
        if (label, first) not in exact:
            found.append((label, first, word_at(end) - first + 1, errors, False))
    return found


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("edits", pa.int64()), ("exact", pa.bool_())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("score", pa.float64())])
_OUT_DDL = "doc_id long, n_words long, spans array<struct<label:string,first_word:long,words:long,edits:long,exact:boolean>>, score double"


def _scan(base, notices):
    length = {}
    for phrase, label, *_ in (*base, *notices):
        length[label] = max(length.get(label, 1), len(phrase))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, scores = [], [], []
            for body in batch.column(1):
                words = body.as_py().translate(_TO_WORDS).split()
                found = scan_words(b" ".join(words), base, notices)
                counts.append(len(words))
                spans.append([dict(zip(("label", "first_word", "words", "edits", "exact"), x)) for x in found])
                scores.append(max((1.0 - e / length[label] for label, _, _, e, _ in found), default=0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, _OUT.field(2).type), pa.array(scores, pa.float64())], schema=_OUT)

    return run


def license_spans(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, spans, score.

    ``spans`` lists label, first word, words, edits and whether it is an exact base phrase;
    ``score`` is 1 for an exact phrase, less by the share of edits otherwise, 0 without any.
    """
    common.prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("body"))
    return source.mapInArrow(_scan(tuple(base), tuple(notices)), _OUT_DDL)


def digest(spans: DataFrame) -> DataFrame:
    """Counts and comma-joined labels of ``license_spans``."""
    exact = F.filter("spans", lambda s: s["exact"])
    starts = F.transform(exact, lambda s: s["first_word"])
    return spans.select(
        "doc_id",
        "n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(exact, lambda s: s["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["label"]))), ",").alias("labels"),
        "score",
    )
