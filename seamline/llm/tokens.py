"""Ids of texts by a public byte-level BPE tokenizer, its words remembered by the worker."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words, and spans between blanks, whose tokens a worker remembers: about 180 bytes each.
WORDS, SPANS = 50_000, 600_000

#: The pre-tokeniser's split, for texts of the characters that ``_PLAIN`` allows: a fixed value.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-§«¬°±´¶·»¿-ʯΑ-ΡΣ-ώЀ-ҁҊ-ԯ‐-‧‰-⁞€]*")


#: Signs that the split takes for words of their own after letters.
_SIGNS = frozenset(".,;:!?")


def _byte_letters() -> list[str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordTokenizer:
    """A byte-level BPE tokenizer with its words remembered.

    Merges never cross the pre-tokeniser's words, so a text's ids are its words' ids in a
    row.  Words are remembered singly, and so is what stands between two blanks: where no
    blank is doubled or ends the text, every blank begins a word.  Texts with characters
    outside of the plain set, or with the tokenizer's special strings, go to the tokenizer
    whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.model = self.inner.model
        self.special = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.blank = self.letters[0x20]
        #: No entry joins a line break with a blank: what follows a single break is split apart.
        self.single_breaks = not any(self.letters[0x0A] in entry and self.blank in entry for entry in self.inner.get_vocab())
        self.words: dict[str, bytes] = {}
        self.spans: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= WORDS:
                self.words.clear()
            tokens = self.model.tokenize("".join(map(self.letters.__getitem__, word.encode())))
            ids = self.words[word] = array("I", [t.id for t in tokens]).tobytes()
        return ids

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._word, _SPLIT.findall(text)))

    def _letters(self, word: str, before: str) -> bytes:
        """Ids of a word of letters, after ``before`` (the blank's letter, or nothing)."""
        spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(before + spelled)]).tobytes()

    def _span(self, span: str) -> bytes:
        """Ids of what follows a blank, the blank included; letters, perhaps with a sign at the end, need no splitting."""
        if span.isalpha():
            return self._letters(span, self.blank)
        if span[-1:] in _SIGNS and span[:-1].isalpha():
            return self._remembered(span[:-1]) + self._word(span[-1])
        if "\n" in span and self.single_breaks:  # single line breaks are words of their own
            first, *lines = span.split("\n")
            if first and all(lines):
                return self._remembered(first) + b"".join([self._word("\n") + (self._word(x) if x.isalpha() else self._plain(x)) for x in lines])
        return self._plain(" " + span)

    def _remembered(self, span: str) -> bytes:
        """``_span``, kept for the next time: new spans push out, a generation at a time, those not met for long."""
        ids = self.spans.get(span)
        if ids is None:
            ids = self.older.get(span) or self._span(span)
            if len(self.spans) >= SPANS // 2:
                self.older, self.spans = self.spans, {}
            if "\n" not in span:  # what stands around a line break seldom comes again
                self.spans[span] = ids
        return ids

    def _listed(self, text: str) -> bool:
        """Whether the split of words here is the tokenizer's."""
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _simple(self, text: str) -> bool:
        """Whether every blank begins a word."""
        return "  " not in text and not text.endswith(" ") and self._listed(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not self._simple(text):
            if self._listed(text):
                return self._plain(text)
            return np.array(self.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        found = list(map(self.spans.get, rest))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = self._remembered(rest[at])
        return self._plain(first) + b"".join(found)

    def encode_many(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end`` after each, and where each text ends.

        Spans are looked up once for each different one; their ids are then laid out by array operations.
        """
        tail = np.array([end], "<u4").tobytes()
        firsts, rests = [], []
        for t in texts:
            if self._simple(t):
                first, blank, rest = t.partition(" ")
                firsts.append(self._plain(first))
                rests.append(rest if blank else None)
            else:
                firsts.append(self.encode(t))
                rests.append(None)
        lists = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        spans = coded.dictionary.to_pylist()
        known = list(map(self.spans.get, spans))
        for at, ids in enumerate(known):
            if ids is None:
                known[at] = self._remembered(spans[at])
        known += [*firsts, tail]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat, begins = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        # a text is its first span, the others, the tail
        bounds = lists.offsets.to_numpy().astype(np.int64)
        around = np.stack([len(spans) + np.arange(len(texts)), np.full(len(texts), len(known) - 1)], axis=1).ravel()
        order = np.insert(coded.indices.to_numpy().astype(np.int64), np.stack([bounds[:-1], bounds[1:]], axis=1).ravel(), around)
        counts = sizes[order]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begins[order] - (ends - counts), counts) + np.arange(total)]
        return ids, ends[bounds[1:] + 2 * np.arange(1, len(texts) + 1) - 1] if len(texts) else np.zeros(0, np.int64)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, kept while the worker lives."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


#: Bytes of texts that a task tokenises, packs and holds at a time.
GROUP_BYTES = 6 << 20


def grouped(batches: Iterable[pa.RecordBatch], size: int = GROUP_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of batches of two columns, put together up to a size; a longer text is not divided."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(one)
            texts.append(text)
            held += len(text)
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if texts:
        yield ids, texts
