"""Order-preserving packing: window cuts by dynamic programming with a monotone queue.

Documents of a partition are one stream of ids in their order; windows of at most
``CAPACITY`` ids follow each other in it.  A cut may fall between documents (free), between
sentences (``SENTENCE``), or, where a sentence has no end for long, every ``STRIDE`` ids
(``ANYWHERE``).  A window costs its padding, nothing if its length is a power of two, else
what is missing to the capacity, and ``WINDOW`` for itself, so that short windows are not
made for their length alone; costs are in ids.  The cheapest cost up to a place is its
penalty plus the least, over the places up to a capacity before it, of their cost plus
their position: a monotone queue holds the candidates for that least, so a place costs
constant time, and the lengths that are powers of two are looked up beside it.

A task reads its stream in blocks.  What is left after a block's last window, less than a
window's ids, begins the next block, so no window ends because a block does, and memory holds one block
and one document.  Only a partition's last window may be short for want of more.

Cases.  Null text is packed as empty text: the end token alone.  A very long text is cut
like any stream, losing no id.  Repeated rows are packed row by row; a null doc_id stays null.
Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import grouped, tokenizer

CAPACITY = 2048
END_TOKEN = 1
#: Penalties of cuts, and the cost of a window, in padded ids.
SENTENCE, ANYWHERE, WINDOW = 4, 48, 16
#: Ids between places inside a long sentence where it may be cut.
STRIDE = 64


def window_cuts(places: np.ndarray, penalties: np.ndarray, capacity: int = CAPACITY, window: int = WINDOW, closed: bool = True) -> list[int]:
    """Positions where windows end, of the cheapest way from the first place to the last.

    ``places`` ascend from 0, at most ``capacity`` apart; ``penalties`` are those of cutting
    there.  Without ``closed`` the way ends at the cheapest place from which less than a
    window is left.
    """
    # pairs of places a power of two apart: a window between them needs no padding
    at = np.full(int(places[-1]) + 1, -1, np.int64)
    at[places] = np.arange(len(places))
    later, earlier = [], []
    for k in range(capacity.bit_length()):
        if 1 << k <= capacity:
            (j,) = np.nonzero(places >= 1 << k)
            i = at[places[j] - (1 << k)]
            later.append(j[i >= 0])
            earlier.append(i[i >= 0])
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(later, kind="stable")
    bounds, earlier = np.searchsorted(later[order], np.arange(len(places) + 1)).tolist(), earlier[order].tolist()
    where, cost = places.tolist(), [0.0] * len(places)
    back = [0] * len(places)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (cost + position, place), least first
    penalties = (penalties + window).tolist()
    for j in range(1, len(where)):
        here = where[j]
        while where[queue[0][1]] < here - capacity:
            queue.popleft()
        least, i = queue[0]
        least += capacity - here
        if bounds[j] != bounds[j + 1]:
            for other in earlier[bounds[j] : bounds[j + 1]]:
                if cost[other] < least:
                    least, i = cost[other], other
        cost[j], back[j] = least + penalties[j], i
        bar = cost[j] + here
        while queue and queue[-1][0] >= bar:
            queue.pop()
        queue.append((bar, j))
    found, j = [], len(where) - 1
    if not closed:
        j = min((k for k in range(len(where) - 1, -1, -1) if where[k] > where[-1] - capacity), key=lambda k: (cost[k], -k))
    while j:
        found.append(where[j])
        j = back[j]
    return found[::-1]


def sentence_marks(path: str) -> tuple[np.ndarray, np.ndarray]:
    """For each id: whether it can end a sentence, and whether what it begins can follow one."""
    inner = tokenizer(path)
    entries = inner.inner.get_vocab()
    size = max(entries.values()) + 1
    ends, begins = np.zeros(size, bool), np.zeros(size, bool)
    breaks = tuple(inner.letters[b] for b in (0x20, 0x0A, 0x0D, 0x09))
    stops = tuple(["".join(map(inner.letters.__getitem__, "。".encode())), ".", "!", "?"])
    for entry, number in entries.items():
        ends[number] = entry.rstrip("\"')]").endswith(stops)
        begins[number] = entry.startswith(breaks)
    return ends, begins


_MARKS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def candidates(ids: np.ndarray, documents: np.ndarray, marks: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``ids`` may be cut, 0 and the end among them, and their penalties; documents end at ``documents``."""
    ends, begins = marks
    sentences = np.nonzero(ends[ids[:-1]] & begins[ids[1:]])[0] + 1
    firm = np.unique(np.concatenate(([0, len(ids)], documents, sentences)))
    gaps = np.diff(firm)
    more = (gaps - 1) // STRIDE
    inside = np.repeat(firm[:-1], more) + STRIDE * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    places = np.sort(np.concatenate((firm, inside)))
    penalties = np.full(len(places), ANYWHERE, np.int64)
    penalties[np.searchsorted(places, sentences)] = SENTENCE
    penalties[np.searchsorted(places, documents)] = 0
    penalties[[0, -1]] = 0
    return places, penalties


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PIECES_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pack_stream(path: str, capacity: int, end: int, block: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, sequence = tokenizer(path), TaskContext.get().partitionId() << 40
        if path not in _MARKS:
            _MARKS[path] = sentence_marks(path)
        # the open stream: ids, and its documents' names, beginnings (the first may lie before it) and ends
        ids, names = np.zeros(0, np.uint32), []
        begins = ends = np.zeros(0, np.int64)

        def pieces(cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Documents by windows: each piece lies in one of both."""
            bounds = np.unique(np.concatenate(([0], cuts, ends[ends < cuts[-1]])))
            left, right = bounds[:-1], bounds[1:]
            doc, windows = np.searchsorted(ends, left, "right"), np.searchsorted(cuts, left, "right")
            offset = left - np.concatenate(([0], cuts))[windows]
            data = ids.astype("<u4", copy=False)
            for a in range(0, len(left), 4096):
                part = slice(a, a + 4096)
                bodies = [data[x:y].tobytes() for x, y in zip(left[part].tolist(), right[part].tolist())]
                d = doc[part]
                columns = [pa.array([names[i] for i in d.tolist()], pa.int64()), left[part] - begins[d], right[part] - left[part], pa.array(bodies, pa.binary()), (ends - begins)[d], sequence + windows[part], offset[part]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], schema=_PIECES)

        for doc_ids, texts in grouped(batches, block):
            more, until = inner.encode_many(texts, end)
            names += doc_ids
            begins = np.concatenate((begins, len(ids) + np.concatenate(([0], until[:-1]))))
            ends = np.concatenate((ends, len(ids) + until))
            ids = np.concatenate((ids, more))
            cuts = np.array(window_cuts(*candidates(ids, ends, _MARKS[path]), capacity, closed=False), np.int64)
            if len(cuts):
                yield from pieces(cuts)
                sequence += len(cuts)
                done = int(np.searchsorted(ends, cuts[-1], "right"))
                names, begins, ends, ids = names[done:], begins[done:] - cuts[-1], ends[done:] - cuts[-1], ids[cuts[-1] :]
        if len(ids):
            yield from pieces(np.array(window_cuts(*candidates(ids, ends, _MARKS[path]), capacity), np.int64))

    return run


#: Bytes of texts in a block of the stream.
BLOCK_BYTES = 6 << 20


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END_TOKEN, digest: dict[str, Column] | None = None, block: int = BLOCK_BYTES) -> DataFrame:
    """Pack ``docs`` (doc_id, text), in their order, into sequences of at most ``capacity`` ids.

    Returns doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.  With ``digest`` (columns over these names) its columns take the place of ids.
    """
    common.prepare(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    found = source.mapInArrow(_pack_stream(tokenizer_path, capacity, end, block), _PIECES_DDL)
    if digest is None:
        return found
    return found.select("doc_id", "start", "length", *(c.alias(n) for n, c in digest.items()), "doc_tokens", "sequence_id", "offset")
