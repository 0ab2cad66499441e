"""Best-fit packing of tokenised documents by hierarchical residual packing.

Every input partition tokenises its documents, cuts only those longer than a sequence
(into full pieces; the first piece takes the remainder) and packs its pieces best-fit,
longest first.  Bins that are nearly full are final.  Underfull bins go up a tree, eight
nodes to a parent: a parent opens its children's underfull bins and packs what they held
best-fit again; its nearly full bins are final, its underfull ones go up.  Rounds end at the
root, where every bin is final.

What goes up are counts of items by length, at most ``CAPACITY`` numbers a node, so a node's
work is bounded whatever the items' number, and none is left out; nodes of a round are packed
side by side.  Of a length, the items of least rank (children in order) are the final ones,
so a few intervals of ranks by partition and length say where its items end; items meet these,
then the runs of their node's bins, in joins on (node, length, chunk of ranks).  Pieces are
written once to the shared folder; only (item, length) rows are dealt.

Cases.  Null text is packed as empty text: the end token alone.  Very long texts are cut
as said, losing no token.  Repeated rows are packed row by row; a null doc_id stays null.
Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import grouped, tokenizer

CAPACITY = 1024
END_TOKEN = 2
#: A bin with at most this share free is final.
SLACK = 0.002
#: Planned sequences are numbered from here, above the bins of any partition.
PLANNED = 1 << 62


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces: one if it fits, else full ones after the remainder."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    starts = ([0] if first else []) + list(range(first, length, capacity))
    return list(zip(starts, [b - a for a, b in zip(starts, [*starts[1:], length])]))


def best_fit(lengths: Iterable[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: bin and offset of each item, fill of each bin.

    Open bins wait by free room; among those the fullest that fits takes the item.
    """
    lengths = np.asarray(lengths, np.int64)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sizes of room that some bin has
    fill: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = waiting[room].pop()
            if not waiting[room]:
                del rooms[at]
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        room -= n
        if room:
            if not waiting[room]:
                insort(rooms, room)
            waiting[room].append(b)
    return where, offset, fill


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("bin", pa.int64()), ("place", pa.int64()), ("fill", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids binary, part long, bin long, place long, fill long"


def _pack_locally(path: str, capacity: int, end: int, least: int):
    def emit(rows: list[tuple], part: int, first_bin: int) -> Iterator[pa.RecordBatch]:
        """The packed pieces, a batch at a time; bins are numbered from ``first_bin``."""
        lengths = np.array([r[3] for r in rows], np.int64)
        where, place, fill = best_fit(lengths, capacity)
        # pieces of underfull bins become items: bins of their own, for the plan to pack
        filled = np.asarray(fill, np.int64)
        (loose,) = np.nonzero(filled[where] < least)
        where[loose], place[loose] = len(fill) + np.arange(len(loose)), 0
        filled = np.concatenate((filled, lengths[loose]))
        for a in range(0, len(rows), 4096):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows[a : a + 4096]), _PIECES.types)]
            w = where[a : a + 4096]
            more = [np.full(len(w), part), w + first_bin, place[a : a + 4096], filled[w]]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in more)], schema=_PIECES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, inner = TaskContext.get().partitionId(), tokenizer(path)
        next_bin = part << 40
        for doc_ids, texts in grouped(batches):
            ids, ends = inner.encode_many(texts, end)
            rows, begin = [], 0
            for doc_id, until in zip(doc_ids, ends.tolist()):
                whole = ids[begin:until].tobytes()
                for piece, (start, length) in enumerate(cut(until - begin, capacity)):
                    rows.append((doc_id, piece, start, length, whole[4 * start : 4 * (start + length)]))
                begin = until
            yield from emit(rows, part, next_bin)
            next_bin += 2 * len(rows)  # a bin or an item for each piece, and no more

    return run


def best_fit_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``best_fit`` over counts of lengths: (number of bins, items of each length in one such bin).

    Bins that are alike stay one entry; a length splits at most two entries, so there are
    few whatever the counts.
    """
    waiting: dict[int, list[tuple[int, dict[int, int]]]] = {}  # by free room
    rooms: list[int] = []

    def put(room: int, bins: int, held: dict[int, int]) -> None:
        if bins:
            if room not in waiting:
                insort(rooms, room)
            waiting.setdefault(room, []).append((bins, held))

    for n, left in sorted(counts.items(), reverse=True):
        # bins that took this length have less room than it needs, or have the last of it
        while left:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                bins, held = waiting[room].pop()
                if not waiting[room]:
                    del waiting[room], rooms[at]
            else:
                room, held = capacity, {}
                bins = -(-left // (capacity // n))
            each = room // n
            whole = min(bins, left // each)
            left -= whole * each
            put(room - each * n, whole, {**held, n: each})
            if whole < bins and left:
                put(room - left * n, 1, {**held, n: left})
                left, whole = 0, whole + 1
            put(room, bins - whole, held)
    return [entry for entries in waiting.values() for entry in entries]


#: Children of a node of the tree.
FAN = 8
#: Ranks of a length are met with the plan in chunks of so many.
CHUNK = 256

_MERGED = "kind string, node long, child long, fill long, n long, start long, each long, first long, shift long"


def _merge(capacity: int, least: int):
    """One node: its children's items packed by counts; what becomes of them.

    Rows ``final``: a run of items of one length, by rank in the node, and the bins it fills;
    ``child``: rank of a child's first item of a length, and how many of that length are final;
    ``up``: items of underfull bins.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group[c].to_pylist() for c in ("node", "child", "fill", "n"))))
        node, total, first, out = rows[0][0], {}, {}, []
        for _, child, fill, n in rows:
            first[child, fill] = total.get(fill, 0)
            total[fill] = total.get(fill, 0) + n
        final, bin_ = dict.fromkeys(total, 0), 0
        for bins, held in best_fit_counts(total, capacity):
            shift = 0
            if sum(n * each for n, each in held.items()) >= least:
                for n, each in held.items():
                    out.append(("final", node, None, n, bins * each, final[n], each, bin_, shift))
                    final[n] += bins * each
                    shift += n * each
                bin_ += bins
        out += [("child", node, child, fill, final[fill], start, None, None, None) for (child, fill), start in first.items()]
        out += [("up", node, None, n, total[n] - final[n], None, None, None, None) for n in total if total[n] > final[n]]
        types = [pa.string(), *[pa.int64()] * 8]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[c.split()[0] for c in _MERGED.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END_TOKEN, digest: dict[str, Column] | None = None, slack: float = SLACK) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id,
    offset.  With ``digest`` (columns over these names) its columns take the place of ids
    and the tokens themselves are not stored.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    least = int(capacity * (1 - slack))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    pieces = source.mapInArrow(_pack_locally(tokenizer_path, capacity, end, least), _PIECES_DDL)
    output = ["ids"] if digest is None else list(digest)
    if digest is not None:
        pieces = pieces.select("*", *(c.alias(n) for n, c in digest.items())).drop("ids")
    pieces = common.materialise(pieces, "pack-pieces")
    loose = F.col("fill") < least
    plan = merge_tree(pieces.where(loose).select("bin", "fill", "part"), capacity, least)
    names = ["doc_id", "piece", "start", "length", *output]
    # Only items need the plan: the rest, most pieces, stay where they were packed.
    packed = pieces.where(~loose).select(*names, F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    placed = pieces.where(loose).join(plan.hint("merge"), "bin").select(*names, "sequence_id", F.col("shift").alias("offset"))
    return packed.unionByName(placed)


def merge_tree(items: DataFrame, capacity: int, least: int | None = None) -> DataFrame:
    """All items (bin, fill, part) packed up the tree: bin, sequence_id, shift.

    A bin with ``least`` tokens is final at any node, at the root every bin is.
    """
    least = capacity if least is None else least
    nth = F.row_number().over(Window.partitionBy("part", "fill").orderBy("bin")) - 1
    counts = common.materialise(items.groupBy("part", F.col("fill").cast("long").alias("fill")).agg(F.count("*").alias("n")), "pack-counts")
    top = counts.agg(F.max("part")).first()[0]
    if top is None:
        return items.select("bin", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("shift"))
    # items of a part and length by rank: those from ``low`` on are not final yet, and have ``rank + moved`` in the node
    open_ = counts.select("part", "fill", "n", F.col("part").cast("long").alias("node"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("moved"))
    level, below, routes, finals = 0, counts.select(F.col("part").cast("long").alias("node"), "fill", "n"), None, None
    while level == 0 or top > 0:
        level, top = level + 1, top // FAN
        grouped_ = below.select(F.floor(F.col("node") / FAN).alias("node"), F.col("node").alias("child"), "fill", "n")
        merged = common.materialise(grouped_.groupBy("node").applyInArrow(_merge(capacity, least if top else 0), _MERGED), f"pack-level-{level}")
        below = merged.where("kind = 'up'").select("node", "fill", "n")
        # by the numbers of nodes: a bin's number is unlike those of other nodes and of partitions
        bins = (F.lit(PLANNED) + F.shiftleft(F.lit(level).cast("long"), 56) + F.shiftleft("node", 32) + F.col("first")).alias("first")
        final = merged.where("kind = 'final'").select(F.lit(level).alias("level"), "node", "fill", "start", "n", "each", bins, "shift")
        to = merged.where("kind = 'child'").select(F.col("child").alias("node"), "fill", F.col("node").alias("parent"), "start", F.col("n").alias("final"))
        moved = F.col("moved") + F.col("start")
        met = open_.join(to, ["node", "fill"]).select("part", "fill", "n", F.col("parent").alias("node"), "low", moved.alias("moved"), "final", F.least("n", F.col("final") - moved).alias("until"))
        met = common.materialise(met, f"pack-met-{level}")
        route = met.where("until > low").select("part", "fill", F.lit(level).alias("level"), "node", "low", "until", "moved")
        open_ = met.where("until < n").select("part", "fill", "n", "node", F.greatest("low", "until").alias("low"), (F.col("moved") - F.col("final")).alias("moved"))
        routes, finals = (route, final) if routes is None else (routes.unionByName(route), finals.unionByName(final))
    ranked = items.select("bin", "part", F.col("fill").cast("long").alias("fill"), nth.cast("long").alias("nth"))
    routed = ranked.join(routes, ["part", "fill"]).where("nth >= low AND nth < until")
    routed = routed.select("bin", "fill", "level", "node", (F.col("nth") + F.col("moved")).alias("rank")).withColumn("chunk", F.floor(F.col("rank") / CHUNK))
    chunks = F.explode(F.sequence(F.floor(F.col("start") / CHUNK), F.floor((F.col("start") + F.col("n") - 1) / CHUNK))).alias("chunk")
    placed = routed.join(finals.select("*", chunks), ["level", "node", "fill", "chunk"]).where("rank >= start AND rank < start + n")
    at = F.col("rank") - F.col("start")
    sequence = (F.col("first") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id")
    return common.materialise(placed.select("bin", sequence, (F.col("shift") + at % F.col("each") * F.col("fill")).cast("long").alias("shift")), "pack-plan")
