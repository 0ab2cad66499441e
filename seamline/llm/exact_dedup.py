"""Exact duplicates by compressed radix (Patricia) tries.

Plan.  Every input partition inserts its texts, as whole byte strings, into a trie of its
own and keeps one owner per different text, so copies collapse before anything is
shuffled (a text that a third of all rows share leaves each partition once).  Owners are
dealt by (length, content hash) and inserted into final tries, whose terminal nodes hold
the smallest and largest identifier and the count.  Members then fetch the verdict of
their local owner by an even join on the owner's key.  A final trie over its memory
budget spills heavy subtrees to the task's temporary folder (read by that task alone, so a
lost executor only redoes the task) and finishes them later.

Cases.  Null text counts as empty text.  Empty and very long texts are texts like others.
Null doc_id sorts below every identifier; a group of only null identifiers keeps null.
Repeated rows (same doc_id and text) are rows of one group and share the verdict.  Extra
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text that one trie may hold before it flushes (local) or spills (final).
TRIE_BYTES = 96 << 20
#: Rough cost of a node besides its label.
NODE_COST = 240


class Entry:
    """What a terminal node knows of its text."""

    __slots__ = ("smallest", "largest", "count", "owners")

    def __init__(self, smallest, largest, count, owners):
        self.smallest, self.largest, self.count, self.owners = smallest, largest, count, owners

    def absorb(self, other: Entry) -> None:
        if other.smallest is not None:
            self.smallest = other.smallest if self.smallest is None else min(self.smallest, other.smallest)
            self.largest = other.largest if self.largest is None else max(self.largest, other.largest)
        self.count += other.count
        self.owners += other.owners


class Node:
    __slots__ = ("label", "children", "entry", "file")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.entry: Entry | None = None
        self.file: str | None = None  # path of a spill file: all texts that reach this node are there


def shared_length(label: bytes, data: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``data[at:]``, by halving memcmp."""
    low, high = 0, min(len(label), len(data) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == data[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def joined(link: tuple | None) -> bytes:
    """The bytes of a path of labels, given from its end."""
    parts = []
    while link is not None:
        link, label = link
        parts.append(label)
    return b"".join(reversed(parts))


class Spills:
    """Files of (suffix, entry) records in a temporary folder, few of them open at a time."""

    OPEN = 32

    def __init__(self):
        self.folder = tempfile.TemporaryDirectory(prefix="trie-")
        self.handles: OrderedDict[str, BinaryIO] = OrderedDict()
        self.files = 0

    def new(self) -> str:
        self.files += 1
        return os.path.join(self.folder.name, str(self.files))

    def put(self, path: str, suffix: bytes, entry: Entry) -> None:
        handle = self.handles.pop(path, None) or open(path, "ab")
        self.handles[path] = handle
        if len(self.handles) > self.OPEN:
            self.handles.popitem(last=False)[1].close()
        pickle.dump((suffix, entry.smallest, entry.largest, entry.count, entry.owners), handle)

    def records(self, path: str) -> Iterator[tuple[bytes, Entry]]:
        handle = self.handles.pop(path, None)
        if handle is not None:
            handle.close()
        with open(path, "rb") as file:
            while True:
                try:
                    suffix, *rest = pickle.load(file)
                except EOFError:
                    return
                yield suffix, Entry(*rest)

    def drop(self, path: str) -> None:
        handle = self.handles.pop(path, None)
        if handle is not None:
            handle.close()
        os.unlink(path)


class RadixTrie:
    """A compressed trie over byte strings, with spill by subtree.

    A spilled node keeps one byte of its label; what lies below it is read back when the
    texts in memory are done, first what all its texts have in common, then the rest by a
    trie of its own, which may spill again.  Such tries divide the texts of their file at
    least in two, and a file of one text needs none, so texts may be longer than the budget.
    """

    def __init__(self, budget: int = TRIE_BYTES, spill: bool = True, spills: Spills | None = None):
        self.root, self.held, self.budget, self.spill, self.spills = Node(b""), 0, budget, spill, spills

    @property
    def files(self) -> int:
        return self.spills.files if self.spills else 0

    def insert(self, data: bytes, entry: Entry) -> Entry | None:
        """Add a text; returns its terminal entry, or None if it went to a spill file."""
        node, at = self.root, 0
        while True:
            if node.file is not None:
                self.spills.put(node.file, data[at:], entry)
                return None
            if at == len(data):
                break
            child = node.children.get(data[at])
            if child is None:
                node.children[data[at]] = child = Node(data[at:])
                self.held += len(child.label) + NODE_COST
                node, at = child, len(data)
                continue
            if not data.startswith(child.label, at):
                n = shared_length(child.label, data, at)
                middle = Node(child.label[:n])
                node.children[data[at]] = middle
                child.label = child.label[n:]
                middle.children[child.label[0]] = child
                self.held += NODE_COST
                child = middle
            node, at = child, at + len(child.label)
        if node.entry is None:
            node.entry = entry
        else:
            node.entry.absorb(entry)
        found = node.entry
        if self.spill and self.held > self.budget:
            self._spill()
        return found

    def _weights(self) -> dict[int, int]:
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children.values())
        weight: dict[int, int] = {}
        for node in reversed(order):
            weight[id(node)] = len(node.label) + NODE_COST + sum(weight[id(c)] for c in node.children.values())
        return weight

    def _spill(self) -> None:
        """Spill heavy subtrees until half of the budget is free, or nothing is left to spill."""
        while self.held > self.budget // 2 and self._spill_heaviest():
            pass

    def _spill_heaviest(self) -> bool:
        weight, node, above = self._weights(), self.root, self.root
        while True:
            below = [c for c in node.children.values() if c.file is None]
            if not below:
                break
            above, node = node, max(below, key=lambda c: weight[id(c)])
            if weight[id(node)] <= 0.6 * self.held:
                if weight[id(node)] < 0.1 * self.held and above is not self.root:
                    node = above  # many small ones: all of them
                break
        if node is self.root:
            return False
        self.spills = self.spills or Spills()
        path = self.spills.new()
        for suffix, entry in self._walk(node, None, moved := []):
            self.spills.put(path, suffix[1:], entry)
        # what a part of this subtree spilled before moves into the new file
        for link, old in moved:
            prefix = joined(link)[1:]
            for suffix, entry in self.spills.records(old):
                self.spills.put(path, prefix + suffix, entry)
            self.spills.drop(old)
        self.held -= weight[id(node)] - NODE_COST - 1
        node.label, node.children, node.entry, node.file = node.label[:1], {}, None, path
        return True

    @staticmethod
    def _walk(top: Node, link: tuple | None, spilled: list) -> Iterator[tuple[bytes, Entry]]:
        """Texts below ``link`` with their entries; spilled nodes are listed as (path of labels, file)."""
        stack = [(top, link)]
        while stack:
            node, above = stack.pop()
            here = (above, node.label)
            if node.file is not None:
                spilled.append((here, node.file))
            if node.entry is not None:
                yield joined(here), node.entry
            stack.extend((c, here) for c in node.children.values())

    def items(self) -> Iterator[tuple[bytes, Entry]]:
        """All texts with their entries; spilled subtrees follow, file by file."""
        pending: list[tuple] = []
        yield from self._walk(self.root, None, pending)
        self.root, self.held = Node(b""), 0
        while pending:
            link, path = pending.pop()
            records = self.spills.records(path)
            first, merged = next(records)
            common_, alone = len(first), True
            for suffix, entry in records:
                common_ = min(common_, shared_length(first, suffix, 0))
                alone = alone and common_ == len(first) == len(suffix)
                if alone:
                    merged.absorb(entry)
            if alone:
                yield joined((link, first)), merged
            else:
                below, link = RadixTrie(self.budget, self.spill, self.spills), (link, first[:common_])
                for suffix, entry in self.spills.records(path):
                    below.insert(suffix[common_:], entry)
                yield from self._walk(below.root, link, pending)
            self.spills.drop(path)


_LOCAL = pa.schema([("doc_id", pa.int64()), ("owner", pa.int64()), ("body", pa.binary()), ("smallest", pa.int64()), ("largest", pa.int64()), ("copies", pa.int64())])
_LOCAL_DDL = "doc_id long, owner long, body binary, smallest long, largest long, copies long"


def _local_owners(budget: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_owner = TaskContext.get().partitionId() << 40
        trie = RadixTrie(budget, spill=False)

        def owners(full: RadixTrie) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            size = 0
            for body, e in full.items():
                rows.append((None, e.owners[0], body, e.smallest, e.largest, e.count))
                size += len(body)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _LOCAL.types)], schema=_LOCAL)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _LOCAL.types)], schema=_LOCAL)

        for batch in batches:
            ids, owned = batch.column(0), []
            for doc_id, body in zip(ids.to_pylist(), batch.column(1)):
                entry = trie.insert(body.as_py(), Entry(doc_id, doc_id, 1, []))
                if not entry.owners:
                    entry.owners = [next_owner]
                    next_owner += 1
                owned.append(entry.owners[0])
            none = pa.nulls(len(owned), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(owned, pa.int64()), pa.nulls(len(owned), pa.binary()), none, none, none], schema=_LOCAL)
            if trie.held > budget:
                yield from owners(trie)
                trie = RadixTrie(budget, spill=False)
        yield from owners(trie)

    return run


_FINAL = pa.schema([("owner", pa.int64()), ("smallest", pa.int64()), ("largest", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])
_FINAL_DDL = "owner long, smallest_id long, largest_id long, group_size long, text_sha256 string"


def _final_groups(budget: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(budget)
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4)]
            for owner, smallest, largest, copies, body in zip(*columns, batch.column(1)):
                trie.insert(body.as_py(), Entry(smallest, largest, copies, [owner]))
        rows: list[tuple] = []
        for body, e in trie.items():
            sha = hashlib.sha256(body).hexdigest()
            rows.extend((owner, e.smallest, e.largest, e.count, sha) for owner in e.owners)
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FINAL.types)], schema=_FINAL)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FINAL.types)], schema=_FINAL)

    return run


def exact_groups(docs: DataFrame, keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its group of equal texts and the owner.

    Returns doc_id, keep_id, group_size, kept, text_sha256, smallest_id, largest_id.
    ``keep`` names the identifier that stays: "largest" or "smallest".
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    spark = docs.sparkSession
    common.prepare(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("body"))
    local = common.materialise(source.mapInArrow(_local_owners(trie_bytes), _LOCAL_DDL), "trie-owners")
    owners = local.where(F.col("body").isNotNull()).select("owner", "body", "smallest", "largest", "copies")
    dealt = owners.repartition(F.octet_length("body"), F.xxhash64("body"))
    groups = dealt.mapInArrow(_final_groups(trie_bytes), _FINAL_DDL)
    members = local.where(F.col("body").isNull()).select("doc_id", "owner")
    joined = members.join(groups, "owner").withColumn("keep_id", F.col(f"{keep}_id"))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "smallest_id", "largest_id")
