"""Cheapest repair of conversations' structure by a lazily determinised weighted automaton.

Rows of a conversation are read by turn and repaired so that their role initials give
``(s?(ua)+)?``: a row is kept, re-roled or deleted, and empty rows are inserted, each at
its cost; blank and repeated rows must go, truncated ones cost extra while they stay.

The weighted automaton has four states (nothing yet, after s, after u, after a).  Rows are
scanned from the last to the first.  What is known at a place is the cost to the end from
each state; less their least, these costs are a state of the determinised automaton.  There
are few of them, as an insertion leads from any state to another, so each is made once, when
first met, and kept with its steps in a transition table: the scan looks up one cell a row
and adds up what was subtracted.  The scan ends with the cost.  The trace goes back over
the scanned rows, against the scan, along tight arcs, those that lose nothing, and of
several tight ones takes the ASCII-least letter; as that is the order of reading, the edits
are the least of the cheapest.

A conversation is cut into pieces of bounded rows and bytes, dealt by range over its turns,
so one that holds a third of all rows is many tasks' work.  What lies in one piece is solved
there.  For others each piece gives its costs from any state to any state; one row per piece
and conversation is put together to the costs at the pieces' ends, each piece is then traced
from all four states, and the path through the pieces picks one.  Only SHA-256, which has no
parts, reads a conversation's texts in a row: as a stream, a piece at a time.

Cases.  A null role or text counts as one space; a null conv_id or turn is one space in the
hash that chooses the damage, null conv_ids are one conversation, and null turns come first.  Rows of one turn are
ordered by role and text (their first 256 characters, then a hash), so results don't depend
on the input's order.  Repeated rows are rows; the later are duplicates.  Empty texts are
blank.  Very long texts are one piece each.  Extra columns are ignored.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Costs of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Bounds of a piece.
PIECE_ROWS, PIECE_BYTES = 1024, 256 << 10
#: Leading characters that order rows of one turn.
LEADING = 256
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
INFINITE = 1 << 60

_NOTHING, _AFTER_S, _AFTER_U, _AFTER_A = range(4)
_ROLES = "sua"
#: Where a kept row of an initial leads, by state.
_KEEP = {("s", _NOTHING): _AFTER_S, ("u", _NOTHING): _AFTER_U, ("u", _AFTER_S): _AFTER_U, ("u", _AFTER_A): _AFTER_U, ("a", _AFTER_U): _AFTER_A}
#: Where a re-roled or inserted row leads: a user, or the assistant after a user.
_NEW = (_AFTER_U, _AFTER_U, _AFTER_A, _AFTER_U)


def symbol(role: str, fault: int) -> int:
    """What the automaton sees of a row: its initial and how it may be edited."""
    return 4 * (_ROLES.find(role[:1]) if role else -1) + fault + 4


def _closed(costs: list[int]) -> list[int]:
    """Costs to the end where insertions may come first; two in a row are all that can pay."""
    nothing, s, u, a = costs
    new_u, new_a = min(u, INSERT + a), min(a, INSERT + u)
    return [min(nothing, INSERT + new_u), min(s, INSERT + new_u), new_u, new_a]


class Repairer:
    """The determinised automaton, its states and table made as they are met."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.vectors: list[tuple] = []
        self.table: list[list[tuple[int, int] | None]] = []
        self.moves: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end = self.number(_closed([0, INFINITE, INFINITE, 0]))[0]

    def number(self, costs: Iterable[int]) -> tuple[int, int]:
        """The state of a cost vector, and what its least cost is."""
        costs = list(costs)
        least = min(costs)
        vector = tuple(c - least if c < INFINITE else INFINITE for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * 16)
        return self.numbers[vector], least

    def _arcs(self, state: int, seen: int) -> list[tuple[str, int, int]]:
        """(letter, next state, cost) of a row, letters in ASCII order."""
        initial, fault = (_ROLES[seen // 4 - 1] if seen >= 4 else ""), seen % 4
        found = [("D", state, DELETE)]
        if fault in (FINE, CUT_OFF):
            more = TRUNCATED if fault == CUT_OFF else 0
            if (initial, state) in _KEEP:
                found.append(("K", _KEEP[initial, state], more))
            found.append(("R", _NEW[state], REROLE + more))
        return found

    def _before(self, after: int, seen: int) -> list[int]:
        ahead = self.vectors[after]
        return _closed([min(INFINITE, *(cost + ahead[to] for _, to, cost in self._arcs(state, seen))) for state in range(4)])

    def scan(self, symbols: bytes, end: int) -> tuple[list[int], int]:
        """States before each row and at the end, from the last to the first; and the cost taken off."""
        table, path, total = self.table, [end], 0
        for seen in reversed(symbols):
            cell = table[end][seen]
            if cell is None:
                cell = table[end][seen] = self.number(self._before(end, seen))
            end = cell[0]
            total += cell[1]
            path.append(end)
        return path, total

    def _move(self, after: int, seen: int, state: int) -> tuple[str, int]:
        """The least tight edits that consume one row, insertions before it included."""
        costs, ahead, letters = self._before(after, seen), self.vectors[after], ""
        while True:
            tight = [(letter, to, True) for letter, to, cost in self._arcs(state, seen) if costs[state] == cost + ahead[to]]
            if costs[state] == INSERT + costs[_NEW[state]]:
                tight.append(("I", _NEW[state], False))
            letter, state, consumed = min(tight)
            letters += letter
            if consumed:
                return letters, state

    def trace(self, symbols: bytes, path: list[int], state: int) -> tuple[str, int]:
        """Edits from ``state`` on over the scanned rows, and the state after them."""
        moves, letters = self.moves, []
        for seen, after in zip(symbols, reversed(path[:-1])):
            key = (after, seen, state)
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._move(after, seen, state)
            letters.append(move[0])
            state = move[1]
        return "".join(letters), state

    def closing(self, state: int) -> str:
        """Insertions at the very end."""
        return {_NOTHING: "", _AFTER_S: "II", _AFTER_U: "I", _AFTER_A: ""}[state]

    def between(self, symbols: bytes) -> list[int]:
        """Cost from each state before the rows to each state after them, row by row of a matrix."""
        columns = []
        for to in range(4):
            end, _ = self.number([0 if q == to else INFINITE for q in range(4)])
            path, total = self.scan(symbols, end)
            columns.append([c + total if c < INFINITE else INFINITE for c in self.vectors[path[-1]]])
        return [columns[to][q] for q in range(4) for to in range(4)]


def lines(roles: list[str], texts: list[str], audit: str, state: int = _NOTHING) -> Iterator[str]:
    """``role:text`` of the repaired rows; ``audit`` starts in ``state``."""
    row = 0
    for letter in audit:
        if letter == "D":
            row += 1
            continue
        new = _NEW[state]
        if letter == "I":
            yield ("assistant" if new == _AFTER_A else "user") + ":"
        elif letter == "R":
            yield ("assistant" if new == _AFTER_A else "user") + ":" + texts[row]
        else:
            new = _KEEP[roles[row][:1], state]
            yield roles[row] + ":" + texts[row]
        row += letter != "I"
        state = new


_REPAIRER: list[Repairer] = []


def repairer() -> Repairer:
    """The automaton of this worker, with what it has met so far."""
    if not _REPAIRER:
        _REPAIRER.append(Repairer())
    return _REPAIRER[0]


# --- rows and damage ---------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a row's hash chooses."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    harm = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    clean = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return clean.where("harm != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Add ``row`` (unique), ``same`` (hash of conversation, role and text) and ``fault``, a row's first."""
    shown = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    same = F.unhex(F.sha2(F.concat_ws(":", F.length(shown), shown, F.length("role"), "role", "text"), 256))
    rows = rows.withColumn("same", same).withColumn("row", F.monotonically_increasing_id())
    rows = common.materialise(rows.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")), "conversation-rows")
    first = F.min(F.struct("turn", "row"))["row"].alias("first")  # null turns come first
    repeats = rows.where(~F.col("blank")).groupBy("same").agg(F.count("*").alias("n"), first)
    # written before it is joined, so that adaptive execution can split what many rows repeat
    repeats = common.materialise(repeats.where("n > 1").select("same", "first"), "conversation-repeats")
    joined = rows.join(repeats.hint("merge"), "same", "left")
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(F.col("first").isNotNull() & (F.col("first") != F.col("row")), DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT_OFF)
        .otherwise(FINE)
    )
    return joined.select("conv_id", "turn", "role", "text", "same", "row", fault.cast("int").alias("fault"))


# --- pieces ------------------------------------------------------------------

_STATS = ["first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal"]
_LEGAL = {"su", "ua", "au"}


def _piece_ddl(conv: str) -> str:
    return f"conv_id {conv}, piece long, open boolean, symbols binary, first_initial string, last_initial string, {', '.join(s + ' long' for s in _STATS)}, roles array<string>, texts array<string>"


def _cut_pieces(piece_rows: int, piece_bytes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows to pieces; ``open`` where the conversation may have more of them."""
        part = TaskContext.get().partitionId()
        conv_type, number, before = None, 0, 0  # pieces so far; of this conversation, so far
        first_conversation, conv, held, size = True, None, [], 0

        def flush(more: bool) -> pa.RecordBatch:
            nonlocal number
            roles, texts = [r[2] for r in held], [r[3] for r in held]
            turns = [r[1] for r in held if r[1] is not None]
            faults = [r[4] for r in held]
            initials = [r[:1] for r in roles]
            stats = [turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT_OFF), sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))]
            symbols = bytes(symbol(r, f) for r, f in zip(roles, faults))
            values = [conv, (part << 32) + number, more or before > 0 or first_conversation, symbols, initials[0], initials[-1], *stats, roles, texts]
            types = [conv_type, pa.int64(), pa.bool_(), pa.binary(), pa.string(), pa.string(), *[pa.int64()] * len(stats), pa.list_(pa.string()), pa.list_(pa.string())]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[str(i) for i in range(len(values))])

        for batch in batches:
            conv_type = batch.schema.types[0]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != conv:
                    yield flush(False)
                    held, size, before, first_conversation = [], 0, 0, False
                elif held and (len(held) >= piece_rows or size + len(row[3]) > piece_bytes):
                    yield flush(True)
                    held, size, before = [], 0, before + 1
                conv = row[0]
                held.append(row)
                size += len(row[3])
        if held:
            yield flush(True)  # the last conversation may go on in the next partition

    return run


def pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Conversations of ``rows`` (as ``with_faults`` gives them) in pieces, numbered in order."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, LEADING), F.substring("text", 1, LEADING), F.col("same"), F.col("row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ddl = _piece_ddl(rows.schema["conv_id"].dataType.simpleString())
    return common.materialise(dealt.select("conv_id", "turn", "role", "text", "fault").mapInArrow(_cut_pieces(piece_rows, piece_bytes), ddl), "conversation-pieces")


def _whole(parts: list[dict]) -> dict:
    """Counts of a conversation from those of its pieces, in order."""
    found = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
    found["illegal"] += sum(a["last_initial"] + b["first_initial"] not in _LEGAL for a, b in zip(parts, parts[1:]))
    timed = [p for p in parts if p["first_turn"] is not None]
    shared = sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:]))
    found["gaps"] = timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - sum(p["turns"] for p in timed) + shared if timed else 0
    return found


_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _result_ddl(conv: str) -> str:
    return f"conv_id {conv}, {', '.join(c + ' long' for c in _RESULT)}, audit string, repaired_sha256 string"


def _results(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    types = [conv_type, *[pa.int64()] * len(_RESULT), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["conv_id", *_RESULT, "audit", "repaired_sha256"])


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one piece: scan, trace, hash."""
    automaton = repairer()
    for batch in batches:
        rows = []
        for piece in batch.to_pylist():
            path, total = automaton.scan(piece["symbols"], automaton.end)
            audit, state = automaton.trace(piece["symbols"], path, _NOTHING)
            audit += automaton.closing(state)
            text = "\n".join(lines(piece["roles"], piece["texts"], audit))
            stats = _whole([piece]) | {"cost": total + automaton.vectors[path[-1]][_NOTHING]}
            rows.append((piece["conv_id"], *(stats[k] for k in _RESULT), audit, hashlib.sha256(text.encode()).hexdigest()))
        if rows:
            yield _results(rows, batch.schema.types[0])


def _solve_long(found: DataFrame, conv: str) -> DataFrame:
    """Conversations of several pieces: matrices, costs at their ends, traces, then the hash as a stream."""
    light = ["conv_id", "piece", "symbols", "first_initial", "last_initial", *_STATS]

    def matrices(batches):
        automaton = repairer()
        for batch in batches:
            between = [automaton.between(s) for s in batch.column("symbols").to_pylist()]
            yield batch.drop_columns(["symbols"]).append_column("between", pa.array(between, pa.list_(pa.int64())))

    def ends(group: pa.Table) -> pa.Table:
        """Costs to the end of the conversation at each piece's end, and the conversation's counts."""
        parts = group.sort_by("piece").to_pylist()
        costs, at_ends = _closed([0, INFINITE, INFINITE, 0]), []
        for part in reversed(parts):
            at_ends.append(costs)
            costs = [min(INFINITE, *(part["between"][4 * q + to] + costs[to] for to in range(4))) for q in range(4)]
        stats = _whole(parts) | {"cost": costs[_NOTHING]}
        columns = {"at_piece": pa.array([p["piece"] for p in parts], pa.int64()), "ahead": pa.array(at_ends[::-1], pa.list_(pa.int64())), "last": pa.array([p is parts[-1] for p in parts])}
        return pa.table(columns | {k: pa.array([stats[k]] * len(parts), pa.int64()) for k in _RESULT})

    def traces(batches):
        """Edits of each piece from each of the four states, and where they lead."""
        automaton = repairer()
        for batch in batches:
            audits, states = [], []
            for symbols, ahead, last in zip(*(batch.column(c).to_pylist() for c in ("symbols", "ahead", "last"))):
                path, _ = automaton.scan(symbols, automaton.number(ahead)[0])
                found = [automaton.trace(symbols, path, q) for q in range(4)]
                audits.append([a + (automaton.closing(q) if last else "") for a, q in found])
                states.append([q for _, q in found])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at_piece"), pa.array(audits, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int64()))], names=["conv_id", "at_piece", "audits", "states"])

    def paths(group: pa.Table) -> pa.Table:
        """The state before each piece on the path through all."""
        at, state = [], _NOTHING
        group = group.sort_by("at_piece")
        for states in group["states"].to_pylist():
            at.append(state)
            state = states[state]
        return pa.table({"of_piece": group["at_piece"], "state": pa.array(at, pa.int64())})

    def hashes(batches):
        """Pieces sorted by conversation and number: one result each time a conversation ends."""
        kept, digest, conv_type = None, None, None
        done: list[str] = []

        def finish():
            return _results([(kept["conv_id"], *(kept[k] for k in _RESULT), "".join(done), digest.hexdigest())], conv_type)

        for batch in batches:
            conv_type = batch.schema.types[0]
            for piece in batch.to_pylist():
                if kept is not None and kept["conv_id"] != piece["conv_id"]:
                    yield finish()
                    kept = None
                if kept is None:
                    digest, done, empty = hashlib.sha256(), [], True
                kept = piece
                for line in lines(piece["roles"], piece["texts"], piece["audit"], piece["state"]):
                    digest.update((line if empty else "\n" + line).encode())
                    empty = False
                done.append(piece["audit"])
        if kept is not None:
            yield finish()

    summary = found.select(*light).mapInArrow(matrices, f"conv_id {conv}, piece long, first_initial string, last_initial string, {', '.join(s + ' long' for s in _STATS)}, between array<long>")
    ahead = summary.groupBy("conv_id").applyInArrow(ends, f"at_piece long, ahead array<long>, last boolean, {', '.join(c + ' long' for c in _RESULT)}")
    ahead = common.materialise(ahead, "conversation-ahead")
    traced = found.select("conv_id", "piece", "symbols").join(ahead.hint("merge"), F.col("piece") == F.col("at_piece"))
    traced = traced.select("conv_id", "at_piece", "symbols", "ahead", "last").mapInArrow(traces, f"conv_id {conv}, at_piece long, audits array<string>, states array<long>")
    traced = common.materialise(traced, "conversation-traces")
    through = traced.select("conv_id", "at_piece", "states").groupBy("conv_id").applyInArrow(paths, "of_piece long, state long")
    through = common.materialise(through, "conversation-paths")
    chosen = traced.join(through.hint("merge"), F.col("at_piece") == F.col("of_piece")).select("of_piece", "state", F.element_at("audits", (F.col("state") + 1).cast("int")).alias("audit"))
    whole = found.select("conv_id", "piece", "roles", "texts").join(ahead.hint("merge"), F.col("piece") == F.col("at_piece")).join(chosen.hint("merge"), F.col("piece") == F.col("of_piece"))
    whole = whole.select("conv_id", "piece", "roles", "texts", *_RESULT, "audit", "state")
    return whole.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(hashes, _result_ddl(conv))


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Cheapest repair of ``rows`` (conv_id, turn, role, text), one row per conversation.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    common.prepare(rows.sparkSession)
    conv = rows.schema["conv_id"].dataType.simpleString()
    found = pieces(with_faults(rows), piece_rows, piece_bytes)
    short = found.where(~F.col("open")).mapInArrow(_solve, _result_ddl(conv))
    return short.unionByName(_solve_long(found.where("open"), conv))


def repair_damaged(rows: DataFrame) -> DataFrame:
    """``repair`` after ``damaged``; conversations without a row left give zeros."""
    repaired = common.materialise(repair(damaged(rows)), "conversations-repaired").withColumnRenamed("conv_id", "of_conv")
    every = rows.select("conv_id").distinct()
    joined = every.join(repaired.hint("merge"), F.col("conv_id").eqNullSafe(F.col("of_conv")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _RESULT), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def _oracle() -> str:
    """The same in SQL: the cheapest, then least, edits to the end from each state, from the last row to the first."""

    def edit(letter: str, cost: str, state: int, line: str) -> str:
        return f"struct_pack(c := h{state}.c + {cost}, a := '{letter}' || h{state}.a, t := {line} || h{state}.t)"

    def kept(state: int) -> list[str]:
        return [f"CASE WHEN NOT gone AND initial = '{i}' THEN " + edit("K", "more", to, "chr(10) || role || ':' || text") + " END" for (i, at), to in _KEEP.items() if at == state]

    def new(state: int) -> str:
        return "assistant" if _NEW[state] == _AFTER_A else "user"

    def rows(state: int) -> str:
        again = f"CASE WHEN NOT gone THEN {edit('R', f'more + {REROLE}', _NEW[state], f"chr(10) || '{new(state)}:' || text")} END"
        return f"list_min([{', '.join([edit('D', str(DELETE), state, chr(39) * 2), *kept(state), again])}])"

    def inserted(state: int, of: str) -> str:
        return f"struct_pack(c := {of}.c + {INSERT}, a := 'I' || {of}.a, t := chr(10) || '{new(state)}:' || {of}.t)"

    end = ["struct_pack(c := 0, a := '', t := '')", f"struct_pack(c := {2 * INSERT}, a := 'II', t := chr(10) || 'user:' || chr(10) || 'assistant:')", f"struct_pack(c := {INSERT}, a := 'I', t := chr(10) || 'assistant:')", "struct_pack(c := 0, a := '', t := '')"]
    return rf"""
    WITH RECURSIVE hashed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(4294967295, list_reduce(
                   list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                   lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))
               )) % 20 AS harm
        FROM conversations
    ), harmed AS (
        SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
               CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE harm WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM hashed WHERE harm <> 0
    ), numbered AS (
        SELECT *, left(role, 1) AS initial,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
        FROM harmed
    ), faulty AS (
        SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair,
               CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault
        FROM numbered
    ), counted AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
               count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM faulty GROUP BY conv_id
    ), walk AS (
        SELECT conv_id, n + 1 AS i, {', '.join(f'{e} AS h{q}' for q, e in enumerate(end))} FROM counted
        UNION ALL
        SELECT conv_id, i, list_min([b0, {inserted(0, 'n2')}]), list_min([b1, {inserted(1, 'n2')}]), n2, list_min([b3, {inserted(3, 'b2')}])
        FROM (
            SELECT *, list_min([b2, {inserted(2, 'b3')}]) AS n2
            FROM (
                SELECT f.conv_id, f.i, {', '.join(f'{rows(q)} AS b{q}' for q in range(4))}
                FROM walk w JOIN (SELECT *, fault IN (1, 2) AS gone, CASE fault WHEN 3 THEN {TRUNCATED} ELSE 0 END AS more FROM faulty) f
                  ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i - 1
            )
        )
    )
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, CAST(coalesce(h0.c, 0) AS BIGINT) AS cost, coalesce(h0.a, '') AS audit, sha256(coalesce(h0.t[2:], '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) e
    LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
    LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM e.conv_id AND w.i = 1
    """


ORACLE_SQL = _oracle()
