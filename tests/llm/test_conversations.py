import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from seamline.llm import conversations as c

DDL = "conv_id long, turn long, role string, text string, piece string, same int, fault string, first int, cost string, open int"


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of rows in order, by plain search."""
    seen, faults = set(), []
    for _, role, text in rows:
        strip = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not strip else "duplicate" if (role, text) in seen else "truncated" if strip[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, tail, inserted=0):
        """Cheapest, then least edits from row i on; ``tail``: initials so far, shortened."""
        options = []
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", tail):
            options.append((0, "", ()))

        def go(cost, letter, i, tail, line, inserted=0):
            if re.fullmatch("(s|s?(ua)*u?)", tail):
                more = best(i, re.sub("(ua)+", "ua", tail), inserted)
                if more:
                    options.append((cost + more[0], letter + more[1], line + more[2]))

        if inserted < 3:
            for role in ("user", "assistant"):
                go(5, "I", i, tail + role[0], (role + ":",), inserted + 1)
        if i < len(rows):
            _, role, text = rows[i]
            more = 5 if faults[i] == "truncated" else 0
            go(2, "D", i + 1, tail, ())
            if faults[i] not in ("blank", "duplicate"):
                if role[:1] in tuple("sua"):
                    go(more, "K", i + 1, tail + role[0], (role + ":" + text,))
                for new in ("user", "assistant"):
                    go(1 + more, "R", i + 1, tail + new[0], (new + ":" + text,))
        return min(options, default=None)

    cost, audit, lines = best(0, "")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def harm(rows):
    """Conversations after damage: {conv_id: rows in order}."""
    found = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            found[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in found.items()}


def made(n, seed, turns=9):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, turns)):
            role = r.choice(["user", "assistant"] * 3 + ["system", "tool", "", None])
            rows.append((conv, r.choice([turn] * 8 + [turn + 2, None]), role, r.choice(["Yes.", "No", "Why?", " ", "", None, f"é{turn}!\n", "x" * 300 + "."])))
    return rows


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "p", 1, "f", 2, "c", 3) for r in rows], DDL).repartition(3)
    return {r[0]: tuple(r)[1:] for r in (c.repair(c.damaged(df), **more) if more else c.repair_damaged(df)).collect()}


def test_equals_brute_force(spark):
    rows = made(250, 1) + [(None, t, "user", "Hi.") for t in range(5)] + [(None, None, None, None)]
    rows += [(1000, t, "assistant" if t % 2 else "user", f"{t}.") for t in range(8)] * 2
    got = run(spark, rows)
    want = {k: brute(v) for k, v in harm(rows).items()}
    assert got == want


def test_conversations_in_many_pieces(spark):
    rows = made(12, 5, turns=30)
    r = random.Random(3)
    rows += [(500, t, r.choice(["user", "assistant", "system"]), r.choice([f"{t}.", f"{t}", "Same."])) for t in range(120)]
    want = {k: brute(v) for k, v in harm(rows).items()}
    for bounds in ({"piece_rows": 3}, {"piece_rows": 1}, {"piece_bytes": 40}):
        assert run(spark, rows, **bounds) == {k: v for k, v in want.items() if harm(rows)[k]}


def test_dropped_rows_and_no_rows(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(spark, []) == {}


def test_long_text(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", "word " * 100_000 + f"{t}.") for t in range(4)]
    assert run(spark, rows) == {7: brute(harm(rows)[7])}


def test_states_stay_few():
    # the table grows with what is met, not with rows
    automaton, r = c.Repairer(), random.Random(0)
    rows = bytes(c.symbol(r.choice(["s", "u", "a", "t"]), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(200_000))
    automaton.scan(rows, automaton.end)
    few = len(automaton.vectors)
    automaton.scan(bytes(reversed(rows)), automaton.end)
    assert few < 200 and len(automaton.vectors) < few + 50
    automaton.between(rows)
    assert len(automaton.vectors) < 800


@pytest.mark.parametrize("seed", range(3))
def test_trace_costs_what_the_scan_says(seed):
    r = random.Random(seed)
    automaton = c.Repairer()
    for _ in range(300):
        rows = [(t, r.choice(["user", "assistant", "system", "x"]), r.choice([f"{t}.", f"{t}", " ", "Same."])) for t in range(r.randint(0, 8))]
        want = brute(rows)
        seen, faults = set(), []
        for _, role, text in rows:
            faults.append(1 if text == " " else 2 if (role, text) in seen else 0 if text.endswith(".") else 3)
            seen.add((role, text))
        symbols = bytes(c.symbol(role, f) for (_, role, _), f in zip(rows, faults))
        path, total = automaton.scan(symbols, automaton.end)
        audit, state = automaton.trace(symbols, path, 0)
        assert (total + automaton.vectors[path[-1]][0], audit + automaton.closing(state)) == want[5:7]


def test_registered(spark, small):
    import duckdb

    from seamline.llm.queries import ORACLE_SQL, op12_conversation_repair

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{small}/conversations.parquet')")
    got = op12_conversation_repair(spark, small)
    want = con.execute(ORACLE_SQL["op12_conversation_repair"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())
