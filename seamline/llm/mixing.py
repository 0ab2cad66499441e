"""Mixing overlapping sources to target weights by minimum-cost flow.

1. Documents are aggregated by membership pattern (the set of sources they belong to).
2. A minimum-cost flow routes tokens: pattern -> source quota.  A pattern offers its tokens
   once for every allowed repetition, each repetition dearer than the one before (convex
   costs), so repeats are used only where first copies can't fill a quota.
3. Each pattern's flow is turned into documents: all of them taken floor(flow / size)
   times, and one more copy of those that come first in a seeded order.  The order's
   cut-off is found by histograms of hash buckets, refined in the one bucket that the
   cut-off falls into, so no source is ever gathered or sorted in one task.  What the
   cut-off leaves open goes to the largest remaining document that fits, or the one that
   exceeds it least.

Only patterns, quotas and histogram cut-offs (their number is that of patterns, not of
documents: some hundreds of bytes each) reach the driver; tables made from them are
broadcast up to ``BROADCAST_ROWS`` rows only.

Cases.  Null text has size 0 (as empty text has) and is taken 0 words.  A null source is a
source of its own, last in order.  Repeated rows count and are taken as rows of their own,
alike.  Very long texts count whole.  Extra columns are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Rows of driver-made tables up to which they are broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 20_000
REPEATS = 3
#: Bits of the seeded hash that one histogram resolves, and how many histograms refine it.
LEVEL_BITS, LEVELS = 10, 5
HASH_BITS = 60
#: Share of a pattern's remainder that may stay open, and how many single documents fill it at most.
MISS, FILLERS = 0.002, 6


def targets(sizes: Sequence[int], weights: Sequence[float], total: float | None = None, most: float = REPEATS) -> list[float]:
    """Share ``total`` (all sizes if None) by weight; none above ``most`` times its size."""
    left = float(sum(sizes) if total is None else total)
    result, open_ = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0]
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in full or open_:
            result[i] = float(most * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(result[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return result


def min_cost_flow(patterns: Sequence[tuple[Sequence[int], int]], quotas: Sequence[int], repeats: int = REPEATS) -> dict[tuple[int, int], int]:
    """Tokens routed from pattern i to source s, for (sources, size) patterns and source quotas.

    A pattern offers its size once for each repetition, costing 1, 3, 5, ...; all else is
    free.  So a path costs what its first arc costs, cheapest paths first means one
    repetition after the other, and each of these rounds is a maximum flow from what is
    routed already, by blocking flows (pattern -> source, and back where something flows).
    """
    flow: list[dict[int, int]] = [{} for _ in patterns]
    users: list[set[int]] = [set() for _ in quotas]  # patterns that flow into a source
    left = [int(q) for q in quotas]
    wants = [[s for s in dict.fromkeys(sources)] for sources, _ in patterns]
    supply = [0] * len(patterns)
    for _ in range(repeats):
        for i, (_, size) in enumerate(patterns):
            supply[i] += int(size)
        while _blocking_flow(wants, supply, left, flow, users):
            pass
    return {(i, s): amount for i, routed in enumerate(flow) for s, amount in routed.items() if amount > 0}


def _blocking_flow(wants, supply, left, flow, users) -> int:
    """Route along shortest paths until none of their length is left; returns what was routed."""
    level_p, level_s = {i: 0 for i, n in enumerate(supply) if n > 0 and wants[i]}, {}
    front, depth, open_ = list(level_p), 0, False
    while front and not open_:  # patterns and sources by turns
        reached = []
        for i in front:
            for s in wants[i]:
                if s not in level_s:
                    level_s[s] = depth + 1
                    reached.append(s)
                    open_ = open_ or left[s] > 0
        front = []
        if not open_:
            for s in reached:
                for i in users[s]:
                    if i not in level_p:
                        level_p[i] = depth + 2
                        front.append(i)
        depth += 2
    if not open_:
        return 0
    routed, next_s = 0, {i: 0 for i in level_p}
    next_p: dict[int, list[int]] = {s: list(users[s]) for s in level_s}
    for start in [i for i, d in level_p.items() if d == 0]:
        path = [start]  # pattern, source, pattern, ..., from the start on
        while path and supply[start] > 0:
            if len(path) % 2:  # at a pattern
                i = path[-1]
                while next_s[i] < len(wants[i]) and level_s.get(wants[i][next_s[i]]) != level_p[i] + 1:
                    next_s[i] += 1
                if next_s[i] < len(wants[i]):
                    path.append(wants[i][next_s[i]])
                else:
                    path.pop()
                    if path:
                        next_p[path[-1]].pop()  # this pattern leads nowhere any more
                continue
            s = path[-1]
            if left[s] > 0:
                amount = min([supply[start], left[s]] + [flow[path[k + 1]][path[k]] for k in range(1, len(path) - 1, 2)])
                for k in range(0, len(path), 2):  # forward into the source; back out of it for the next pattern
                    i, into = path[k], path[k + 1]
                    flow[i][into] = flow[i].get(into, 0) + amount
                    users[into].add(i)
                    if k:
                        before = path[k - 1]
                        flow[i][before] -= amount
                        if not flow[i][before]:
                            users[before].discard(i)
                supply[start] -= amount
                left[s] -= amount
                routed += amount
                path = [start]
                continue
            while next_p[s] and (level_p.get(next_p[s][-1]) != level_s[s] + 1 or not flow[next_p[s][-1]].get(s)):
                next_p[s].pop()
            if next_p[s]:
                path.append(next_p[s][-1])
            else:
                path.pop()
                next_s[path[-1]] += 1
    return routed


def word_count(text: str = "text"):
    """Number of runs of anything but ASCII white space; null: 0."""
    one = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(one, r"[\x20\x09-\x0D]+", "")).cast("long")


def text_hash(text: str = "text"):
    """A hash that tells the texts of one identifier apart; null and empty text are alike."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def mix(docs: DataFrame, members: str = "members", size: str = "size", quotas: dict | None = None, repeats: int = REPEATS, seed: int = 0, also: Sequence[str] = ()) -> DataFrame:
    """Choose documents for source quotas.

    ``docs``: doc_id, an array of source names, a size.  ``quotas``: tokens by source name
    (None is a name).  Returns doc_id, members, size, copies, taken and the columns that
    ``also`` names; one row per row.
    """
    spark = docs.sparkSession
    key = F.to_json(F.struct(F.array_sort(F.array_distinct(F.coalesce(F.col(members), F.array().cast("array<string>")))).alias("p")), {"ignoreNullFields": "false"})
    base = docs.select("doc_id", *also, F.col(members).alias("members"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"), key.alias("pattern"))
    # The seeded order hashes what the row holds, so that a rerun over other partitions agrees.
    base = base.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("pattern")), 64 - HASH_BITS))
    base = common.materialise(base, "mix-sizes")
    found = base.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members")).orderBy("pattern").collect()
    names = sorted({m for r in found for m in (r["members"] or [])}, key=lambda m: (m is None, m or ""))
    place = {m: i for i, m in enumerate(names)}
    wanted = [max(0, round((quotas or {}).get(m, 0))) for m in names]
    patterns = [(sorted({place[m] for m in (r["members"] or [])}), int(r["size"])) for r in found]
    flow = min_cost_flow(patterns, wanted, repeats)
    routed = [0] * len(patterns)
    for (i, _), amount in flow.items():
        routed[i] += amount
    rows = [(r["pattern"], routed[i] // s if s else 0, routed[i] % s if s else 0) for i, (r, (_, s)) in enumerate(zip(found, patterns))]
    plan = common.local_frame(spark, rows, "pattern string, whole long, rest long")
    return select_seeded(base, plan).select("doc_id", *also, "members", "size", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _small(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-made table, to be broadcast if its size allows."""
    frame = common.local_frame(spark, rows, schema)
    return F.broadcast(frame) if len(rows) <= BROADCAST_ROWS else common.materialise(frame, "mix-plan").hint("merge")


def select_seeded(base: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of ``base`` (pattern, size, h) with ``copies``: ``whole``, and one more in seeded order up to ``rest``.

    A pattern's cut-off is a prefix of the hash's bits: each level sums sizes by the next
    bits inside the bucket that the level before left open, and moves the cut-off.
    """
    spark = base.sparkSession
    asked = plan.collect()
    state = {r["pattern"]: [r["whole"], r["rest"], 0] for r in asked}  # whole, what is left to fill, cut-off so far
    span = HASH_BITS
    for _ in range(LEVELS):
        span -= LEVEL_BITS
        opened = [(p, low, rest) for p, (_, rest, low) in state.items() if rest > 0]
        if not opened:
            break
        at = _small(spark, opened, "pattern string, low long, rest long")  # one row a pattern
        inside = base.join(at, "pattern").where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(1 << (span + LEVEL_BITS))))
        summed = inside.groupBy("pattern", "low", "rest", F.shiftright(F.col("h") - F.col("low"), span).alias("bucket")).agg(F.sum("size").alias("size"))
        below = summed.withColumn("upto", F.sum("size").over(W.partitionBy("pattern").orderBy("bucket")))
        fits = F.col("upto") <= F.col("rest")
        closed = below.groupBy("pattern").agg(F.max(F.when(fits, F.col("upto"))).alias("filled"), F.min(F.when(~fits, F.col("bucket"))).alias("next"))
        for r in closed.collect():
            s = state[r["pattern"]]
            s[1] -= r["filled"] or 0
            s[2] += (1 << (span + LEVEL_BITS)) if r["next"] is None else r["next"] << span
    cut = _small(spark, [(p, whole, low, rest) for p, (whole, rest, low) in state.items()], "pattern string, whole long, cut long, rest long")
    chosen = base.join(cut, "pattern").withColumn("copies", F.col("whole") + (F.col("h") < F.col("cut")).cast("long"))
    # What the cut-off leaves open goes to the largest later document that fits, or where none
    # fits to the smallest that exceeds it by less than leaving it open would miss, while a
    # pattern misses more than MISS of its share (a row a pattern).
    share = {r["pattern"]: r["rest"] for r in asked}
    extra: list[tuple] = []
    for _ in range(FILLERS):
        opened = [(p, low, rest) for p, (_, rest, low) in state.items() if rest > MISS * share[p]]
        if not opened:
            break
        at = _small(spark, opened, "pattern string, cut long, rest long")
        used = _small(spark, extra, "pattern string, h long, size long")
        free = base.join(at, "pattern").where((F.col("h") >= F.col("cut")) & (F.col("size") < 2 * F.col("rest")) & (F.col("size") > 0))
        free = free.join(used, ["pattern", "h", "size"], "left_anti")
        best = free.groupBy("pattern", "size", "h").agg(F.sum("size").alias("all"), F.first("rest").alias("rest")).where("all < 2 * rest")
        found = best.groupBy("pattern").agg(F.min(F.struct((F.col("all") > F.col("rest")).alias("over"), F.abs(F.col("all") - F.col("rest")).alias("off"), "all", "size", "h")).alias("pick")).collect()
        if not found:
            break
        for r in found:
            extra.append((r["pattern"], r["pick"]["h"], r["pick"]["size"]))
            state[r["pattern"]][1] -= r["pick"]["all"]
    one_more = _small(spark, [(*x, 1) for x in extra], "pattern string, h long, size long, more long")
    filled = chosen.join(one_more, ["pattern", "h", "size"], "left")
    return filled.withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")


def by_weight(docs: DataFrame, cycle: Sequence[int] = (1, 2, 3), repeats: int = REPEATS, seed: int = 0) -> DataFrame:
    """Mix rows of (doc_id, text, source): sources in code-point order, null last, weigh 1, 2, 3, 1, ...

    Returns doc_id, text_hash, source, size, source_size, target, copies, taken.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), text_hash().alias("text_hash"))
    sized = common.materialise(sized, "mix-words")
    found = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in found]
    aims = targets(sizes, [cycle[i % len(cycle)] for i in range(len(sizes))], most=repeats)
    quotas = {r["source"]: t for r, t in zip(found, aims)}
    taken = mix(sized.withColumn("members", F.array("source")), quotas=quotas, repeats=repeats, seed=seed, also=["text_hash"]).withColumn("source", F.col("members")[0])
    aim = _small(spark, [(r["source"], s, t) for r, s, t in zip(found, sizes, aims)], "_source string, source_size long, target double")
    joined = taken.join(aim, F.col("source").eqNullSafe(F.col("_source")))
    return joined.select("doc_id", "text_hash", "source", "size", "source_size", "target", "copies", "taken")


def take(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``by_weight`` takes, each as often as it takes it, with all their columns.

    Rows are told by doc_id, text and source; rows alike in these are taken alike.
    """
    names = common.free_names(docs, "_id", "_hash", "_from", "_copies", "_nth")
    of_id, of_hash, of_source, number, nth = names
    copies = by_weight(docs, **options).where("copies > 0").groupBy(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash), F.col("source").alias(of_source))
    copies = common.materialise(copies.agg(F.max("copies").cast("int").alias(number)), "mix-copies")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (text_hash() == F.col(of_hash)) & F.col("source").cast("string").eqNullSafe(F.col(of_source))
    joined = docs.join(copies.hint("merge"), same)
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(number)))).select(common.own_columns(docs))
