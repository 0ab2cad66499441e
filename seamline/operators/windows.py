"""Time-series building blocks over (machine, time).

What depends on a machine's whole past is found in segments: rows are dealt by (machine,
segment), by default a day, so that no task holds a machine's history.  A narrow pass sums up
each segment, a scan over these sums, a row a segment, gives what comes into each segment
from those before it, and a local pass over the rows starts from that carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import REFUEL_DELTA_PCT, WARMUP_READINGS


def _segmented(df: DataFrame, time: str, segment: str | None) -> tuple[DataFrame, str]:
    """The frame and its segment column: the given one, or the date of ``time``, rows without a time first."""
    if segment:
        return df, segment
    return df.withColumn("_segment", F.coalesce(F.to_date(time), F.lit("0001-01-01").cast("date"))), "_segment"


def settled(df: DataFrame, key: str = "equipment_id", time: str = "event_time", running: str = "is_under_load", warmup: int = WARMUP_READINGS, out: str = "settled", segment: str | None = None) -> DataFrame:
    """Mark rows after ``warmup`` readings of an uninterrupted running spell, which may span segments.

    ``segment`` names a column, never null, that follows the time.  Rows come out dealt by
    (key, segment), so a grouping by these needs no other shuffle.  Filter first where the
    spell should begin with the filter's window.
    """
    columns = df.columns
    df, seg = _segmented(df, time, segment)
    on = F.coalesce(F.col(running), F.lit(False))
    upto = W.partitionBy(key, seg).orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)

    def counted(frame: DataFrame) -> DataFrame:
        """``_on``: running rows of the segment so far; ``_before``: those up to its last stop, null before its first."""
        frame = frame.withColumn("_on", F.sum(F.when(on, 1).otherwise(0)).over(upto))
        return frame.withColumn("_before", F.max(F.when(~on, F.col("_on"))).over(upto))

    ends = counted(df.select(key, seg, time, running)).groupBy(key, seg).agg(F.max("_on").alias("_on"), F.max("_before").alias("_before"))
    # a segment without a stop goes on with the spell that comes in; another ends with one of its own
    so_far = W.partitionBy(key).orderBy(seg).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = F.coalesce(F.sum(F.when(F.col("_before").isNull(), F.col("_on"))).over(so_far), F.lit(0))
    ends = ends.withColumn("_whole", whole)
    own = F.when(F.col("_before").isNotNull(), F.struct((F.col("_on") - F.col("_before")).alias("tail"), F.col("_whole").alias("whole")))
    ends = ends.withColumn("_own", F.last(own, ignorenulls=True).over(so_far))
    running_on = F.col("_whole") + F.coalesce(F.col("_own.tail") - F.col("_own.whole"), F.lit(0))
    carry = ends.select(key, seg, F.lag(running_on, 1, 0).over(W.partitionBy(key).orderBy(seg)).alias("_carry"))
    joined = counted(df).join(carry, [key, seg], "left")
    spell = F.col("_on") - F.coalesce("_before", F.lit(0)) + F.when(F.col("_before").isNull(), F.coalesce("_carry", F.lit(0))).otherwise(0)
    return joined.withColumn(out, on & (spell > warmup)).select(*(c for c in columns if c != out), out)


def level_change(df: DataFrame, level: str, key: str = "equipment_id", time: str = "event_time", within: str | None = None, out: str = "level_change", segment: str | None = None) -> DataFrame:
    """Difference to the machine's last known level; null for unknown levels and the first.

    ``within`` (a column, never null, that follows the time, as its date does) forgets the
    level where it changes: it is the segment then, and nothing is carried into it.
    """
    columns = df.columns
    df, seg = _segmented(df, time, within or segment)
    known = F.last(level, ignorenulls=True).over(W.partitionBy(key, seg).orderBy(time).rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumn("_before", known)
    if within is None:
        last = df.groupBy(key, seg).agg(F.max_by(level, F.when(F.col(level).isNotNull(), F.col(time))).alias("_last"))
        earlier = W.partitionBy(key).orderBy(seg).rowsBetween(W.unboundedPreceding, -1)
        carry = last.select(key, seg, F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
        df = df.join(carry, [key, seg], "left").withColumn("_before", F.coalesce("_before", "_carry"))
    return df.withColumn(out, F.col(level) - F.col("_before")).select(*(c for c in columns if c != out), out)


def consumed(change: Column) -> Column:
    """Sum of drops; null where no change was observed."""
    return F.sum(F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))))


def refuels(change: Column, more_than: float = REFUEL_DELTA_PCT) -> Column:
    return F.count_if(F.coalesce(change > more_than, F.lit(False)))


def last_known_pair(lat: Column, lon: Column, time: Column) -> Column:
    """A struct of the latest pair whose two parts are both known."""
    return F.max_by(F.struct(lat.alias("lat"), lon.alias("lon")), F.when(lat.isNotNull() & lon.isNotNull(), time))


def top_by_frequency(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent non-null value per key, ties to the lowest: keys, top_value, top_count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_best"))
    return best.select(*keys, F.col("_best.v").alias("top_value"), (-F.col("_best.n")).alias("top_count"))


def distinct_count(value: Column) -> Column:
    """Number of different known values, for columns that have few of them in a group.

    A set in the aggregation's buffer: a distinct aggregate would group the rows twice and
    carry the buffers of all other aggregates from one grouping to the other.
    """
    return F.size(F.collect_set(value)).cast("long")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean over rows whose value and weight are known and whose weight is positive."""
    ok = value.isNotNull() & (weight > 0)
    return F.sum(F.when(ok, value * weight)) / F.nullif(F.sum(F.when(ok, weight)), F.lit(0).cast("double"))


def runs(df: DataFrame, keys: list[str], order: str, flag: Column, out: str = "run") -> DataFrame:
    """Rows where ``flag`` holds, with the number of their consecutive run within ``keys``."""
    w = W.partitionBy(*keys).orderBy(order)
    numbered = df.withColumn("_all", F.row_number().over(w)).where(flag)
    return numbered.withColumn(out, F.col("_all") - F.row_number().over(w)).drop("_all")
