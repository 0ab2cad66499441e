"""Silver to gold: daily summary, health flags, fleet summary."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as s
from . import windows as w


def _stamp(at: datetime | None) -> Column:
    return F.lit(at or datetime.now(timezone.utc)).cast("timestamp")


def _non_negative(c: Column) -> Column:
    """max(c, 0), null staying null (``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def daily_equipment_summary(silver: DataFrame) -> DataFrame:
    """One row per machine and day.

    Windows are dealt by (machine, day), and so is the final grouping: one shuffle serves all,
    and a machine with many readings is as many tasks' work as it has days.
    """
    df = w.settled(silver, segment="event_date")
    df = w.level_change(df, "fuel_level_pct", within="event_date", out="_fuel_change")
    temp = F.when(F.col("settled"), F.col("coolant_temp_c"))
    oil = F.when(F.col("is_under_load"), F.col("oil_pressure_psi"))
    daily = df.groupBy("equipment_id", F.col("event_date").alias("day")).agg(
        F.min_by("equipment_type", F.when(F.col("equipment_type").isNotNull(), F.col("event_time"))).alias("equipment_type"),
        F.count("*").alias("readings_count"),
        F.count_if("is_under_load").alias("under_load_readings"),
        F.avg(temp).alias("avg_coolant_temp_c"),
        F.max(temp).alias("max_coolant_temp_c"),
        F.percentile(temp, s.TEMP_PERCENTILE).alias("p95_coolant_temp_c"),
        F.avg(oil).alias("avg_oil_pressure_psi"),
        F.min(oil).alias("min_oil_pressure_psi"),
        F.min("engine_hours").alias("engine_hours_start"),
        F.max("engine_hours").alias("engine_hours_end"),
        w.consumed(F.col("_fuel_change")).alias("fuel_consumed_pct"),
        w.refuels(F.col("_fuel_change")).alias("refuel_events"),
        F.count_if("has_fault").alias("fault_code_count"),
        w.distinct_count(F.col("fault_code")).alias("distinct_fault_codes"),
        w.last_known_pair(F.col("gps_lat"), F.col("gps_lon"), F.col("event_time")).alias("_gps"),
    )
    hours = _non_negative(F.col("engine_hours_end") - F.col("engine_hours_start"))
    daily = daily.withColumns({"operating_hours": hours, "last_gps_lat": F.col("_gps.lat"), "last_gps_lon": F.col("_gps.lon")})
    rate = F.when(F.col("operating_hours") >= s.MIN_OPERATING_HOURS_FOR_RATE, F.col("fuel_consumed_pct") / F.col("operating_hours"))
    return s.conform(daily.withColumn("fuel_burn_pct_per_hour", rate), s.DAILY).orderBy("day", "equipment_id")


def _rules(temp_ok: Column, oil_ok: Column) -> dict[str, Column]:
    """Each rule's condition; an unknown value never fires."""
    col = F.col
    conditions = {
        "temp_trending_up": temp_ok & (col("temp_trend_c_per_hour") >= s.TEMP_TREND_C_PER_HOUR),
        "temp_high": temp_ok & (col("_p95") >= s.TEMP_HIGH_C),
        "temp_critical": temp_ok & (col("_p95") >= s.TEMP_CRITICAL_C),
        "oil_pressure_low": oil_ok & (col("recent_min_oil_psi") <= s.OIL_PRESSURE_LOW_PSI),
        "oil_pressure_critical": oil_ok & (col("recent_min_oil_psi") <= s.OIL_PRESSURE_CRITICAL_PSI),
        "repeated_faults": col("recent_fault_count") >= s.FAULT_REPEAT_COUNT,
        "fault_storm": col("recent_fault_count") >= s.FAULT_STORM_COUNT,
        "recurring_fault_code": col("_top_count") >= s.RECURRING_FAULT_CODE_COUNT,
        "stale_telemetry": col("hours_since_last_reading") >= s.STALE_TELEMETRY_HOURS,
    }
    return {n: F.coalesce(conditions[n], F.lit(False)) for n in s.RULE_ORDER}


def machine_presence(silver: DataFrame) -> DataFrame:
    """When each machine was last read, and last under load, as which type: a few rows a machine.

    One pass over four columns; anchors, the universe of machines and the fleet's spine come from it.
    """
    loaded = F.max(F.when(F.col("is_under_load"), F.col("event_time"))).alias("last_loaded_utc")
    return silver.groupBy("equipment_id", "equipment_type").agg(F.max("event_time").alias("last_seen_utc"), loaded)


def _anchor(presence: DataFrame) -> Column:
    """The newest time of all readings, as a scalar subquery."""
    return presence.select(F.max("last_seen_utc")).scalar()


def in_window(silver: DataFrame, start: Column) -> DataFrame:
    """Readings from ``start`` on.  On a frame by days the days are a predicate too, which opens only theirs."""
    rows = silver.where(F.col("event_time") >= start)
    return rows.where(F.col("dt") >= F.to_date(start)) if "dt" in silver.columns else rows


def machine_health(silver: DataFrame, window_hours: int = s.DEFAULT_WINDOW_HOURS, at: datetime | None = None, presence: DataFrame | None = None) -> DataFrame:
    """Every machine with its window's statistics, fired rules, severity and score.

    With a written ``presence`` only the window's days of ``silver`` are read.
    """
    presence = machine_presence(silver) if presence is None else presence
    anchor = _anchor(presence)
    start = anchor - F.expr(f"INTERVAL {int(window_hours)} HOURS")
    universe = presence.groupBy("equipment_id").agg(
        F.max_by("equipment_type", F.when(F.col("equipment_type").isNotNull(), F.col("last_seen_utc"))).alias("equipment_type"),
        F.max("last_seen_utc").alias("last_seen_utc"),
    )
    recent = in_window(silver, start)
    recent = w.settled(recent, segment="event_date")  # spells begin with the window
    hours = F.timestamp_diff("MICROSECOND", start, F.col("event_time")).cast("double") / 3.6e9
    temp = F.when(F.col("settled"), F.col("coolant_temp_c"))
    oil = F.when(F.col("is_under_load"), F.col("oil_pressure_psi"))
    code = F.when(F.col("has_fault"), F.col("fault_code"))
    stats = recent.groupBy("equipment_id").agg(
        F.count("*").alias("readings_in_window"),
        F.count_if("settled").alias("_settled"),
        F.count_if("is_under_load").alias("_loaded"),
        F.avg(temp).alias("recent_avg_temp_c"),
        F.max(temp).alias("recent_max_temp_c"),
        F.percentile(temp, s.TEMP_PERCENTILE).alias("_p95"),
        F.percentile(oil, s.OIL_PRESSURE_PERCENTILE).alias("recent_min_oil_psi"),
        F.when(F.count(temp) >= s.MIN_UNDER_LOAD_READINGS, F.regr_slope(temp, F.when(temp.isNotNull(), hours))).alias("temp_trend_c_per_hour"),
        F.count(code).alias("recent_fault_count"),
        w.distinct_count(code).alias("distinct_fault_codes"),
        w.last_known_pair(F.col("gps_lat"), F.col("gps_lon"), F.col("event_time")).alias("_gps"),
    )
    top = w.top_by_frequency(recent.withColumn("_code", code), ["equipment_id"], "_code").select("equipment_id", F.col("top_value").alias("top_fault_code"), F.col("top_count").alias("_top_count"))
    zero = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("readings_in_window", "_settled", "_loaded", "recent_fault_count", "distinct_fault_codes", "_top_count")}
    df = universe.join(stats, "equipment_id", "left").join(top, "equipment_id", "left").withColumns(zero)
    since = F.timestamp_diff("MICROSECOND", F.col("last_seen_utc"), anchor).cast("double") / 3.6e9
    df = df.withColumns({"hours_since_last_reading": since, "last_gps_lat": F.col("_gps.lat"), "last_gps_lon": F.col("_gps.lon")})
    fired = _rules(F.col("_settled") >= s.MIN_UNDER_LOAD_READINGS, F.col("_loaded") >= s.MIN_UNDER_LOAD_READINGS)
    df = df.withColumns({f"_rule_{n}": rule for n, rule in fired.items()})
    rule = lambda n: F.col(f"_rule_{n}")
    penalty = sum((F.when(rule(n), p).otherwise(0.0) for n, p in s.HEALTH_PENALTIES.items()), F.lit(0.0))
    worst = F.lit(False)
    for n in s.CRITICAL_RULES:
        worst = worst | rule(n)
    return df.withColumns(
        {
            "flag_reasons": F.concat_ws(",", *(F.when(rule(n), F.lit(n)) for n in s.RULE_ORDER)),
            "severity": F.when(worst, "critical").otherwise("warning"),
            "health_score": F.least(F.greatest(F.lit(100.0) - penalty, F.lit(0.0)), F.lit(100.0)),
            "window_hours": F.lit(int(window_hours)).cast("long"),
            "generated_at_utc": _stamp(at),
        }
    )


def fleet_health_flags(silver: DataFrame, window_hours: int = s.DEFAULT_WINDOW_HOURS, at: datetime | None = None, presence: DataFrame | None = None) -> DataFrame:
    """One row per machine that some rule flags, the most urgent first."""
    flagged = machine_health(silver, window_hours, at, presence).where(F.col("flag_reasons") != "")
    return s.conform(flagged, s.FLAGS).orderBy(F.desc(F.col("severity") == "critical"), "health_score", "equipment_id")


def fleet_summary_by_type(silver: DataFrame, daily: DataFrame, flags: DataFrame, at: datetime | None = None, presence: DataFrame | None = None) -> DataFrame:
    """One row per equipment type; types without daily rows or flags keep zeros and nulls."""
    presence = machine_presence(silver) if presence is None else presence
    active = F.col("last_loaded_utc") >= _anchor(presence) - F.expr(f"INTERVAL {s.ACTIVE_WINDOW_HOURS} HOURS")
    # a row per machine and type, so that the distinct counts are plain sums
    spine = presence.where(F.col("equipment_type").isNotNull()).withColumn("_active", active).groupBy("equipment_type")
    spine = spine.agg(F.count("equipment_id").alias("machine_count"), F.count_if("_active").alias("active_machines_24h"))
    load, hours = F.col("under_load_readings").cast("double"), F.col("operating_hours")
    by_day = daily.groupBy("equipment_type").agg(
        w.weighted_mean(F.col("avg_coolant_temp_c"), load).alias("avg_coolant_temp_c"),
        F.max("max_coolant_temp_c").alias("max_coolant_temp_c"),
        w.weighted_mean(F.col("avg_oil_pressure_psi"), load).alias("avg_oil_pressure_psi"),
        F.sum("operating_hours").alias("total_operating_hours"),
        w.weighted_mean(F.col("fuel_burn_pct_per_hour"), hours).alias("avg_fuel_burn_pct_per_hour"),
        F.sum("fault_code_count").alias("total_fault_codes"),
        F.count_distinct("day").alias("days_covered"),
    )
    distinct = lambda name: F.count_distinct(F.when(F.col("severity") == name, F.col("equipment_id")))
    by_flag = flags.groupBy("equipment_type").agg(F.count_distinct("equipment_id").alias("machines_flagged"), distinct("critical").alias("critical_count"), distinct("warning").alias("warning_count"))
    # at most one row a type on every side
    df = spine.join(by_day, "equipment_type", "left").join(by_flag, "equipment_type", "left")
    zero = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("total_fault_codes", "days_covered", "machines_flagged", "critical_count", "warning_count")}
    df = df.withColumns(zero)
    share = F.bround(F.lit(100.0) * F.col("machines_flagged") / F.col("machine_count"), 2)
    return s.conform(df.withColumns({"pct_flagged": share, "generated_at_utc": _stamp(at)}), s.FLEET).orderBy("equipment_type")
