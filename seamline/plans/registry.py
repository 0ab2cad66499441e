"""All queries of the lakehouse operators over the test tables, and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions import conform as c
from ..operators import cleaning, gold, windows
from ..sources import lake as lakes
from ..sources import snapshots
from ..sources.lake import Lake
from . import etl, serving, warehouse
from .standins import SILVER_SQL, bronze, rounded, silver, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_AT = datetime(2024, 2, 1, tzinfo=timezone.utc)
_WINDOW = 480


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{silver}", SILVER_SQL)
        return f

    return add


# Cleaning

#: Every bronze row of the stand-in, what is wrong with it, and its place among the copies of its reading.
_COPIES = """copies AS (
    SELECT event_id, user_id, ts, event_type, value, 0 AS late FROM events
    UNION ALL SELECT event_id, user_id, ts, event_type, value, 0 FROM events WHERE event_id % 10 = 0
    UNION ALL SELECT event_id, user_id, ts, event_type, value, 1 FROM events WHERE event_id % 15 = 0
), judged AS (
    SELECT *, CASE WHEN event_id % 60 = 59 THEN 'missing_equipment_id' WHEN event_id % 50 = 49 THEN 'unparseable_timestamp'
                   WHEN event_id % 40 = 39 THEN 'unknown_equipment_type' END AS reject_reason FROM copies
), keyed AS (
    SELECT *, row_number() OVER (PARTITION BY user_id, floor(epoch(ts)), reject_reason ORDER BY late, event_id % 6) AS nth,
           first_value(CASE WHEN late = 1 THEN 'late' ELSE 'b' || CAST(event_id % 6 AS STRING) END) OVER (PARTITION BY user_id, floor(epoch(ts)), reject_reason ORDER BY late, event_id % 6) AS winner,
           CASE WHEN late = 1 THEN 'late' ELSE 'b' || CAST(event_id % 6 AS STRING) END AS batch
    FROM judged
)"""


@query(
    f"""WITH {_COPIES} SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_seconds, event_id % 4 = 2 AS assumed_utc
       FROM copies WHERE event_id % 50 <> 49"""
)
def c2_event_time(spark, sf_dir):
    t = c.event_time(F.col("timestamp"))
    df = bronze(spark, sf_dir).select("event_id", t.alias("t"))
    return df.where("t.at IS NOT NULL").select("event_id", F.unix_timestamp("t.at").alias("at_seconds"), F.col("t.assumed_utc").alias("assumed_utc"))


#: Spellings of a time: a pattern, hours its clock is ahead, what follows, what of it is kept (null: it is refused, -1), and whether UTC is assumed.
_SPELLINGS = (
    ("yyyyMMdd'T'HHmmss", 0, "", "second", True),
    ("yyyyMMdd", 0, "", "day", True),
    ("yyyy/MM/dd HH:mm:ss", 0, "", "second", True),
    ("yyyy-MM-dd'T'HH:mm:ss", 9.5, "+09:30", "second", False),
    ("yyyy-MM-dd'T'HH:mm:ss", 8, "+0800", "second", False),
    ("yyyy-MM-dd HH:mm:ss", 8, " +08:00", "second", False),
    ("yyyy-MM-dd'T'HH:mm:ss", -3, "-03", "second", False),
    ("yyyy-MM-dd", 0, "", "day", True),
    ("yyyy-MM", 0, "", "month", True),
    ("yyyy", 0, "", "year", True),
    ("yyyy-MM-dd'T'HH:mm", 0, "", "minute", True),
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", 0, "7", "second", True),
    ("yyyyMMdd'T'HHmmss", 0, "Z", "second", False),
    ("yyyy-M-d", 0, "  ", "day", True),
    ("'T'HH:mm", 0, "", None, False),
    ("HH:mm", 0, "", None, False),
    ("'2300'-MM-dd", 0, "", None, False),
    ("'1600'-MM-dd", 0, "", None, False),
    ("yyyy-MM-dd HH:mm:ss", 0, " Australia/Perth", None, False),
    ("yyyy-MM-dd'T'HH:mm:ss", 0, "z", None, False),
    ("yyyy-MM-dd'T'", 0, "24:00:00Z", None, False),
    ("'+00'yyyy-MM-dd", 0, "", None, False),
    ("'now'", 0, "", None, False),
)


@query(
    "SELECT event_id, CASE event_id % "
    + str(len(_SPELLINGS))
    + "".join(f" WHEN {k} THEN " + (f"CAST(floor(epoch(date_trunc('{kept}', ts))) AS BIGINT)" if kept else "-1") for k, (_, _, _, kept, _) in enumerate(_SPELLINGS))
    + f" END AS at_seconds, event_id % {len(_SPELLINGS)} IN ({', '.join(str(k) for k, x in enumerate(_SPELLINGS) if x[4])}) AS assumed_utc FROM events"
)
def c2_time_grammar(spark, sf_dir):
    """Every event's time in one of many spellings, those that must be refused among them."""
    view(spark, sf_dir, "events")
    at, raw = F.col("ts").cast("timestamp"), F.lit(None).cast("string")
    for k, (pattern, ahead, after, _, _) in enumerate(_SPELLINGS):
        spelled = F.concat(F.date_format(at + F.expr(f"INTERVAL {int(60 * ahead)} MINUTES"), pattern), F.lit(after))
        raw = F.when(F.col("event_id") % len(_SPELLINGS) == k, spelled).otherwise(raw)
    t = c.event_time(raw)
    return spark.table("events").select("event_id", t.alias("t")).select("event_id", F.coalesce(F.unix_timestamp("t.at"), F.lit(-1)).alias("at_seconds"), F.col("t.assumed_utc").alias("assumed_utc"))


@query(
    f"""WITH {_COPIES} SELECT event_id, CASE WHEN event_id % 40 = 39 THEN NULL WHEN event_id % 5 = 0 THEN 'excavator' WHEN event_id % 5 = 1 THEN 'dozer'
              WHEN event_id % 5 = 2 THEN 'loader' ELSE 'generator_engine' END AS equipment_type FROM copies"""
)
def c5_equipment_type(spark, sf_dir):
    df = bronze(spark, sf_dir)
    return df.select("event_id", c.equipment_type(F.col("equipment_type")).alias("equipment_type"))


@query(
    f"""WITH {_COPIES} SELECT event_id,
              CASE WHEN event_id % 9 < 2 THEN NULL ELSE CAST(event_id % 101 AS DOUBLE) END AS fuel_level_pct,
              CASE WHEN value * 3 > 200 THEN NULL ELSE round(value * 3, 8) END AS coolant_temp_c,
              CASE WHEN event_id % 8 = 1 THEN NULL WHEN event_id % 8 = 0 THEN CAST(5 AS DOUBLE) ELSE CAST(event_id % 50 AS DOUBLE) END AS oil_pressure_psi,
              CASE WHEN event_id % 12 = 0 THEN NULL WHEN event_id % 12 = 1 THEN CAST(0 AS DOUBLE) WHEN event_id % 100 < 20 THEN NULL ELSE CAST(event_id % 100 - 200 AS DOUBLE) / 2 END AS gps_lat,
              CASE WHEN event_id % 12 = 0 OR event_id % 100 > 80 THEN NULL ELSE CAST(event_id % 100 + 100 AS DOUBLE) END AS gps_lon,
              nullif(concat_ws(',', CASE WHEN event_id % 9 = 0 THEN 'fuel_level_pct_out_of_range' END, CASE WHEN value * 3 > 200 THEN 'coolant_temp_c_out_of_range' END,
                     CASE WHEN event_id % 8 = 1 THEN 'oil_pressure_psi_out_of_range' END, CASE WHEN event_id % 12 > 1 AND event_id % 100 < 20 THEN 'gps_lat_out_of_range' END,
                     CASE WHEN event_id % 12 <> 0 AND event_id % 100 > 80 THEN 'gps_lon_out_of_range' END, CASE WHEN event_id % 12 = 0 THEN 'gps_null_island' END), '') AS quality_flags
       FROM copies"""
)
def c8_ranges_and_flags(spark, sf_dir):
    df = cleaning.apply_ranges(bronze(spark, sf_dir))
    flags = {n.removeprefix("_flag_"): F.col(n) for n in df.columns if n.startswith("_flag_")}
    kept = df.select("event_id", "fuel_level_pct", "coolant_temp_c", "oil_pressure_psi", "gps_lat", "gps_lon", c.joined_flags(flags).alias("quality_flags"))
    return rounded(kept)


@query(f"WITH {_COPIES} SELECT reject_reason, count(*) AS n FROM keyed WHERE reject_reason IS NOT NULL GROUP BY reject_reason")
def c7_quarantine(spark, sf_dir):
    return cleaning.clean(bronze(spark, sf_dir), _AT).quarantine.groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_COPIES} SELECT 'M-' || lpad(CAST(user_id AS STRING), 6, '0') AS equipment_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_seconds,
        batch AS _ingest_batch_id FROM keyed WHERE reject_reason IS NULL AND nth = 1"""
)
def c10_dedup_silver(spark, sf_dir):
    clean = cleaning.clean(bronze(spark, sf_dir), _AT).silver
    return clean.select("equipment_id", F.unix_timestamp("event_time").alias("at_seconds"), "_ingest_batch_id")


@query(
    f"""WITH {_COPIES}
        SELECT 'rows_in' AS metric, count(*) AS n FROM keyed
        UNION ALL SELECT 'rows_out', count(*) FROM keyed WHERE reject_reason IS NULL AND nth = 1
        UNION ALL SELECT 'rows_quarantined', count(*) FROM keyed WHERE reject_reason IS NOT NULL
        UNION ALL SELECT 'exact_resend', count(*) FROM keyed WHERE reject_reason IS NULL AND nth > 1 AND batch = winner
        UNION ALL SELECT 'cross_batch_resend', count(*) FROM keyed WHERE reject_reason IS NULL AND nth > 1 AND batch <> winner"""
)
def c14_audit(spark, sf_dir):
    f = cleaning.clean(bronze(spark, sf_dir), _AT).conformed
    v = F.col("_verdict")
    counts = f.agg(
        F.count("*").alias("rows_in"),
        F.count_if(v == "kept").alias("rows_out"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("rows_quarantined"),
        F.count_if(v == "exact_resend").alias("exact_resend"),
        F.count_if(v == "cross_batch_resend").alias("cross_batch_resend"),
    )
    return counts.unpivot([], list(counts.columns), "metric", "n")


_FIRED = {
    "assumed_utc": "event_id % 4 = 2",
    "engine_hours_out_of_range": "event_id / 100.0 > 200000",
    "fuel_level_pct_out_of_range": "event_id % 9 = 0",
    "coolant_temp_c_out_of_range": "value * 3 > 200 OR value * 3 < -50",
    "oil_pressure_psi_out_of_range": "event_id % 8 = 1",
    "gps_lat_out_of_range": "event_id % 12 > 1 AND event_id % 100 < 20",
    "gps_lon_out_of_range": "event_id % 12 <> 0 AND event_id % 100 > 80",
    "gps_null_island": "event_id % 12 = 0",
}
_KEPT = "FROM keyed WHERE reject_reason IS NULL AND nth = 1"
_NULLED = {n: f"({_FIRED[f'{n}_out_of_range']})" + (" OR event_id % 12 = 0" if n.startswith("gps") else "") for n in schemas.VALID_RANGES}


@query(
    f"WITH {_COPIES} "
    + " UNION ALL ".join(f"SELECT 'flag {n}' AS metric, count(*) FILTER (WHERE {sql}) AS n {_KEPT}" for n, sql in _FIRED.items())
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT 'nulled {n}', count(*) FILTER (WHERE {sql}) {_KEPT}" for n, sql in _NULLED.items())
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT 'reject {r}', count(*) FROM keyed WHERE reject_reason = '{r}'" for r in schemas.REJECT_REASONS)
    + f" UNION ALL SELECT 'rows_in', count(*) FROM keyed UNION ALL SELECT 'rows_out', count(*) {_KEPT}"
    " UNION ALL SELECT 'rows_quarantined', count(*) FROM keyed WHERE reject_reason IS NOT NULL"
    " UNION ALL SELECT 'duplicates_removed', count(*) FROM keyed WHERE reject_reason IS NULL AND nth > 1"
)
def c14_audit_flags(spark, sf_dir):
    """The audit a cleaning run reports: flags that fired, values nulled, reasons to refuse, and that it reconciles."""
    audit = cleaning.clean(bronze(spark, sf_dir), _AT).audit()
    cleaning.reconcile(audit)
    rows = [(f"flag {n}", v) for n, v in audit["flags"].items()] + [(f"nulled {n}", v) for n, v in audit["values_nulled"].items()] + [(f"reject {n}", v) for n, v in audit["reject_reasons"].items()]
    rows += [(n, audit[n]) for n in ("rows_in", "rows_out", "rows_quarantined", "duplicates_removed")]
    return spark.createDataFrame(rows, "metric string, n long")


@query(
    f"""WITH {_COPIES} SELECT 'M-' || lpad(CAST(user_id AS STRING), 6, '0') AS equipment_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_seconds, CAST(ts AS DATE) AS event_date,
        CASE WHEN event_type = 'error' THEN 'F1' END AS fault_code, event_type = 'error' AS has_fault, event_id % 8 > 1 AND event_id % 50 > 5 AS is_under_load,
        nullif(concat_ws(',', {", ".join(f"CASE WHEN {sql} THEN '{n}' END" for n, sql in _FIRED.items())}), '') AS quality_flags,
        CAST(1706745600 AS BIGINT) AS processed_seconds {_KEPT}"""
)
def c11_derived(spark, sf_dir):
    clean = cleaning.clean(bronze(spark, sf_dir), _AT).silver
    times = [F.unix_timestamp("event_time").alias("at_seconds"), F.unix_timestamp("_silver_processed_at_utc").alias("processed_seconds")]
    return clean.select("equipment_id", *times, "event_date", "fault_code", "has_fault", "is_under_load", "quality_flags")


# Windows and gold

_SETTLED = """cycles AS (
    SELECT *, sum(CASE WHEN is_under_load THEN 0 ELSE 1 END) OVER (PARTITION BY equipment_id ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS cycle FROM {from}
), settled AS (
    SELECT *, is_under_load AND sum(CASE WHEN is_under_load THEN 1 ELSE 0 END) OVER (PARTITION BY equipment_id, cycle ORDER BY event_time ROWS UNBOUNDED PRECEDING) > 9 AS settled FROM cycles
)"""
_DAILY = (
    """silver AS ({silver}), """
    + _SETTLED.replace("{from}", "silver")
    + """, fuel AS (
    SELECT equipment_id, event_date, sum(greatest(-delta, 0)) FILTER (WHERE delta IS NOT NULL) AS consumed, count(*) FILTER (WHERE delta > 20) AS refuels
    FROM (SELECT equipment_id, event_date, fuel_level_pct - lag(fuel_level_pct) OVER (PARTITION BY equipment_id, event_date ORDER BY event_time) AS delta FROM silver WHERE fuel_level_pct IS NOT NULL)
    GROUP BY ALL
), daily AS (
    SELECT s.equipment_id, s.event_date AS day, min(equipment_type) AS equipment_type, count(*) AS readings_count,
           CAST(count(*) FILTER (WHERE is_under_load) AS BIGINT) AS under_load_readings,
           avg(coolant_temp_c) FILTER (WHERE settled) AS avg_coolant_temp_c, max(coolant_temp_c) FILTER (WHERE settled) AS max_coolant_temp_c,
           quantile_cont(coolant_temp_c, 0.95) FILTER (WHERE settled) AS p95_coolant_temp_c,
           avg(oil_pressure_psi) FILTER (WHERE is_under_load) AS avg_oil_pressure_psi, min(oil_pressure_psi) FILTER (WHERE is_under_load) AS min_oil_pressure_psi,
           min(engine_hours) AS engine_hours_start, max(engine_hours) AS engine_hours_end, max(engine_hours) - min(engine_hours) AS operating_hours,
           any_value(f.consumed) AS fuel_consumed_pct,
           CASE WHEN max(engine_hours) - min(engine_hours) >= 0.05 THEN any_value(f.consumed) / (max(engine_hours) - min(engine_hours)) END AS fuel_burn_pct_per_hour,
           CAST(coalesce(any_value(f.refuels), 0) AS BIGINT) AS refuel_events,
           CAST(count(*) FILTER (WHERE has_fault) AS BIGINT) AS fault_code_count, count(DISTINCT fault_code) AS distinct_fault_codes,
           arg_max(gps_lat, event_time) FILTER (WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL) AS last_gps_lat,
           arg_max(gps_lon, event_time) FILTER (WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL) AS last_gps_lon
    FROM settled s LEFT JOIN fuel f ON f.equipment_id = s.equipment_id AND f.event_date = s.event_date
    GROUP BY s.equipment_id, s.event_date
)"""
)
_DOUBLES = {"engine_hours_start", "engine_hours_end", "avg_coolant_temp_c", "max_coolant_temp_c", "p95_coolant_temp_c", "avg_oil_pressure_psi", "min_oil_pressure_psi", "operating_hours", "fuel_consumed_pct", "fuel_burn_pct_per_hour", "last_gps_lat", "last_gps_lon"}
_DAILY_LIST = ", ".join(f"round({n}, 8) AS {n}" if n in _DOUBLES else n for n in "equipment_id equipment_type day readings_count under_load_readings avg_coolant_temp_c max_coolant_temp_c p95_coolant_temp_c avg_oil_pressure_psi min_oil_pressure_psi engine_hours_start engine_hours_end operating_hours fuel_consumed_pct fuel_burn_pct_per_hour refuel_events fault_code_count distinct_fault_codes last_gps_lat last_gps_lon".split())


@query("WITH silver AS ({silver}), " + _SETTLED.replace("{from}", "silver") + " SELECT event_id, settled FROM settled")
def d6_settled(spark, sf_dir):
    return windows.settled(silver(spark, sf_dir)).select("event_id", "settled")


@query(f"WITH {_DAILY} SELECT {_DAILY_LIST} FROM daily")
def d_daily_summary(spark, sf_dir):
    return rounded(gold.daily_equipment_summary(silver(spark, sf_dir)))


_HEALTH = (
    f"""silver AS ({{silver}}), anchor AS (SELECT max(event_time) AS a FROM silver),
recent AS (SELECT s.*, a - INTERVAL {_WINDOW} HOUR AS start FROM silver s, anchor WHERE event_time >= a - INTERVAL {_WINDOW} HOUR), """
    + _SETTLED.replace("{from}", "recent")
    + """, codes AS (
    SELECT equipment_id, fault_code, n, row_number() OVER (PARTITION BY equipment_id ORDER BY n DESC, fault_code) AS place
    FROM (SELECT equipment_id, fault_code, count(*) AS n FROM recent WHERE has_fault AND fault_code IS NOT NULL GROUP BY ALL)
), stats AS (
    SELECT equipment_id, count(*) AS readings_in_window, count(*) FILTER (WHERE settled) AS n_settled, count(*) FILTER (WHERE is_under_load) AS n_loaded,
           avg(coolant_temp_c) FILTER (WHERE settled) AS recent_avg_temp_c, max(coolant_temp_c) FILTER (WHERE settled) AS recent_max_temp_c,
           quantile_cont(coolant_temp_c, 0.95) FILTER (WHERE settled) AS p95, quantile_cont(oil_pressure_psi, 0.05) FILTER (WHERE is_under_load) AS recent_min_oil_psi,
           CASE WHEN count(coolant_temp_c) FILTER (WHERE settled) >= 12 THEN regr_slope(coolant_temp_c, date_diff('microsecond', start, event_time) / 3.6e9) FILTER (WHERE settled AND coolant_temp_c IS NOT NULL) END AS temp_trend_c_per_hour,
           count(fault_code) FILTER (WHERE has_fault) AS recent_fault_count, count(DISTINCT fault_code) FILTER (WHERE has_fault) AS distinct_fault_codes,
           arg_max(gps_lat, event_time) FILTER (WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL) AS last_gps_lat,
           arg_max(gps_lon, event_time) FILTER (WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL) AS last_gps_lon
    FROM settled GROUP BY equipment_id
), base AS (
    SELECT u.equipment_id, u.equipment_type, coalesce(s.readings_in_window, 0) AS readings_in_window, coalesce(n_settled, 0) AS n_settled, coalesce(n_loaded, 0) AS n_loaded,
           recent_avg_temp_c, recent_max_temp_c, p95, recent_min_oil_psi, temp_trend_c_per_hour, coalesce(recent_fault_count, 0) AS recent_fault_count,
           coalesce(s.distinct_fault_codes, 0) AS distinct_fault_codes, k.fault_code AS top_fault_code, coalesce(k.n, 0) AS top_n,
           date_diff('microsecond', u.seen, a) / 3.6e9 AS hours_since_last_reading, epoch_us(u.seen) AS seen_us, last_gps_lat, last_gps_lon
    FROM (SELECT equipment_id, min(equipment_type) AS equipment_type, max(event_time) AS seen FROM silver GROUP BY 1) u CROSS JOIN anchor
    LEFT JOIN stats s ON s.equipment_id = u.equipment_id LEFT JOIN codes k ON k.equipment_id = u.equipment_id AND k.place = 1
), rules AS (
    SELECT *, n_settled >= 12 AND coalesce(temp_trend_c_per_hour >= 0.35, false) AS r1, n_settled >= 12 AND coalesce(p95 >= 105, false) AS r2, n_settled >= 12 AND coalesce(p95 >= 115, false) AS r3,
           n_loaded >= 12 AND coalesce(recent_min_oil_psi <= 30, false) AS r4, n_loaded >= 12 AND coalesce(recent_min_oil_psi <= 20, false) AS r5,
           recent_fault_count >= 3 AS r6, recent_fault_count >= 25 AS r7, top_n >= 3 AS r8, hours_since_last_reading >= 3 AS r9 FROM base
), flags AS (
    SELECT equipment_id, equipment_type, CASE WHEN r3 OR r5 OR r7 THEN 'critical' ELSE 'warning' END AS severity,
           CAST(greatest(100 - 15 * r1::INT - 20 * r2::INT - 40 * r3::INT - 20 * r4::INT - 40 * r5::INT - 10 * r6::INT - 30 * r7::INT - 15 * r8::INT - 10 * r9::INT, 0) AS DOUBLE) AS health_score,
           concat_ws(',', CASE WHEN r1 THEN 'temp_trending_up' END, CASE WHEN r2 THEN 'temp_high' END, CASE WHEN r3 THEN 'temp_critical' END, CASE WHEN r4 THEN 'oil_pressure_low' END,
                     CASE WHEN r5 THEN 'oil_pressure_critical' END, CASE WHEN r6 THEN 'repeated_faults' END, CASE WHEN r7 THEN 'fault_storm' END, CASE WHEN r8 THEN 'recurring_fault_code' END, CASE WHEN r9 THEN 'stale_telemetry' END) AS flag_reasons,
           round(temp_trend_c_per_hour, 8) AS temp_trend_c_per_hour, round(recent_avg_temp_c, 8) AS recent_avg_temp_c, round(recent_max_temp_c, 8) AS recent_max_temp_c, round(recent_min_oil_psi, 8) AS recent_min_oil_psi,
           recent_fault_count, distinct_fault_codes, top_fault_code, readings_in_window, round(hours_since_last_reading, 5) AS hours_since_last_reading,
           seen_us, round(last_gps_lat, 8) AS last_gps_lat, round(last_gps_lon, 8) AS last_gps_lon, CAST(""" + str(_WINDOW) + """ AS BIGINT) AS window_hours, CAST(1706745600 AS BIGINT) AS generated_seconds
    FROM rules WHERE r1 OR r2 OR r3 OR r4 OR r5 OR r6 OR r7 OR r8 OR r9
)"""
)


def _flag_rows(flags):
    """Whole rows of health flags, times as numbers."""
    flags = flags.withColumn("hours_since_last_reading", F.round("hours_since_last_reading", 5))
    times = {"seen_us": F.unix_micros("last_seen_utc"), "generated_seconds": F.unix_timestamp("generated_at_utc")}
    return rounded(flags.withColumns(times).drop("last_seen_utc", "generated_at_utc"))


@query(f"WITH {_HEALTH} SELECT * FROM flags")
def h_health_flags(spark, sf_dir):
    return _flag_rows(gold.fleet_health_flags(silver(spark, sf_dir), _WINDOW, _AT))


@query(
    """WITH silver AS ({silver}) SELECT equipment_id, fault_code AS top_value, n AS top_count FROM (
       SELECT *, row_number() OVER (PARTITION BY equipment_id ORDER BY n DESC, fault_code) AS place
       FROM (SELECT equipment_id, fault_code, count(*) AS n FROM silver WHERE fault_code IS NOT NULL GROUP BY ALL)) WHERE place = 1"""
)
def h10_top_by_frequency(spark, sf_dir):
    return windows.top_by_frequency(silver(spark, sf_dir), ["equipment_id"], "fault_code")


@query(
    f"""WITH {_DAILY}, {_HEALTH.replace("silver AS ({silver}), ", "", 1).replace("cycles AS", "cycles2 AS").replace("FROM cycles", "FROM cycles2").replace("settled AS (", "settled2 AS (", 1).replace("FROM settled GROUP", "FROM settled2 GROUP")}
    , spine AS (SELECT equipment_type, count(DISTINCT equipment_id) AS machine_count,
                count(DISTINCT equipment_id) FILTER (WHERE is_under_load AND event_time >= a - INTERVAL 24 HOUR) AS active_machines_24h FROM silver, anchor GROUP BY 1),
    by_day AS (SELECT equipment_type,
                sum(avg_coolant_temp_c * under_load_readings) FILTER (WHERE avg_coolant_temp_c IS NOT NULL AND under_load_readings > 0) / sum(under_load_readings) FILTER (WHERE avg_coolant_temp_c IS NOT NULL AND under_load_readings > 0) AS t,
                max(max_coolant_temp_c) AS mt,
                sum(avg_oil_pressure_psi * under_load_readings) FILTER (WHERE avg_oil_pressure_psi IS NOT NULL AND under_load_readings > 0) / sum(under_load_readings) FILTER (WHERE avg_oil_pressure_psi IS NOT NULL AND under_load_readings > 0) AS o,
                sum(operating_hours) AS h,
                sum(fuel_burn_pct_per_hour * operating_hours) FILTER (WHERE fuel_burn_pct_per_hour IS NOT NULL AND operating_hours > 0) / sum(operating_hours) FILTER (WHERE fuel_burn_pct_per_hour IS NOT NULL AND operating_hours > 0) AS b,
                CAST(sum(fault_code_count) AS BIGINT) AS f, count(DISTINCT day) AS d FROM daily GROUP BY 1),
    by_flag AS (SELECT equipment_type, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'warning') AS w FROM flags GROUP BY 1)
    SELECT s.equipment_type, machine_count, active_machines_24h, round(t, 6) AS avg_coolant_temp_c, round(mt, 6) AS max_coolant_temp_c, round(o, 6) AS avg_oil_pressure_psi,
           round(h, 6) AS total_operating_hours, round(b, 6) AS avg_fuel_burn_pct_per_hour, coalesce(f, 0) AS total_fault_codes, coalesce(n, 0) AS machines_flagged,
           round_even(100.0::DOUBLE * coalesce(n, 0) / machine_count, 2) AS pct_flagged, coalesce(c, 0) AS critical_count, coalesce(w, 0) AS warning_count, coalesce(d, 0) AS days_covered
    FROM spine s LEFT JOIN by_day y ON y.equipment_type = s.equipment_type LEFT JOIN by_flag g ON g.equipment_type = s.equipment_type"""
)
def f_fleet_summary(spark, sf_dir):
    s = silver(spark, sf_dir)
    fleet = gold.fleet_summary_by_type(s, gold.daily_equipment_summary(s), gold.fleet_health_flags(s, _WINDOW, _AT), _AT)
    return rounded(fleet.drop("generated_at_utc"), 6)


@query(
    """WITH silver AS ({silver}), anchor AS (SELECT max(event_time) AS a FROM silver)
       SELECT equipment_type, count(DISTINCT equipment_id) AS machine_count, count(DISTINCT equipment_id) FILTER (WHERE is_under_load AND event_time >= a - INTERVAL 24 HOUR) AS active_machines_24h,
              CAST(NULL AS DOUBLE) AS avg_coolant_temp_c, CAST(NULL AS DOUBLE) AS max_coolant_temp_c, CAST(NULL AS DOUBLE) AS avg_oil_pressure_psi, CAST(NULL AS DOUBLE) AS total_operating_hours,
              CAST(NULL AS DOUBLE) AS avg_fuel_burn_pct_per_hour, CAST(0 AS BIGINT) AS total_fault_codes, CAST(0 AS BIGINT) AS machines_flagged, CAST(0 AS DOUBLE) AS pct_flagged,
              CAST(0 AS BIGINT) AS critical_count, CAST(0 AS BIGINT) AS warning_count, CAST(0 AS BIGINT) AS days_covered
       FROM silver, anchor GROUP BY 1"""
)
def f10_empty_branches(spark, sf_dir):
    """The fleet without any daily row or flag: types stay, with zeros and nulls."""
    s = silver(spark, sf_dir)
    empty = lambda schema: spark.createDataFrame([], schema)
    return rounded(gold.fleet_summary_by_type(s, empty(schemas.DAILY), empty(schemas.FLAGS), _AT).drop("generated_at_utc"), 6)


# The SQL catalogue over gold made from the stand-in


def _views(spark, sf_dir):
    s = silver(spark, sf_dir)
    daily = gold.daily_equipment_summary(s)
    sliced = lambda df: df.withColumn("slice", lakes.slice_of(F.col("equipment_id")))
    sliced(daily).createOrReplaceTempView("daily_equipment_summary")
    s.select(F.max("event_date").alias("day")).createOrReplaceTempView("daily_newest")
    flags = gold.fleet_health_flags(s, _WINDOW, _AT)
    sliced(flags).createOrReplaceTempView("fleet_health_flags")
    gold.fleet_summary_by_type(s, daily, flags, _AT).createOrReplaceTempView("fleet_summary_by_type")
    s.createOrReplaceTempView("silver_telemetry")
    b = bronze(spark, sf_dir)
    dated = b.withColumn("dt", F.to_date(c.event_time(F.col("timestamp"))["at"]))
    dated.createOrReplaceTempView("bronze_telemetry")
    dated.select("dt").distinct().createOrReplaceTempView("bronze_days")


def _catalogue(spark, sf_dir, name):
    _views(spark, sf_dir)
    query_ = warehouse.load_queries()[name]
    if query_.pivot:  # its columns are found by reading the table
        warehouse.fleet_hours_by_type(spark.table("daily_equipment_summary")).createOrReplaceTempView(query_.pivot)
    return warehouse.statement(spark, query_)


@query(
    f"""WITH {_DAILY} SELECT equipment_id, any_value(equipment_type) AS equipment_type, CAST(sum(fault_code_count) AS BIGINT) AS faults, max(distinct_fault_codes) AS worst_day_codes,
        round(sum(operating_hours), 1) AS operating_hours, round(sum(fault_code_count) / nullif(sum(operating_hours), 0), 2) AS faults_per_op_hour, count(*) AS days_reporting
        FROM daily WHERE day >= (SELECT max(day) FROM daily) - 6 GROUP BY equipment_id HAVING sum(fault_code_count) > 0
        ORDER BY faults DESC, faults_per_op_hour DESC NULLS LAST, equipment_id LIMIT 10"""
)
def q1_top_fault_equipment(spark, sf_dir):
    return _catalogue(spark, sf_dir, "top_fault_equipment")


@query(
    f"""WITH {_DAILY} SELECT equipment_type, count(DISTINCT equipment_id) AS machines, count(*) AS machine_days, round(sum(operating_hours), 1) AS operating_hours,
        round(sum(fuel_consumed_pct), 1) AS tank_pct_burned, round(sum(fuel_consumed_pct) / sum(operating_hours), 3) AS pct_per_op_hour,
        round(avg(fuel_burn_pct_per_hour), 3) AS unweighted_daily_avg, CAST(sum(refuel_events) AS BIGINT) AS refuel_events
        FROM daily WHERE operating_hours > 0 GROUP BY equipment_type"""
)
def q2_avg_fuel_by_type(spark, sf_dir):
    return _catalogue(spark, sf_dir, "avg_fuel_by_type")


@query(
    f"""WITH {_HEALTH} SELECT equipment_id, equipment_type, round(health_score, 1) AS health_score, flag_reasons, round(recent_max_temp_c, 1) AS max_temp_c, round(recent_min_oil_psi, 1) AS min_oil_psi,
        recent_fault_count, top_fault_code, round(hours_since_last_reading, 2) AS hrs_since_seen FROM flags WHERE severity = 'critical'"""
)
def q3_critical_machines(spark, sf_dir):
    return _catalogue(spark, sf_dir, "critical_machines")


@query(
    f"""WITH {_HEALTH} SELECT equipment_id, equipment_type, severity, round(temp_trend_c_per_hour, 3) + 0 AS trend_c_per_hour, round(recent_avg_temp_c, 1) AS avg_temp_c, round(recent_max_temp_c, 1) AS max_temp_c,
        round(recent_avg_temp_c + temp_trend_c_per_hour * {_WINDOW}, 1) AS projected_temp_c, readings_in_window
        FROM flags WHERE temp_trend_c_per_hour IS NOT NULL QUALIFY rank() OVER (ORDER BY temp_trend_c_per_hour DESC) <= 15"""
)
def q4_temp_trend_leaders(spark, sf_dir):
    return _catalogue(spark, sf_dir, "temp_trend_leaders")


@query(
    f"""WITH {_DAILY}, fleet AS (SELECT day, sum(operating_hours) AS h, count(DISTINCT equipment_id) AS m,
        round(sum(operating_hours) FILTER (WHERE equipment_type = 'excavator'), 1) AS excavator, round(sum(operating_hours) FILTER (WHERE equipment_type = 'dozer'), 1) AS dozer,
        round(sum(operating_hours) FILTER (WHERE equipment_type = 'loader'), 1) AS loader, round(sum(operating_hours) FILTER (WHERE equipment_type = 'generator_engine'), 1) AS generator_engine FROM daily GROUP BY day)
        SELECT day, excavator, dozer, loader, generator_engine, round(h, 1) AS fleet_hours, m AS machines_reporting, round(h / nullif(m, 0), 2) AS hrs_per_machine,
        round(100 * (h - lag(h) OVER (ORDER BY day)) / nullif(lag(h) OVER (ORDER BY day), 0), 1) AS pct_change_vs_prev_day FROM fleet"""
)
def q5_fleet_utilisation(spark, sf_dir):
    return _catalogue(spark, sf_dir, "fleet_utilisation")


@query(
    """WITH counts AS (SELECT event_type AS fault_code, count(*) AS occurrences, count(DISTINCT user_id) AS machines_affected, max(epoch_us(ts)) AS last_seen_us FROM events GROUP BY 1),
       ranked AS (SELECT row_number() OVER (ORDER BY occurrences DESC, fault_code) AS pareto_rank, *, round(100.0::DOUBLE * occurrences / sum(occurrences) OVER (), 2) AS pct_of_faults,
       round(100.0::DOUBLE * sum(occurrences) OVER (ORDER BY occurrences DESC, fault_code ROWS UNBOUNDED PRECEDING) / sum(occurrences) OVER (), 2) AS cumulative_pct FROM counts)
       SELECT CAST(pareto_rank AS INTEGER) AS pareto_rank, fault_code, occurrences, machines_affected, pct_of_faults, cumulative_pct, CASE WHEN cumulative_pct - pct_of_faults < 80 THEN 'vital few' ELSE 'trivial many' END AS pareto_class, last_seen_us FROM ranked"""
)
def q6_fault_code_pareto(spark, sf_dir):
    view(spark, sf_dir, "events")
    spark.sql("SELECT event_type AS fault_code, user_id AS equipment_id, ts AS event_time FROM events").createOrReplaceTempView("silver_telemetry")
    pareto = warehouse.statement(spark, warehouse.load_queries()["fault_code_pareto"])
    return pareto.withColumn("last_seen_us", F.unix_micros(F.col("last_seen").cast("timestamp"))).drop("last_seen")


@query(
    f"""WITH {_COPIES}, silver AS ({{silver}}), totals AS (SELECT (SELECT count(*) FROM copies) AS b, (SELECT count(*) FROM silver) AS s),
        report AS (SELECT 'reconciliation' AS section, 'bronze rows landed' AS metric, b AS row_count, 'bronze' AS basis FROM totals
        UNION ALL SELECT 'reconciliation', 'silver rows retained', s, 'bronze' FROM totals
        UNION ALL SELECT 'reconciliation', 'rows removed (quarantined or deduplicated)', b - s, 'bronze' FROM totals
        UNION ALL SELECT 'reconciliation', 'silver rows carrying >= 1 repair flag', (SELECT count(*) FROM silver WHERE quality_flags IS NOT NULL), 'silver'
        UNION ALL SELECT 'reconciliation', 'duplicate business keys left in silver (must be 0)', s - (SELECT count(DISTINCT (equipment_id, event_time)) FROM silver), 'silver' FROM totals
        UNION ALL SELECT 'quality_flag', trim(flag), count(*), 'silver' FROM (SELECT unnest(string_split(quality_flags, ',')) AS flag FROM silver WHERE quality_flags IS NOT NULL) GROUP BY 2)
        SELECT section, metric, row_count, basis, round(100.0::DOUBLE * row_count / CASE basis WHEN 'bronze' THEN b ELSE s END, 3) AS pct_of_basis FROM report, totals"""
)
def q7_data_quality_report(spark, sf_dir):
    return _catalogue(spark, sf_dir, "data_quality_report")


@query(
    f"""WITH {_COPIES}, dated AS (SELECT *, CASE WHEN event_id % 50 <> 49 THEN CAST(ts AS DATE) END AS dt FROM keyed)
        SELECT dt AS partition_date, count(*) AS readings, count(DISTINCT CASE WHEN event_id % 60 = 59 THEN '  ' ELSE ' M-' || lpad(CAST(user_id AS STRING), 6, '0') END) AS machines,
        count(*) FILTER (WHERE event_type IN ('error', 'view')) AS fault_readings, count(DISTINCT batch) AS ingest_batches,
        min(CASE WHEN late = 1 THEN 1800009999 ELSE 1800000000 + event_id % 6 END) AS first_ingest, max(CASE WHEN late = 1 THEN 1800009999 ELSE 1800000000 + event_id % 6 END) AS last_ingest
        FROM dated WHERE dt >= (SELECT max(dt) FROM dated) - 1 GROUP BY dt"""
)
def q8_partition_pruning(spark, sf_dir):
    df = _catalogue(spark, sf_dir, "partition_pruning_demo")
    return df.withColumns({f"{n}_ingest": F.unix_timestamp(f"{n}_ingest_utc") for n in ("first", "last")}).drop("first_ingest_utc", "last_ingest_utc")


# Serving statements


@query(
    f"""WITH {_HEALTH} SELECT CAST((SELECT count(DISTINCT equipment_id) FROM silver) AS BIGINT) AS fleet_size, count(*) AS machines_flagged, count(*) FILTER (WHERE severity = 'critical') AS critical_count,
        count(*) FILTER (WHERE severity = 'warning') AS warning_count,
        (SELECT max(n) FROM (SELECT count(DISTINCT event_date) AS n FROM silver GROUP BY equipment_type)) AS days_covered, CAST(1706745600 AS BIGINT) AS generated_seconds FROM flags"""
)
def r1_fleet_totals(spark, sf_dir):
    _views(spark, sf_dir)
    return serving.fleet_totals(spark).withColumn("generated_seconds", F.unix_timestamp("generated_at_utc")).drop("generated_at_utc")


@query(ORACLE_SQL["f_fleet_summary"].replace(", coalesce(d, 0) AS days_covered", ""))
def r2_fleet_by_type(spark, sf_dir):
    _views(spark, sf_dir)
    return rounded(serving.fleet_by_type(spark), 6)


@query(f"WITH {_HEALTH} SELECT * FROM flags WHERE equipment_type = 'dozer' ORDER BY severity = 'critical' DESC, health_score, equipment_id LIMIT 20")
def r3_health_flags(spark, sf_dir):
    _views(spark, sf_dir)
    return _flag_rows(serving.health_flags(spark, " Dozer ", None, 20))


@query(
    f"""WITH {_HEALTH} SELECT m.equipment_id, m.equipment_type, m.last_day, f.severity, f.health_score FROM (SELECT equipment_id, min(equipment_type) AS equipment_type, max(event_date) AS last_day FROM silver GROUP BY 1) m
        LEFT JOIN flags f ON f.equipment_id = m.equipment_id ORDER BY f.health_score NULLS LAST, m.equipment_id LIMIT 40"""
)
def r4_equipment(spark, sf_dir):
    _views(spark, sf_dir)
    return serving.equipment(spark, None, False, 40)


@query("WITH silver AS ({silver}) SELECT min(equipment_type) AS equipment_type, max(event_date) AS last_day FROM silver WHERE equipment_id = 'M-000007'")
def r5_identity(spark, sf_dir):
    _views(spark, sf_dir)
    return serving.equipment_identity(spark, "M-000007")


@query(f"WITH {_DAILY} SELECT {_DAILY_LIST} FROM daily WHERE equipment_id = 'M-000007' AND day > (SELECT max(day) FROM daily) - 14")
def r6_history(spark, sf_dir):
    _views(spark, sf_dir)
    return rounded(serving.equipment_days(spark, "M-000007", 14))


@query(f"WITH {_HEALTH} SELECT * FROM flags WHERE equipment_id = 'M-000007'")
def r7_flag(spark, sf_dir):
    _views(spark, sf_dir)
    return _flag_rows(serving.equipment_flag(spark, "M-000007"))


@query(f"WITH {_HEALTH} SELECT equipment_id, unnest(string_split(flag_reasons, ',')) AS reason FROM flags")
def r8_reasons(spark, sf_dir):
    _views(spark, sf_dir)
    return serving.reasons(spark.table("fleet_health_flags"))


@query(
    "SELECT CAST(sum(machine_count) AS BIGINT) AS machines, CAST(sum(machines_flagged) AS BIGINT) AS machines_flagged, round(sum(avg_coolant_temp_c * machine_count) / sum(machine_count) FILTER (WHERE avg_coolant_temp_c IS NOT NULL), 4) AS avg_coolant_temp_c,"
    " round(max(max_coolant_temp_c), 4) AS max_coolant_temp_c, round(100.0::DOUBLE * sum(machines_flagged) / sum(machine_count), 4) AS pct_flagged FROM (" + ORACLE_SQL["f_fleet_summary"] + ")"
)
def r9_cards(spark, sf_dir):
    _views(spark, sf_dir)
    return rounded(serving.scoped(spark.table("fleet_summary_by_type")), 4)


@query(
    f"""WITH {_DAILY}, {_HEALTH.replace("silver AS ({silver}), ", "", 1).replace("cycles AS", "cycles2 AS").replace("FROM cycles", "FROM cycles2").replace("settled AS (", "settled2 AS (", 1).replace("FROM settled GROUP", "FROM settled2 GROUP")}
    SELECT strftime(day, '%Y-%m-%d') AS day, readings_count, fault_code_count, round(operating_hours, 6) AS operating_hours, f.severity AS severity, (SELECT strftime(max(day), '%Y-%m-%d') FROM daily d WHERE d.equipment_id = 'M-000007') AS last_day
    FROM daily LEFT JOIN flags f ON f.equipment_id = daily.equipment_id WHERE daily.equipment_id = 'M-000007' AND day > (SELECT max(day) FROM daily) - 14"""
)
def r10_equipment_history(spark, sf_dir):
    """The payload of one machine, as an API returns it, back in rows."""
    _views(spark, sf_dir)
    found = serving.equipment_history(spark, "M-000007", 14)
    severity = found["flag"]["severity"] if found["flag"] else None
    rows = [(h["day"], h["readings_count"], h["fault_code_count"], round(h["operating_hours"], 6), severity, found["last_day"]) for h in found["history"]]
    return spark.createDataFrame(rows, "day string, readings_count long, fault_code_count long, operating_hours double, severity string, last_day string")


# The lake

#: Silver of the stand-in by day, of all events or of some.
_BY_DAY = f"(WITH {_COPIES} SELECT CAST(ts AS DATE) AS dt, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM keyed WHERE reject_reason IS NULL AND nth = 1 GROUP BY 1)"


@query(
    f"""WITH {_COPIES} SELECT CAST(ts AS DATE) AS dt, count(*) AS rows_in, count(*) FILTER (WHERE reject_reason IS NULL AND nth = 1) AS rows_out,
        count(*) FILTER (WHERE reject_reason IS NOT NULL) AS rows_quarantined, count(*) FILTER (WHERE reject_reason IS NULL AND nth > 1) AS duplicates_removed
        FROM keyed GROUP BY 1"""
)
def k2_bronze_to_silver(spark, sf_dir):
    """Land dated bronze, build silver and quarantine partitions, and count what each holds."""
    lake = Lake(spark, lakes.scratch(spark, "etl"))
    dated = bronze(spark, sf_dir, dated=True)
    lakes.dealt_for_writing(dated.drop("event_id"), "dt").write.partitionBy("dt").parquet(lake.uri(lakes.BRONZE))
    etl.build_silver(spark, lake.root, at=_AT)
    landed = lake.read_partitioned(lakes.BRONZE, schemas.BRONZE).groupBy("dt").agg(F.count("*").alias("rows_in"))
    kept = etl.read_silver(lake).groupBy("dt").agg(F.count("*").alias("rows_out"))
    refused = etl.read_silver(lake, "quarantine").groupBy("dt").agg(F.count("*").alias("rows_quarantined"))
    df = landed.join(kept, "dt", "left").join(refused, "dt", "left").na.fill(0)
    return df.withColumn("duplicates_removed", F.col("rows_in") - F.col("rows_out") - F.col("rows_quarantined"))


@query(
    """WITH silver AS ({silver}) SELECT event_date AS dt, count(*) AS readings, count(DISTINCT equipment_id) AS machines
       FROM silver WHERE event_date > (SELECT max(event_date) FROM silver) - 7 GROUP BY 1"""
)
def s6_lookback_scan(spark, sf_dir):
    """A dt-partitioned copy read over its newest seven partitions, pruned by directory."""
    lake = Lake(spark, lakes.scratch(spark, "lookback"))
    s = silver(spark, sf_dir).withColumns({"dt": F.col("event_date"), "_ingest_batch_id": F.lit("b"), "_ingested_at_utc": F.col("event_time"), "_silver_processed_at_utc": F.col("event_time")})
    version = snapshots.new_version(snapshots.Snapshot())
    layered = s.select(*(f.name for f in schemas.SILVER), F.lit("silver").alias("layer"), "dt")
    layered.hint("rebalance", "dt").write.partitionBy("layer", "dt").parquet(lake.uri(f"{lake.silver}/v={version}"))
    rows = {r["dt"]: r["count"] for r in s.groupBy("dt").count().collect()}  # a row a day
    snapshots.commit(lake, lake.silver, snapshots.Snapshot(), {d: {"version": version, "rows": {"silver": n}} for d, n in rows.items()})
    recent = snapshots.recent(lake, lake.silver, schemas.SILVER, 7)
    return recent.groupBy("dt").agg(F.count("*").alias("readings"), F.count_distinct("equipment_id").alias("machines"))


@query(f"WITH {_DAILY} SELECT {_DAILY_LIST} FROM daily")
def k3_swapped_gold(spark, sf_dir):
    """A mart swapped in twice, first with other rows: readers see the second whole, in slices by machine."""
    lake = Lake(spark, lakes.scratch(spark, "swap"))
    daily = gold.daily_equipment_summary(silver(spark, sf_dir))
    mart = etl.mart(lake, "daily_equipment_summary")
    mart.swap(daily.where("day = (SELECT max(CAST(ts AS DATE)) FROM events)"), ["day"])
    mart.swap(daily, ["day"])
    return rounded(mart.read().drop("slice"))


@query(
    f"""WITH {_DAILY} SELECT {_DAILY_LIST}, CAST(1 AS BIGINT) AS slices_opened FROM daily
        WHERE equipment_id = (SELECT max(equipment_id) FROM daily) AND day > (SELECT max(day) FROM daily) - 14"""
)
def k3_pruned_lookup(spark, sf_dir):
    """A machine's last fourteen days out of a sliced mart, and how many of its slices the plan opened when it ran."""
    lake = Lake(spark, lakes.scratch(spark, "lookup"))
    mart = etl.mart(lake, "daily_equipment_summary")
    mart.swap(gold.daily_equipment_summary(silver(spark, sf_dir)), ["day"], newest_day=F.max("day"), last_machine=F.max("equipment_id"))
    mart.read().createOrReplaceTempView("daily_equipment_summary")
    spark.createDataFrame([(mart.facts()["newest_day"],)], "day string").select(F.col("day").cast("date")).createOrReplaceTempView("daily_newest")
    found = serving.equipment_days(spark, mart.facts()["last_machine"], 14)
    scans, _ = warehouse.scans_read(found)
    opened, known = sum(x.files for x in scans), max(x.known for x in scans)
    return rounded(found).withColumn("slices_opened", F.lit(opened if known > 1 else 0).cast("long"))


@query(
    f"""WITH {_COPIES} SELECT CAST(ts AS DATE) AS dt, count(*) AS readings, count(DISTINCT batch) AS batches, CAST(1 AS BIGINT) AS dates_in_key
        FROM keyed WHERE event_id % 50 <> 49 GROUP BY 1"""
)
def k5_landed_bronze(spark, sf_dir):
    """Readings landed under the date of their own event, and found again by the dates of their files."""
    lake = Lake(spark, lakes.scratch(spark, "land"))
    b = bronze(spark, sf_dir).drop("event_id").withColumn("at", c.event_time(F.col("timestamp"))["at"]).where("at IS NOT NULL")
    lakes.land(b, lake, "batch_0000_a", "at")
    days = spark.createDataFrame([(d, len({lakes.partition_date(k) for k in keys})) for d, keys in lakes.bronze_partitions(lake).items()], "dt date, dates_in_key long")
    landed = lake.read_partitioned(lake.bronze, schemas.BRONZE).groupBy("dt").agg(F.count("*").alias("readings"), F.count_distinct("_ingest_batch_id").alias("batches"))
    return landed.join(days, "dt", "left")


@query(
    f"""SELECT n.dt, CAST(coalesce(o.n, 0) AS BIGINT) AS rows_before, CAST(coalesce(o.n, 0) AS BIGINT) AS rows_held, n.n AS rows_after
        FROM {_BY_DAY} n LEFT JOIN {_BY_DAY.replace("FROM events", "FROM (SELECT * FROM events WHERE event_id % 3 > 0)")} o ON o.dt = n.dt"""
)
def k2_snapshots(spark, sf_dir):
    """Silver before a rebuild, the same snapshot read after it, and the new one: days change all at once."""
    lake = Lake(spark, lakes.scratch(spark, "snapshots"))
    dated = bronze(spark, sf_dir, dated=True)
    by_day = lambda df, name: df.groupBy("dt").agg(F.count("*").alias(name))
    for batch, part in (("batch_0000_a", "event_id % 3 > 0"), ("batch_0100_b", "event_id % 3 = 0")):
        lakes.land(dated.where(part).drop("event_id").withColumn("at", F.col("dt").cast("timestamp")).drop("dt"), lake, batch, "at")
        if batch == "batch_0000_a":
            etl.build_silver(spark, lake, at=_AT)
            held = snapshots.latest(lake, lake.silver)
            counted = [(r["dt"], r["count"]) for r in etl.read_silver(lake).groupBy("dt").count().collect()]  # a row a day
            before = spark.createDataFrame(counted, "dt date, rows_before long")
    etl.build_silver(spark, lake, at=_AT)
    old = by_day(snapshots.read(lake, lake.silver, schemas.SILVER, held), "rows_held")
    new = by_day(etl.read_silver(lake), "rows_after")
    return new.join(before, "dt", "left").join(old, "dt", "left").na.fill(0)


@query(
    f"""WITH {_COPIES} SELECT CAST(ts AS DATE) AS dt, count(*) AS readings, CAST(1 AS BIGINT) AS folders FROM keyed WHERE event_id % 50 <> 49 GROUP BY 1"""
)
def k5_landed_again(spark, sf_dir):
    """A batch landed, landed with other rows and landed once more as it was: as if it had landed once."""
    lake = Lake(spark, lakes.scratch(spark, "again"))
    b = bronze(spark, sf_dir).drop("event_id").withColumn("at", c.event_time(F.col("timestamp"))["at"]).where("at IS NOT NULL")
    for rows in (b, b.withColumn("at", F.col("at") + F.expr("INTERVAL 40 DAYS")), b):
        lakes.land(rows, lake, "batch_0600_a", "at")
    landed = lake.read_partitioned(lake.bronze, schemas.BRONZE).withColumn("_folder", F.regexp_extract(F.input_file_name(), "/dt=[^/]*/([^/]*)/", 1))
    return landed.groupBy("dt").agg(F.count("*").alias("readings"), F.count_distinct("_folder").alias("folders"))


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def s2_read_many(spark, sf_dir):
    """Several files read by their keys as one frame; columns go by name."""
    lake = Lake(spark, lakes.scratch(spark, "many"))
    view(spark, sf_dir, "events")
    for k in range(3):
        part = spark.table("events").where(F.col("event_id") % 3 == k).select("event_id", "event_type")
        (part if k else part.select("event_type", "event_id")).coalesce(1).write.parquet(lake.uri(f"part={k}"))
    schema = spark.table("events").select("event_id", "event_type").schema
    df = lake.read(lake.list_keys(), schema).unionByName(lake.read([], schema))
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    """WITH days AS (SELECT CAST(ts AS DATE) AS dt, max(date_trunc('second', ts)) AS last FROM events GROUP BY 1), silver AS ({silver}),
       window_days AS (SELECT count(*) AS n FROM days WHERE dt >= CAST((SELECT max(event_time) FROM silver) - INTERVAL 24 HOUR AS DATE))
       SELECT 'a key that is not there' AS fact, CAST(0 AS BIGINT) AS n
       UNION ALL SELECT 'cached or stored copies', 0
       UNION ALL SELECT 'days in bronze', count(*) FROM days
       UNION ALL SELECT 'files that a literal predicate opens', count(*) FROM days WHERE dt = (SELECT max(dt) FROM days)
       UNION ALL SELECT 'files that an anchored predicate opens, its anchor included', count(*) FROM days WHERE dt >= (SELECT max(dt) FROM days) - 1
       UNION ALL SELECT 'days in silver', count(*) FROM days
       UNION ALL SELECT 'silver files that the newest two days open', count(*) FROM days WHERE dt >= (SELECT max(dt) FROM days) - 1
       UNION ALL SELECT 'silver files that health over 24 hours opens in a scan', n FROM window_days
       UNION ALL SELECT 'partitions built by a rerun', 0
       UNION ALL SELECT 'partitions built after a file was added', count(*) FROM days WHERE dt = (SELECT max(dt) FROM days)
       UNION ALL SELECT 'unreadable manifests taken for current', 0"""
)
def w_lake_facts(spark, sf_dir):
    """What the lake and its views promise, counted over files made from the stand-in by day.

    The facts are a row each, made at the driver from what plans opened when they ran.  A
    large day takes several files; those of a day's folder count as one.
    """
    lake = Lake(spark, lakes.scratch(spark, "facts"))
    dated = bronze(spark, sf_dir, dated=True).drop("event_id")
    lakes.dealt_for_writing(dated, "dt").write.partitionBy("dt").parquet(lake.uri(lake.bronze))
    before = set(warehouse.materialised_objects(spark))
    warehouse.register_views(spark, lake, ["bronze"])
    days = lakes.bronze_partitions(lake)
    newest = max(days)
    facts = {"a key that is not there": int(lake.exists("raw/none")), "cached or stored copies": len(set(warehouse.materialised_objects(spark)) - before), "days in bronze": len(days)}
    opened = lambda df: [x.folders for x in warehouse.scans_read(df)[0]]
    facts["files that a literal predicate opens"] = sum(opened(spark.sql(f"SELECT * FROM bronze_telemetry WHERE dt = DATE '{newest}'")))
    facts["files that an anchored predicate opens, its anchor included"] = sum(opened(warehouse.statement(spark, warehouse.load_queries()["partition_pruning_demo"])))
    etl.build_silver(spark, lake, at=_AT)
    held = snapshots.latest(lake, lake.silver)
    facts["days in silver"] = len(held.newest())
    facts["silver files that the newest two days open"] = sum(opened(snapshots.recent(lake, lake.silver, schemas.SILVER, 2, held)))
    whole = etl.read_silver(lake)
    gold.machine_presence(whole).write.parquet(lake.uri("presence"))
    flags = gold.fleet_health_flags(whole, 24, _AT, spark.read.parquet(lake.uri("presence")))
    facts["silver files that health over 24 hours opens in a scan"] = max(opened(flags))
    facts["partitions built by a rerun"] = etl.build_silver(spark, lake, at=_AT)["partitions_built"]
    dated.where(F.col("dt") == F.lit(newest)).limit(1).drop("dt").coalesce(1).write.mode("append").parquet(lake.uri(f"{lake.bronze}/dt={newest}"))
    facts["partitions built after a file was added"] = etl.build_silver(spark, lake, at=_AT)["partitions_built"]
    now = snapshots.latest(lake, lake.silver)
    lake.write_bytes(etl.manifest_key(now.days[newest]["version"], newest), b"{broken")
    facts["unreadable manifests taken for current"] = int(etl.is_current(lake, newest, lakes.bronze_partitions(lake)[newest]))
    return spark.createDataFrame(list(facts.items()), "fact string, n long")


# Other operators on the star schema


@query(
    """WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
       g AS (SELECT user_id, event_id, n - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM o WHERE event_type <> 'error')
       SELECT user_id, run, count(*) AS readings, min(event_id) AS first_event, max(event_id) AS last_event FROM g GROUP BY 1, 2"""
)
def s1_consecutive_runs(spark, sf_dir):
    view(spark, sf_dir, "events")
    numbered = windows.runs(spark.table("events"), ["user_id"], "event_id", F.col("event_type") != "error")
    return numbered.groupBy("user_id", F.col("run").cast("bigint").alias("run")).agg(F.count("*").alias("readings"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS weighted_price, count(*) AS n
       FROM lineitem GROUP BY 1, 2"""
)
def s2_weighted_mean(spark, sf_dir):
    view(spark, sf_dir, "lineitem")
    df = spark.table("lineitem")
    mean = windows.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity"))
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.round(mean, 4).alias("weighted_price"), F.count("*").alias("n"))


@query(
    """SELECT c.c_mktsegment, count(DISTINCT c.c_custkey) AS customers, count(o.o_orderkey) AS orders, round(coalesce(sum(o.o_totalprice), 0), 2) AS revenue,
       round_even(100.0::DOUBLE * count(DISTINCT o.o_custkey) / count(DISTINCT c.c_custkey), 2) AS pct_active
       FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1"""
)
def s3_segment_rollup(spark, sf_dir):
    """A zero-filled roll-up by a left join of pre-aggregated orders."""
    view(spark, sf_dir, "customer", "orders")
    by_customer = spark.table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    df = spark.table("customer").join(by_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return df.groupBy("c_mktsegment").agg(
        F.count("c_custkey").alias("customers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("orders"),
        F.round(F.coalesce(F.sum("total"), F.lit(0.0)), 2).alias("revenue"),
        F.bround(F.lit(100.0) * F.count("o_custkey") / F.count("*"), 2).alias("pct_active"),
    )


@query("SELECT p_partkey, p_brand, p_retailprice, CAST(place AS INTEGER) AS place FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS place FROM part) WHERE place <= 3")
def s4_rank_with_ties(spark, sf_dir):
    view(spark, sf_dir, "part")
    place = F.rank().over(W.partitionBy("p_brand").orderBy(F.desc_nulls_last("p_retailprice")))
    return spark.table("part").withColumn("place", place).where("place <= 3").select("p_partkey", "p_brand", "p_retailprice", "place")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY 1")
def s5_split_explode(spark, sf_dir):
    view(spark, sf_dir, "part")
    return spark.sql("SELECT word, count(*) AS n FROM part LATERAL VIEW explode(split(p_type, ' ')) t AS word GROUP BY word")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events""")
def k8_json_safe(spark, sf_dir):
    view(spark, sf_dir, "events")
    spoilt = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("value"))
    return c.json_safe(spark.table("events").select("event_id", "ts", spoilt.alias("value")))
