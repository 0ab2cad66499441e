from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from seamline.operators import gold, windows

T0 = datetime(2026, 8, 20, tzinfo=timezone.utc)
DDL = "equipment_id string, equipment_type string, event_time timestamp, engine_hours double, fuel_level_pct double, coolant_temp_c double, oil_pressure_psi double, gps_lat double, gps_lon double, fault_code string"


def silver(spark, readings, machine="M1", kind="dozer"):
    """Readings of {minutes, run, fuel, temp, oil, hours, lat, lon, code}."""
    rows = []
    for r in readings:
        run = r.get("run", True)
        oil = r.get("oil", 45.0 if run else 0.0)
        rows.append((machine, kind, T0 + timedelta(minutes=r["m"]), r.get("hours"), r.get("fuel"), r.get("temp"), oil, r.get("lat"), r.get("lon"), r.get("code")))
    df = spark.createDataFrame(rows, DDL)
    return df.withColumns({"event_date": F.to_date("event_time"), "has_fault": F.col("fault_code").isNotNull(), "is_under_load": F.col("oil_pressure_psi") > 5.0})


def test_settled_restarts_after_a_stop(spark):
    readings = [{"m": 5 * i, "run": i != 12} for i in range(25)]
    rows = windows.settled(silver(spark, readings)).orderBy("event_time").select("settled").collect()
    assert [i for i, r in enumerate(rows) if r[0]] == [9, 10, 11, 22, 23, 24]


def test_fuel_and_hours(spark):
    levels = [60.0, 50.0, None, 40.0, 95.0, 90.0]
    row = gold.daily_equipment_summary(silver(spark, [{"m": 5 * i, "fuel": f, "hours": 10 + i / 100} for i, f in enumerate(levels)])).first()
    assert (row["fuel_consumed_pct"], row["refuel_events"]) == (25.0, 1)
    assert row["operating_hours"] == pytest.approx(0.05) and row["fuel_burn_pct_per_hour"] is not None or row["operating_hours"] < 0.05
    row = gold.daily_equipment_summary(silver(spark, [{"m": 0, "fuel": 50.0}])).first()
    assert (row["fuel_consumed_pct"], row["refuel_events"], row["operating_hours"], row["fuel_burn_pct_per_hour"]) == (None, 0, None, None)
    row = gold.daily_equipment_summary(silver(spark, [{"m": 0, "fuel": 50.0, "hours": 1.0}, {"m": 5, "fuel": 49.0, "hours": 1.04}])).first()
    assert row["fuel_burn_pct_per_hour"] is None


def test_last_position_needs_both_axes(spark):
    row = gold.daily_equipment_summary(silver(spark, [{"m": 0, "lat": 1.0, "lon": 2.0}, {"m": 5, "lat": 3.0, "lon": None}])).first()
    assert (row["last_gps_lat"], row["last_gps_lon"]) == (1.0, 2.0)


def test_window_settles_anew(spark):
    # running for 30 h; the 24 h window loses its own first nine readings
    df = silver(spark, [{"m": 5 * i, "temp": 90.0} for i in range(360)])
    health = gold.machine_health(df, 24, T0).first()
    assert health["_settled"] == health["readings_in_window"] - 9 == 289 - 9
    assert windows.settled(df).where("settled").count() == 360 - 9


def test_slope_needs_twelve_pairs_and_spread(spark):
    def slope(n):
        df = silver(spark, [{"m": 5 * i, "temp": 80.0 + i} for i in range(9 + n)])
        return gold.machine_health(df, 24, T0).first()["temp_trend_c_per_hour"]

    assert slope(11) is None
    assert slope(12) == pytest.approx(12.0)


def test_fault_storm_scores(spark):
    readings = [{"m": 5 * i, "code": "A" if i < 25 else None} for i in range(30)]
    row = gold.fleet_health_flags(silver(spark, readings), 24, T0).first()
    assert row["flag_reasons"] == "repeated_faults,fault_storm,recurring_fault_code"
    assert (row["severity"], row["health_score"], row["top_fault_code"]) == ("critical", 45.0, "A")


def test_stale_at_exactly_three_hours(spark):
    df = silver(spark, [{"m": 0}]).unionByName(silver(spark, [{"m": 180}], "M2"))
    rows = gold.fleet_health_flags(df, 24, T0).collect()
    assert [(r["equipment_id"], r["flag_reasons"], r["severity"], r["health_score"]) for r in rows] == [("M1", "stale_telemetry", "warning", 90.0)]


def test_top_by_frequency_ties_low(spark):
    df = spark.createDataFrame([("m", x) for x in ["B", "A", "B", "A", None]], "k string, v string")
    assert tuple(windows.top_by_frequency(df, ["k"], "v").first()) == ("m", "A", 2)


def test_weighted_mean_ignores_nothing_weights(spark):
    df = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0), (99.0, 0.0), (99.0, None), (None, 5.0)], "v double, w double")
    assert df.agg(windows.weighted_mean(F.col("v"), F.col("w"))).first()[0] == 17.5


def test_fleet_summary_zero_fills_and_rounds_half_even(spark):
    df = silver(spark, [{"m": 0, "temp": 90.0}], "M0")
    for i in range(1, 32):
        df = df.unionByName(silver(spark, [{"m": 0}], f"M{i}"))
    df = df.unionByName(silver(spark, [{"m": 0}], "L1", "loader")).cache()
    daily = gold.daily_equipment_summary(df)
    flags = spark.createDataFrame([("M0", "dozer", "critical")], "equipment_id string, equipment_type string, severity string")
    rows = {r["equipment_type"]: r for r in gold.fleet_summary_by_type(df, daily, flags, T0).collect()}
    assert (rows["dozer"]["machine_count"], rows["dozer"]["machines_flagged"], rows["dozer"]["pct_flagged"]) == (32, 1, 3.12)
    assert (rows["loader"]["machines_flagged"], rows["loader"]["critical_count"], rows["loader"]["pct_flagged"]) == (0, 0, 0.0)
    empty = gold.fleet_summary_by_type(df, daily.limit(0), flags.limit(0), T0).collect()
    assert all(r["avg_coolant_temp_c"] is None and r["total_fault_codes"] == 0 for r in empty)


def shuffled(df):
    """Columns of each hash exchange of a plan."""
    found, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName()
        children = node.initialPlan().children() if kind == "AdaptiveSparkPlanExec" else node.children()
        if kind == "AdaptiveSparkPlanExec":
            stack.append(node.initialPlan())
            continue
        if kind == "ShuffleExchangeExec" and "hashpartitioning" in node.outputPartitioning().toString():
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
        stack.extend(children.apply(i) for i in range(children.size()))
    return found


def test_one_shuffle_for_daily(spark):
    """Rows with their sensors are shuffled once; times and running states once more, then a row a machine and day."""
    df = silver(spark, [{"m": 0}])
    daily = gold.daily_equipment_summary(df)
    plan = daily._jdf.queryExecution().executedPlan().toString()
    found = shuffled(daily)
    assert sum("coolant_temp_c" in c for c in found) == 1 and len(found) <= 4 and "PythonUDF" not in plan and "ArrowEval" not in plan
    others = [c for c in found if "coolant_temp_c" not in c]
    assert all({n for n in c if not n.startswith("_")} <= {"equipment_id", "event_date", "event_time", "is_under_load"} for c in others), others


def spells(rows, warmup):
    """Plain pass over (machine, time, running, level): {(machine, time): (settled, change to the last known level)}."""
    found, run, last = {}, {}, {}
    for m, t, on, level in sorted(rows):
        run[m] = run.get(m, 0) + 1 if on else 0
        found[m, t] = (run[m] > warmup, None if level is None or last.get(m) is None else level - last[m])
        last[m] = level if level is not None else last.get(m)
    return found


def test_segments_carry_spells_and_levels(spark):
    import random
    from datetime import datetime, timedelta

    r, rows = random.Random(2), []
    for m in ("a", "b", "c"):
        at = datetime(2024, 1, 1)
        for _ in range(400):
            at += timedelta(hours=r.choice([0.5, 1, 2, 30]))
            rows.append((m, at, r.random() < (0.97 if m != "c" else 0.6), r.choice([None, None, r.randint(0, 9)])))
    rows += [("all on", datetime(2024, 1, 1) + timedelta(hours=9 * k), True, None) for k in range(60)]
    rows += [("unknown", datetime(2024, 1, 1) + timedelta(hours=9 * k), None, 5) for k in range(9)]
    df = spark.createDataFrame(rows, "equipment_id string, event_time timestamp, is_under_load boolean, level int").repartition(5)
    got = windows.level_change(windows.settled(df, warmup=7), "level")
    assert got.columns == ["equipment_id", "event_time", "is_under_load", "level", "settled", "level_change"]
    assert {(x["equipment_id"], x["event_time"]): (x["settled"], x["level_change"]) for x in got.collect()} == spells(rows, 7)


def test_a_machine_with_most_rows_is_many_tasks(spark):
    """Half of all rows are one machine's: no task of the windows holds more than a few of its days."""
    rows = spark.range(40_000).selectExpr(
        "IF(id % 2 = 0, 'hot', concat('m', id % 97)) AS equipment_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 60) AS event_time", "id % 50 > 3 AS is_under_load"
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        tasks = windows.settled(rows).where("equipment_id = 'hot'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.count_if("settled")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r["count"] for r in tasks) == 20_000 and len(tasks) >= 15 and max(r["count"] for r in tasks) < 5_000
