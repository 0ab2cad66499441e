"""Bronze to silver to gold to warehouse to serving, on a throwaway lake of the stand-in's readings."""

import json
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from seamline import config, schemas
from seamline.operators import gold
from seamline.plans import etl, serving, standins, warehouse
from seamline.sources import lake as lakes
from seamline.sources import snapshots
from seamline.sources.lake import Lake
from seamline.streaming import silver as streaming

AT = datetime(2024, 2, 1, tzinfo=timezone.utc)
SMALL = "/root/testdata/sf0.001"


def landed(spark, lake, where="true", batch="batch_0000_a"):
    rows = standins.bronze(spark, SMALL, dated=True).where(where).drop("event_id")
    return lakes.land(rows.withColumn("at", F.col("dt").cast("timestamp")).drop("dt"), lake, batch, "at")


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = "file://" + str(tmp_path_factory.mktemp("lake"))
    landed(spark, Lake(spark, path))
    return path


@pytest.fixture(scope="module")
def built(spark, root):
    return etl.run_etl(spark, root, at=AT, window_hours=480)


@pytest.fixture(scope="module")
def day(spark, root, built):
    return sorted(snapshots.latest(Lake(spark, root), lakes.SILVER).days)[-2]


def test_silver(spark, root, built):
    s = built["silver"]
    assert s["rows_in"] == s["rows_out"] + s["rows_quarantined"] + s["duplicates_removed"] and s["duplicates_removed"] > 0
    silver = etl.read_silver(Lake(spark, root))
    assert silver.count() == s["rows_out"]
    assert schemas.null_violations(silver, schemas.SILVER) == {}
    assert silver.groupBy("dt", "equipment_id", "event_time").count().where("count > 1").isEmpty()
    assert silver.where("event_date <> dt").isEmpty()
    assert {r[0] for r in silver.select("equipment_type").distinct().collect()} == set(schemas.EQUIPMENT_TYPES)
    for name, (low, high) in schemas.VALID_RANGES.items():
        assert silver.where(~F.col(name).between(low, high)).isEmpty()


def frozen(df):
    columns = [f.name for f in schemas.SILVER]
    return df.select(*columns).toPandas().sort_values(["equipment_id", "event_time"]).reset_index(drop=True)


def test_rerun_skips_and_refresh_repeats(spark, root, built, day):
    lake = Lake(spark, root)
    assert etl.build_silver(spark, root, at=AT)["partitions_built"] == 0
    before = frozen(etl.read_silver(lake))
    etl.build_silver(spark, root, dates=[day], full_refresh=True, at=AT)
    assert before.equals(frozen(etl.read_silver(lake)))
    version = snapshots.latest(lake, lake.silver).days[day]["version"]
    lake.write_bytes(etl.manifest_key(version, day), b"{broken")
    assert etl.build_silver(spark, root, at=AT)["partitions_built"] == 1


def test_summary_counts_what_cleaning_counts(spark, root, built):
    lake = Lake(spark, root)
    audit = etl.cleaning.clean(lake.with_source(lake.read_partitioned(lake.bronze, schemas.BRONZE)), AT).audit()
    s = built["silver"]
    assert s["flags"] == audit["flags"] and s["reject_reasons"] == audit["reject_reasons"]
    assert {n: s[n] for n in ("rows_in", "rows_out", "rows_quarantined", "duplicates_removed")} == {n: audit[n] for n in ("rows_in", "rows_out", "rows_quarantined", "duplicates_removed")}
    assert etl.read_silver(lake, "quarantine").count() == s["rows_quarantined"]


def test_gold(spark, root, built):
    lake = Lake(spark, root)
    daily, flags, fleet = (etl.mart(lake, n).read() for n in ("daily_equipment_summary", "fleet_health_flags", "fleet_summary_by_type"))
    assert daily.groupBy("equipment_id", "day").count().where("count > 1").isEmpty()
    assert daily.where("operating_hours < 0 OR fuel_consumed_pct < 0").isEmpty()
    assert flags.where("health_score < 0 OR health_score > 100").isEmpty()
    assert fleet.agg(F.sum("machines_flagged")).first()[0] == flags.count() > 0


def test_flags_are_the_same_with_a_written_presence(spark, root, built):
    lake = Lake(spark, root)
    silver = etl.read_silver(lake)
    presence = etl.mart(lake, "machine_presence").read()
    for hours in (1, 24, 480):
        a, b = gold.fleet_health_flags(silver, hours, AT), gold.fleet_health_flags(silver, hours, AT, presence)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_health_opens_only_its_window(spark, root, built):
    lake = Lake(spark, root)
    base = snapshots.latest(lake, lake.silver)
    presence = etl.mart(lake, "machine_presence").read()
    scans, _ = warehouse.scans_read(gold.fleet_health_flags(etl.read_silver(lake), 24, AT, presence))
    of_silver = [x for x in scans if x.known >= len(base.newest())]
    assert len(base.newest()) > 20 and of_silver and max(x.files for x in of_silver) <= 2
    recent, _ = warehouse.scans_read(snapshots.recent(lake, lake.silver, schemas.SILVER, 3, base))
    assert [x.files for x in recent] == [3] and [x.known for x in recent] == [3]


def test_subqueries_count_as_reads(spark, root, built):
    warehouse.register_views(spark, root)
    known = spark.sql("SELECT * FROM bronze_telemetry")
    every = warehouse.files_read(known)[0]
    by_files = spark.sql("SELECT * FROM bronze_telemetry WHERE dt >= date_sub((SELECT max(dt) FROM bronze_telemetry), 1)")
    scans, _ = warehouse.scans_read(by_files)
    assert {x.role: x.files for x in scans} == {"main": 2, "subquery": every}
    by_names = spark.sql("SELECT * FROM bronze_telemetry WHERE dt >= date_sub((SELECT max(dt) FROM bronze_days), 1)")
    assert warehouse.files_read(by_names)[0] == 2
    twice = spark.sql("SELECT * FROM bronze_telemetry WHERE dt = (SELECT max(dt) FROM bronze_telemetry) OR dt = (SELECT max(dt) FROM bronze_telemetry) - 3")
    assert warehouse.files_read(twice)[0] == every + 2


def test_quarantine_is_replaced(spark, tmp_path):
    root = "file://" + str(tmp_path)
    lake = Lake(spark, root)
    rows = [("E1", "dozer", "not-a-timestamp", "b1"), ("E1", "dozer", "2026-08-18T00:00:00Z", "b1")]
    df = spark.createDataFrame(rows, "equipment_id string, equipment_type string, timestamp string, _ingest_batch_id string")
    df = df.withColumns({n: F.lit(1.0) for n in schemas.SENSORS} | {"fault_code": F.lit(None).cast("string"), "_ingested_at_utc": F.current_timestamp(), "dt": F.lit("2026-08-18")})
    df.write.partitionBy("dt").parquet(lake.uri(lakes.BRONZE))
    assert etl.build_silver(spark, root, at=AT)["rows_quarantined"] == 1
    refused = etl.read_silver(lake, "quarantine")
    assert refused.count() == 1 and refused.columns == [*(f.name for f in schemas.QUARANTINE), "dt"]
    lake.delete_prefix(lakes.BRONZE)
    df.where("timestamp LIKE '2026%'").write.partitionBy("dt").parquet(lake.uri(lakes.BRONZE))
    assert etl.build_silver(spark, root, at=AT)["rows_quarantined"] == 0
    assert etl.read_silver(lake, "quarantine").isEmpty()
    entry = snapshots.latest(lake, lake.silver).days[date(2026, 8, 18)]
    assert json.loads(lake.read_bytes(etl.manifest_key(entry["version"], date(2026, 8, 18))))["rows_out"] == 1


def test_warehouse(spark, root, built, capsys):
    assert warehouse.main([root, "--query", "no_such"], spark) == 2
    assert warehouse.main([root, "--require-rows", "--query", "fault_code_pareto", "--query", "data_quality_report", "--query", "fleet_utilisation"], spark) == 0
    assert "vital few" in capsys.readouterr().out
    assert warehouse.main(["file:///nowhere/at/all"], spark) == 1
    assert warehouse.main([root, "--analyze", "--query", "partition_pruning_demo"], spark) == 0
    out = capsys.readouterr().out
    assert "files read: " in out and "rows: 2" in out and "isFinalPlan=true" in out
    assert warehouse.materialised_objects(spark) == []
    for q in warehouse.load_queries().values():
        warehouse.statement(spark, q, 5).collect()
    assert "PartitionFilters" in warehouse.explain(spark, warehouse.load_queries()["partition_pruning_demo"])
    with pytest.raises(warehouse.MissingLayerError):
        warehouse.register_views(spark, "file:///nowhere/at/all", ["bronze"])


def test_partition_predicates_open_fewer_files(spark, root, built):
    warehouse.register_views(spark, root)
    every, rows = warehouse.files_read(spark.sql("SELECT * FROM bronze_telemetry"))
    one, fewer = warehouse.files_read(spark.sql("SELECT * FROM bronze_telemetry WHERE dt = DATE '2024-01-19'"))
    assert 0 < one < every and 0 < fewer < rows == spark.table("bronze_telemetry").count()


def test_serving(spark, root, built):
    warehouse.register_views(spark, root)
    assert serving.health(spark)["status"] == "ok"
    summary = serving.fleet_summary(spark)
    machines = etl.read_silver(Lake(spark, root)).select("equipment_id", "equipment_type").distinct().count()  # the stand-in reads a machine as several types
    assert summary["fleet_size"] == machines and len(summary["by_type"]) == 4 and summary["generated_at_utc"] == "2024-02-01T00:00:00Z"
    roster = serving.rows(serving.equipment(spark, " Excavator "))
    assert roster and all(r["equipment_type"] == "excavator" for r in roster)
    assert len(serving.rows(serving.equipment(spark, flagged_only=True))) == spark.table("fleet_health_flags").count()
    history = serving.equipment_history(spark, roster[0]["equipment_id"], 31)
    assert len(history["history"]) == spark.table("daily_equipment_summary").where(F.col("equipment_id") == roster[0]["equipment_id"]).count() > 0
    with pytest.raises(LookupError):
        serving.equipment_history(spark, "nobody")
    with pytest.raises(ValueError):
        serving.health_flags(spark, severity="mild")
    with pytest.raises(ValueError):
        serving.equipment_days(spark, "x", 0)
    cards = serving.scoped(spark.table("fleet_summary_by_type")).first()
    assert cards["machines"] == machines
    assert serving.by_urgency(spark.table("fleet_health_flags")).count() == cards["machines_flagged"]


def test_storage(spark, tmp_path):
    lake = Lake(spark, "file://" + str(tmp_path))
    assert lake.list_keys("missing") == [] and not lake.exists("x")
    lake.write_bytes("a/b.json", b"{}")
    assert lake.read_bytes("a/b.json") == b"{}" and lake.list_keys("a", ".json") == ["a/b.json"]
    assert lake.read([], schemas.DAILY).columns == [f.name for f in schemas.DAILY]
    assert lake.delete_prefix("a") == 1 and not lake.exists("a/b.json")
    assert lakes.partition_date("raw/dt=2026-08-19/x.parquet") == date(2026, 8, 19)
    assert lakes.partition_date("raw/2026-08-19/x.parquet") is None


def test_config(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert config.get_settings({}).root == f"file://{tmp_path}/data"
    assert config.get_settings({"LAKE_LOCAL_ROOT": "hdfs://n/lake/"}).root == "hdfs://n/lake/"
    with pytest.raises(ValueError):
        config.get_settings({"LAKE_BACKEND": "azure"})
    azure = {"LAKE_BACKEND": "azure", "AZURE_STORAGE_CONNECTION_STRING": "DefaultEndpointsProtocol=https;AccountName=a;AccountKey=k==;EndpointSuffix=core.windows.net", "AZURE_BLOB_CONTAINER": "c"}
    found = config.get_settings(azure)
    assert found.root == "abfss://c@a.dfs.core.windows.net" and found.storage == {"spark.hadoop.fs.azure.account.key.a.dfs.core.windows.net": "k=="}
    for bad in ({"LAKE_BACKEND": "ftp"}, {"FLEET_SIZE": "many"}, {"FLEET_SIZE": "0"}):
        with pytest.raises(ValueError):
            config.get_settings(bad)
    named = config.get_settings({"BRONZE_PREFIX": "/b/", "SILVER_PREFIX": "s", "GOLD_PREFIX": "g", "FLEET_SIZE": "7", "GENERATOR_SEED": "3"})
    assert named.prefixes() == {"bronze": "b", "silver": "s", "gold": "g"} and (named.fleet_size, named.seed) == (7, 3)


def test_commands_use_the_settings(spark, tmp_path, monkeypatch, capsys):
    for name, value in {"LAKE_LOCAL_ROOT": str(tmp_path), "BRONZE_PREFIX": "b", "SILVER_PREFIX": "s/v", "GOLD_PREFIX": "g"}.items():
        monkeypatch.setenv(name, value)
    landed(spark, lakes.configured(spark, config.get_settings()))
    assert etl.main([], spark) == 0
    assert warehouse.main(["--query", "fleet_utilisation", "--require-rows"], spark) == 0
    assert "fleet_hours" in capsys.readouterr().out
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith("_")) == ["b", "g", "s"]


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "audit", "nulls", "manifest", "commit", "rename"])
def test_a_stop_at_any_step_loses_no_day(spark, tmp_path, monkeypatch, step):
    """A rebuild that stops anywhere leaves readers with what they had, and the next run goes through."""
    lake = Lake(spark, "file://" + str(tmp_path))
    landed(spark, lake, "event_id % 4 > 0")
    etl.build_silver(spark, lake, at=AT)
    before, held = frozen(etl.read_silver(lake)), snapshots.latest(lake, lake.silver)
    landed(spark, lake, "event_id % 4 = 0", "batch_0100_b")

    def stops(*a, **b):
        raise Stop

    def second(f, calls=[]):  # noqa: B006
        def run(*a, **b):
            calls.append(a)
            if len(calls) > 1:
                raise Stop
            return f(*a, **b)

        return run

    if step == "write":
        monkeypatch.setattr(etl, "_write_version", stops)
    elif step == "audit":
        monkeypatch.setattr(etl.cleaning, "reconcile", second(etl.cleaning.reconcile))
    elif step == "nulls":
        monkeypatch.setattr(etl, "_write_version", lambda *a, f=etl._write_version: f(*a) | {"null_event_time": 1})
    elif step == "manifest":
        monkeypatch.setattr(etl, "manifest_key", second(etl.manifest_key))
    elif step == "commit":
        monkeypatch.setattr(snapshots, "commit", stops)
    else:
        monkeypatch.setattr(Lake, "_renamed", stops)
    with pytest.raises(ValueError if step == "nulls" else Stop):
        etl.build_silver(spark, lake, full_refresh=True, at=AT)
    monkeypatch.undo()
    assert snapshots.latest(lake, lake.silver) == held and before.equals(frozen(etl.read_silver(lake)))
    assert [n for n in lake.list_names(lake.silver) if n.startswith("v=")] == sorted({f"v={e['version']}" for e in held.days.values()})
    old = snapshots.read(lake, lake.silver, schemas.SILVER, held)
    etl.build_silver(spark, lake, at=AT)
    assert before.equals(frozen(old)) and len(frozen(etl.read_silver(lake))) > len(before)


def test_two_builds_of_a_day_conflict_and_of_two_days_do_not(spark, tmp_path):
    lake = Lake(spark, "file://" + str(tmp_path))
    one, two = date(2024, 1, 1), date(2024, 1, 2)

    def entry(base):
        version = snapshots.new_version(base)
        lake.write_bytes(f"silver/v={version}/x", b"")
        return {"version": version, "fingerprint": "f", "rows": {"silver": 1}}

    base = snapshots.latest(lake, "silver")
    snapshots.commit(lake, "silver", base, {one: entry(base)})
    after = snapshots.commit(lake, "silver", base, {two: entry(base)})  # began before the first was committed
    assert after.number == 2 and sorted(after.days) == [one, two] and snapshots.latest(lake, "silver") == after
    with pytest.raises(snapshots.ConflictError):
        snapshots.commit(lake, "silver", base, {one: entry(base)})
    lake.write_bytes("silver/_snapshots/000000000003.json", b"{broken")
    assert snapshots.latest(lake, "silver") == after
    assert snapshots.commit(lake, "silver", after, {one: entry(after)}).number == 4
    with pytest.raises(snapshots.ConflictError):
        snapshots.commit(lake, "silver", after, {two: {"version": "000000000001-gone", "fingerprint": "f", "rows": {}}})


def test_old_versions_go_but_not_the_last_ones(spark, tmp_path):
    lake = Lake(spark, "file://" + str(tmp_path))
    landed(spark, lake)
    for _ in range(snapshots.KEPT + 3):
        etl.build_silver(spark, lake, dates=[date(2024, 1, 5)], full_refresh=True, at=AT)
    held = [n for n in lake.list_names(lake.silver) if n.startswith("v=")]
    assert snapshots.KEPT <= len(held) <= snapshots.KEPT + 1 and len(snapshots._numbers(lake, lake.silver)) == snapshots.KEPT
    assert etl.read_silver(lake).count() > 0


def test_a_batch_landed_again_replaces_itself(spark, tmp_path):
    lake = Lake(spark, "file://" + str(tmp_path))
    landed(spark, lake)
    n = lake.read_partitioned(lake.bronze, schemas.BRONZE).count()
    landed(spark, lake, "event_id % 2 = 0", "batch_0100_b")
    landed(spark, lake, "day(dt) > 3", "batch_0000_a")
    landed(spark, lake)
    both = lake.read_partitioned(lake.bronze, schemas.BRONZE).count()
    lake.delete_prefix(f"{lake.bronze}/dt=2024-01-02/batch_0000_a")  # as after a stop between two renames
    landed(spark, lake)
    assert n < both == lake.read_partitioned(lake.bronze, schemas.BRONZE).count()
    assert {k.split("/")[2] for k in lake.list_keys(lake.bronze)} == {"batch_0000_a", "batch_0100_b"}
    with pytest.raises(ValueError, match="batch"):
        landed(spark, lake, batch="../x")


def test_gold_with_nulls_is_refused(spark, tmp_path):
    lake = Lake(spark, "file://" + str(tmp_path))
    good = spark.createDataFrame([("dozer", 3)], "equipment_type string, machine_count long").select("*", *(F.lit(0).alias(f.name) for f in schemas.FLEET if f.name not in ("equipment_type", "machine_count", "generated_at_utc")), F.current_timestamp().alias("generated_at_utc"))
    assert lake.swap_single(good, "gold/x.parquet", schemas.FLEET) == 1
    with pytest.raises(ValueError, match="machine_count"):
        lake.swap_single(good.withColumn("machine_count", F.lit(None)), "gold/x.parquet", schemas.FLEET)
    assert lake.read(["gold/x.parquet"], schemas.FLEET).first()["machine_count"] == 3


def test_a_mart_is_swapped_whole(spark, tmp_path, monkeypatch):
    lake = Lake(spark, "file://" + str(tmp_path))
    mart = lakes.Mart(lake, "gold/x", schemas.PRESENCE, "equipment_id")
    rows = lambda n: spark.range(n).selectExpr("concat('m', id % 40) AS equipment_id", "'dozer' AS equipment_type", "timestamp'2024-01-01' AS last_seen_utc", "timestamp'2024-01-01' AS last_loaded_utc")
    assert not mart.exists() and mart.read().isEmpty()
    assert mart.swap(rows(100)) == 100
    old = mart.read()
    with pytest.raises(ValueError, match="last_seen_utc"):
        mart.swap(rows(50).withColumn("last_seen_utc", F.lit(None).cast("timestamp")))
    monkeypatch.setattr(Lake, "_renamed", lambda *a, **b: (_ for _ in ()).throw(Stop))
    with pytest.raises(Stop):
        mart.swap(rows(60))
    monkeypatch.undo()
    assert mart.read().count() == 100 and len(lake.list_names("gold/x")) == 2
    assert mart.swap(rows(70), seen=F.max("last_seen_utc")) == 70 and mart.facts() == {"seen": "2024-01-01 00:00:00"}
    assert old.count() == 100 and mart.read().count() == 70  # a reader that had begun goes on
    mart.swap(rows(80))
    assert len([n for n in lake.list_names("gold/x") if n.startswith("v=")]) == 2


def test_a_lookup_opens_one_slice(spark, root, built):
    warehouse.register_views(spark, root)
    who = spark.table("daily_equipment_summary").first()["equipment_id"]
    every = warehouse.files_read(spark.table("daily_equipment_summary"))[0]
    for df in (serving.equipment_days(spark, who, 30), serving.equipment_flag(spark, who), serving.equipment_identity(spark, who)):
        assert "slice" not in df.columns and warehouse.files_read(df)[0] <= 1 < every
    assert serving.equipment_days(spark, who, 30).count() == spark.table("daily_equipment_summary").where((F.col("equipment_id") == who) & (F.col("day") > F.lit("2024-01-30").cast("date") - F.expr("INTERVAL 30 DAYS"))).count()


def test_values_are_bound_not_spelled(spark, root, built):
    warehouse.register_views(spark, root)
    assert serving.equipment_days(spark, "x' OR '1' = '1", 3).isEmpty()
    assert serving.equipment(spark, "dozer' OR 'a' = 'a").isEmpty()
    every, dozers = serving.health_flags(spark, limit=5000), serving.health_flags(spark, "dozer", "critical", 5000)
    assert every.count() == spark.table("fleet_health_flags").count()
    assert dozers.count() == spark.table("fleet_health_flags").where("equipment_type = 'dozer' AND severity = 'critical'").count()
    assert serving.health_flags(spark, limit=1).count() == 1


def test_a_large_day_takes_several_files(spark, tmp_path):
    lake = Lake(spark, "file://" + str(tmp_path))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(0, 40_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("_ingest_batch_id"), F.when(F.col("id") < 39_000, F.lit("2026-08-18")).otherwise("2026-08-19").cast("timestamp").alias("event_time"))
        lakes.land(rows, lake, "b")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(lake.list_keys("raw/dt=2026-08-18")) > 3 and len(lake.list_keys("raw/dt=2026-08-19")) == 1
    assert lake.read_partitioned("raw", schemas.BRONZE).count() == 40_000


def test_streaming_matches_batch_keys(spark, root, built, tmp_path):
    lake = Lake(spark, root)
    stream = streaming.to_silver(streaming.read_bronze(spark, lake.uri(lakes.BRONZE)), "100 days")
    streaming.start(stream, str(tmp_path / "silver"), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "silver")).select("equipment_id", "event_time")
    want = etl.read_silver(lake).select("equipment_id", "event_time").distinct()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
