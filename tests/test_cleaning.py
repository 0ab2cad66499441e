from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from seamline import schemas
from seamline.operators import cleaning

AT = datetime(2026, 8, 20, tzinfo=timezone.utc)


def bronze(spark, rows):
    """Rows of (id, type, timestamp, oil, lat, lon, batch, ingest second)."""
    df = spark.createDataFrame(rows, "equipment_id string, equipment_type string, timestamp string, oil_pressure_psi double, gps_lat double, gps_lon double, _ingest_batch_id string, s long")
    df = df.withColumns({"engine_hours": F.lit(1.0), "fuel_level_pct": F.lit(50.0), "coolant_temp_c": F.lit(90.0), "fault_code": F.lit(" "), "_ingested_at_utc": F.timestamp_seconds("s")})
    return df.select(*(f.name for f in schemas.BRONZE))


def test_dedup_keeps_the_earliest_and_counts_resends(spark):
    t = "2026-08-19T09:55:00Z"
    rows = [("A", "dozer", t, 40.0, 1.0, 1.0, "B2", 2), ("A", "dozer", t, 41.0, 1.0, 1.0, "B1", 1), ("A", "dozer", t, 41.0, 1.0, 1.0, "B1", 1)]
    result = cleaning.clean(bronze(spark, rows), AT)
    assert [r["_ingest_batch_id"] for r in result.silver.collect()] == ["B1"]
    audit = result.audit()
    assert (audit["exact_resends"], audit["cross_batch_resends"], audit["rows_out"]) == (1, 1, 1)
    cleaning.reconcile(audit)


def test_quarantine_reasons_keep_raw_values(spark):
    good = "2026-08-18T00:00:00Z"
    rows = [
        (None, "dozer", good, 1.0, 1.0, 1.0, "d", 1), ("", "dozer", good, 1.0, 1.0, 1.0, "d", 1), ("E1", " Crane", good, 1.0, 1.0, 1.0, "d", 1),
        ("E2", "dozer", "not-a-timestamp", 1.0, 1.0, 1.0, "d", 1), ("E3", "dozer", "", 1.0, 1.0, 1.0, "d", 1), ("E4", "dozer", "2026-08-18T25:99:99Z", 1.0, 1.0, 1.0, "d", 1),
    ]
    result = cleaning.clean(bronze(spark, rows), AT)
    assert result.silver.isEmpty()
    reasons = {(r["equipment_id"], r["reject_reason"], r["equipment_type"]) for r in result.quarantine.collect()}
    assert reasons == {
        (None, "missing_equipment_id", "dozer"), ("", "missing_equipment_id", "dozer"), ("E1", "unknown_equipment_type", " Crane"),
        ("E2", "unparseable_timestamp", "dozer"), ("E3", "unparseable_timestamp", "dozer"), ("E4", "unparseable_timestamp", "dozer"),
    }
    assert result.audit()["rows_quarantined"] == 6


def test_positions_and_load(spark):
    def at(k):
        return f"2026-08-19T09:5{k}:00Z"

    rows = [("A", "dozer", at(0), 5.0, 0.0, 0.0, "b", 1), ("A", "dozer", at(1), 5.01, 0.0, 5.0, "b", 1), ("A", "dozer", at(2), None, 91.0, 0.0, "b", 1), ("A", "dozer", at(3), 640.0, 2.0, 3.0, "b", 1)]
    result = cleaning.clean(bronze(spark, rows), AT)
    found = [tuple(r) for r in result.silver.orderBy("event_time").select("gps_lat", "gps_lon", "is_under_load", "quality_flags", "has_fault").collect()]
    assert found == [(None, None, False, "gps_null_island", False), (0.0, 5.0, True, None, False), (None, 0.0, False, "gps_lat_out_of_range", False), (2.0, 3.0, False, "oil_pressure_psi_out_of_range", False)]
    assert result.audit()["values_nulled"]["gps_lat"] == 2


def test_empty_and_mismatch(spark):
    result = cleaning.clean(bronze(spark, []), AT)
    assert result.silver.isEmpty() and result.quarantine.isEmpty()
    cleaning.reconcile(result.audit())
    with pytest.raises(ValueError):
        cleaning.reconcile({"rows_in": 2, "rows_out": 1, "rows_quarantined": 0, "duplicates_removed": 0})


def test_conform(spark):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    with pytest.raises(KeyError):
        schemas.conform(df, schemas.DAILY)
    assert schemas.null_violations(spark.createDataFrame([(None,)], "_ingest_batch_id string").withColumn("_ingested_at_utc", F.current_timestamp()), schemas.BRONZE) == {"_ingest_batch_id": 1}
