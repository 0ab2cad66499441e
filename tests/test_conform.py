from datetime import datetime

import pytest
from pyspark.sql import functions as F

from seamline.functions import conform as c

GOOD = {
    "2026-08-19T09:55:00Z": ("2026-08-19T09:55:00", False),
    "2026-08-19T17:55:00+08:00": ("2026-08-19T09:55:00", False),
    "2026-08-19T17:55:00+0800": ("2026-08-19T09:55:00", False),
    "2026-08-19T19:25:00+09:30": ("2026-08-19T09:55:00", False),
    "2026-08-19 17:55:00 +08:00": ("2026-08-19T09:55:00", False),
    "2026-08-19T09:55:00-02:00": ("2026-08-19T11:55:00", False),
    "2026-08-19T17:55:00+08": ("2026-08-19T09:55:00", False),
    "2026-08-19 09:55:00": ("2026-08-19T09:55:00", True),
    "2026-08-19": ("2026-08-19T00:00:00", True),
    "2026-08": ("2026-08-01T00:00:00", True),
    "2026": ("2026-01-01T00:00:00", True),
    "2026-8-9": ("2026-08-09T00:00:00", True),
    "2026-08-19T09": ("2026-08-19T09:00:00", True),
    "20260819": ("2026-08-19T00:00:00", True),
    "20260819T095500": ("2026-08-19T09:55:00", True),
    "2026/08/19 09:55:00": ("2026-08-19T09:55:00", True),
    " 2026-08-19T09:55:00Z\t": ("2026-08-19T09:55:00", False),
    "1787133300": ("2026-08-19T09:55:00", False),
    "1787133300000": ("2026-08-19T09:55:00", False),
}
BAD = [
    None, "", "  ", "not-a-timestamp", "2026-08-18T25:99:99Z", "2026-08-18T24:00:00Z", "2026-08-19T09:55:60Z", "2026-08-19T09:55:00z",
    "10:00", "T10:00", "now", "today", "2026-08-19 17:55:00 Australia/Perth", "+002026-01-01", "2300-01-01", "1600-01-01", "9999999999999", "12345678901234567890123",
]


def test_event_times(spark):
    rows = [(k,) for k in [*GOOD, *BAD]]
    df = spark.createDataFrame(rows, "raw string").withColumn("t", c.event_time(F.col("raw")))
    found = {r["raw"]: (r["at"], r["assumed"]) for r in df.select("raw", F.date_format("t.at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.col("t.assumed_utc").alias("assumed")).collect()}
    assert {k: found[k] for k in GOOD} == GOOD
    assert {k: found[k] for k in BAD} == {k: (None, False) for k in BAD}


def test_fraction_is_cut_to_microseconds(spark):
    df = spark.createDataFrame([("2026-08-19T09:55:00.1234567Z",)], "raw string")
    assert df.select(F.unix_micros(c.event_time(F.col("raw"))["at"])).first()[0] % 1_000_000 == 123456


@pytest.mark.parametrize(
    "raw,canonical",
    [(" Excavator ", "excavator"), ("GENERATOR   ENGINE", "generator_engine"), ("bulldozers", "dozer"), ("genset", "generator_engine"), ("digger", "excavator"),
     ("excavator_loader", None), ("", None), (None, None), ("crane", None), ("Wheel-Loader", "loader"), ("mini excavator", "excavator")],
)
def test_equipment_types(spark, raw, canonical):
    assert spark.createDataFrame([(raw,)], "t string").select(c.equipment_type(F.col("t"))).first()[0] == canonical


def test_ranges(spark):
    rows = [(100.0,), (100.01,), (-0.0,), (float("nan"),), (None,), (float("inf"),)]
    value, flag = c.in_range("fuel_level_pct", F.col("x"))
    found = spark.createDataFrame(rows, "x double").coalesce(1).select(value, flag).collect()
    assert [tuple(r) for r in found] == [(100.0, False), (None, True), (0.0, False), (None, False), (None, False), (None, True)]


def test_flags_and_text(spark):
    df = spark.createDataFrame([(True, True, " \ta\u2003"), (False, False, " ")], "a boolean, g boolean, s string").coalesce(1)
    flags = c.joined_flags({"gps_null_island": F.col("g"), "assumed_utc": F.col("a")})
    assert [tuple(r) for r in df.select(flags, c.blank_to_null(F.col("s"))).collect()] == [("assumed_utc,gps_null_island", "a"), (None, None)]
    split = spark.createDataFrame([("a, b,,c",), (None,)], "s string").coalesce(1).select(c.split_flags(F.col("s"))).collect()
    assert [r[0] for r in split] == [["a", "b", "c"], []]


def test_json_safe(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), datetime(2026, 8, 19, 9, 55))], "a double, b double, t timestamp")
    row = c.json_safe(df).first()
    assert row["a"] is None and row["b"] is None and row["t"].endswith("Z")
