"""Telemetry-shaped frames over the test tables, so every operator runs on given data.

``events`` plays the readings: user is machine, error is fault.  The same text defines the
silver stand-in here and in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

SILVER_SQL = """
    SELECT 'M-' || lpad(CAST(user_id AS STRING), 6, '0') AS equipment_id,
           CASE user_id % 4 WHEN 0 THEN 'excavator' WHEN 1 THEN 'dozer' WHEN 2 THEN 'loader' ELSE 'generator_engine' END AS equipment_type,
           CAST(ts AS TIMESTAMP) AS event_time,
           CAST(ts AS DATE) AS event_date,
           CAST(event_id AS DOUBLE) * 0.01371 AS engine_hours,
           CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST((event_id * 37 + user_id * 11) % 101 AS DOUBLE) END AS fuel_level_pct,
           CASE WHEN event_id % 17 = 0 THEN NULL ELSE 80 + value / 4 END AS coolant_temp_c,
           CASE WHEN CAST(floor(event_id / 700) AS BIGINT) % 4 = 3 THEN CAST(0 AS DOUBLE) ELSE 15 + CAST(event_id % 50 AS DOUBLE) * 1.0137 END AS oil_pressure_psi,
           CASE WHEN event_id % 11 = 0 THEN NULL ELSE -20 - CAST(event_id % 100 AS DOUBLE) / 8 END AS gps_lat,
           CASE WHEN event_id % 7 = 0 THEN NULL ELSE 110 + CAST(event_id % 100 AS DOUBLE) / 8 END AS gps_lon,
           CASE WHEN event_type = 'error' THEN 'F' || CAST(event_id % 7 AS STRING) END AS fault_code,
           event_type = 'error' AS has_fault,
           CAST(floor(event_id / 700) AS BIGINT) % 4 <> 3 AS is_under_load,
           CASE WHEN event_id % 5 = 0 THEN 'assumed_utc,gps_null_island' WHEN event_id % 5 = 1 THEN 'assumed_utc' END AS quality_flags,
           event_id
    FROM events
"""


def view(spark: SparkSession, sf_dir: str, *names: str) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # the time functions expect it
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "events")
    return spark.sql(SILVER_SQL)


def bronze(spark: SparkSession, sf_dir: str, dated: bool = False) -> DataFrame:
    """Raw readings with every repairable and unrepairable kind of dirt, by event_id; ``event_id`` stays.

    ``dated`` adds the directory date ``dt``.

    Times come in four spellings or broken, types perturbed or unknown, sensors in range,
    out of range or missing; every tenth reading is sent twice in its batch, every
    fifteenth again in a later one.
    """
    view(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, at = F.col("event_id"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    spelled = (
        F.when(i % 50 == 49, "not-a-timestamp")
        .when(i % 4 == 0, F.concat(iso, F.lit("Z")))
        .when(i % 4 == 1, F.concat(F.date_format(at + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00")))
        .when(i % 4 == 2, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.unix_millis(at).cast("string"))
    )
    spelling = F.when(i % 40 == 39, "crane").when(i % 5 == 0, " Excavator ").when(i % 5 == 1, "bulldozers").when(i % 5 == 2, "wheel loader").when(i % 5 == 3, "GENSET").otherwise("generator-engine")
    first = e.select(
        F.when(i % 60 == 59, F.lit("  ")).otherwise(F.concat(F.lit(" M-"), F.lpad(F.col("user_id").cast("string"), 6, "0"))).alias("equipment_id"),
        spelling.alias("equipment_type"),
        spelled.alias("timestamp"),
        (i.cast("double") / 100).alias("engine_hours"),
        F.when(i % 9 == 0, F.lit(100.01)).when(i % 9 == 1, F.lit(float("nan"))).otherwise((i % 101).cast("double")).alias("fuel_level_pct"),
        (F.col("value") * 3).alias("coolant_temp_c"),
        F.when(i % 8 == 0, F.lit(5.0)).when(i % 8 == 1, F.lit(float("inf"))).otherwise((i % 50).cast("double")).alias("oil_pressure_psi"),
        F.when(i % 12 < 2, F.lit(0.0)).otherwise((i % 100 - 200).cast("double") / 2).alias("gps_lat"),
        F.when(i % 12 == 0, F.lit(0.0)).otherwise((i % 100 + 100).cast("double")).alias("gps_lon"),
        F.when(F.col("event_type") == "error", F.lit(" F1 ")).when(F.col("event_type") == "view", F.lit(" ")).alias("fault_code"),
        F.concat(F.lit("b"), (i % 6).cast("string")).alias("_ingest_batch_id"),
        F.timestamp_seconds(F.lit(1_800_000_000) + i % 6).alias("_ingested_at_utc"),
        "event_id",
        *([F.to_date("ts").alias("dt")] if dated else []),
    )
    later = first.where("event_id % 15 = 0").withColumns({"_ingest_batch_id": F.lit("late"), "_ingested_at_utc": F.timestamp_seconds(F.lit(1_800_009_999))})
    return first.unionByName(first.where("event_id % 10 = 0")).unionByName(later)


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, as sums of doubles depend on their order."""
    return df.select(*(F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


BRONZE_COLUMNS = tuple(f.name for f in schemas.BRONZE)
