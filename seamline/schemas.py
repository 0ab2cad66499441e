"""Layer schemas and the constants of the telemetry contract (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"STRING": StringType(), "DOUBLE": DoubleType(), "BIGINT": LongType(), "BOOLEAN": BooleanType(), "TIMESTAMP": TimestampType(), "DATE": DateType()}


def _schema(ddl: str) -> StructType:
    """A schema from column definitions in SQL, a line each."""
    fields = []
    for line in filter(None, (x.strip().rstrip(",") for x in ddl.splitlines())):
        name, kind, *rest = line.split()
        fields.append(StructField(name, _TYPES[kind], rest != ["NOT", "NULL"]))
    return StructType(fields)


SENSORS = ("engine_hours", "fuel_level_pct", "coolant_temp_c", "oil_pressure_psi", "gps_lat", "gps_lon")

BRONZE = _schema("""
    equipment_id STRING,
    equipment_type STRING,
    timestamp STRING,
    engine_hours DOUBLE,
    fuel_level_pct DOUBLE,
    coolant_temp_c DOUBLE,
    oil_pressure_psi DOUBLE,
    gps_lat DOUBLE,
    gps_lon DOUBLE,
    fault_code STRING,
    _ingest_batch_id STRING NOT NULL,
    _ingested_at_utc TIMESTAMP NOT NULL
""")
SILVER = _schema("""
    equipment_id STRING NOT NULL,
    equipment_type STRING NOT NULL,
    event_time TIMESTAMP NOT NULL,
    event_date DATE NOT NULL,
    engine_hours DOUBLE,
    fuel_level_pct DOUBLE,
    coolant_temp_c DOUBLE,
    oil_pressure_psi DOUBLE,
    gps_lat DOUBLE,
    gps_lon DOUBLE,
    fault_code STRING,
    has_fault BOOLEAN NOT NULL,
    is_under_load BOOLEAN NOT NULL,
    quality_flags STRING,
    _ingest_batch_id STRING,
    _ingested_at_utc TIMESTAMP,
    _silver_processed_at_utc TIMESTAMP NOT NULL
""")
QUARANTINE = _schema("""
    equipment_id STRING,
    equipment_type STRING,
    timestamp STRING,
    reject_reason STRING NOT NULL,
    _ingest_batch_id STRING,
    _quarantined_at_utc TIMESTAMP NOT NULL
""")
DAILY = _schema("""
    equipment_id STRING NOT NULL,
    equipment_type STRING NOT NULL,
    day DATE NOT NULL,
    readings_count BIGINT NOT NULL,
    under_load_readings BIGINT NOT NULL,
    avg_coolant_temp_c DOUBLE,
    max_coolant_temp_c DOUBLE,
    p95_coolant_temp_c DOUBLE,
    avg_oil_pressure_psi DOUBLE,
    min_oil_pressure_psi DOUBLE,
    engine_hours_start DOUBLE,
    engine_hours_end DOUBLE,
    operating_hours DOUBLE,
    fuel_consumed_pct DOUBLE,
    fuel_burn_pct_per_hour DOUBLE,
    refuel_events BIGINT NOT NULL,
    fault_code_count BIGINT NOT NULL,
    distinct_fault_codes BIGINT NOT NULL,
    last_gps_lat DOUBLE,
    last_gps_lon DOUBLE
""")
FLAGS = _schema("""
    equipment_id STRING NOT NULL,
    equipment_type STRING NOT NULL,
    severity STRING NOT NULL,
    health_score DOUBLE NOT NULL,
    flag_reasons STRING NOT NULL,
    temp_trend_c_per_hour DOUBLE,
    recent_avg_temp_c DOUBLE,
    recent_max_temp_c DOUBLE,
    recent_min_oil_psi DOUBLE,
    recent_fault_count BIGINT NOT NULL,
    distinct_fault_codes BIGINT NOT NULL,
    top_fault_code STRING,
    readings_in_window BIGINT NOT NULL,
    hours_since_last_reading DOUBLE,
    last_seen_utc TIMESTAMP,
    last_gps_lat DOUBLE,
    last_gps_lon DOUBLE,
    window_hours BIGINT NOT NULL,
    generated_at_utc TIMESTAMP NOT NULL
""")
FLEET = _schema("""
    equipment_type STRING NOT NULL,
    machine_count BIGINT NOT NULL,
    active_machines_24h BIGINT NOT NULL,
    avg_coolant_temp_c DOUBLE,
    max_coolant_temp_c DOUBLE,
    avg_oil_pressure_psi DOUBLE,
    total_operating_hours DOUBLE,
    avg_fuel_burn_pct_per_hour DOUBLE,
    total_fault_codes BIGINT NOT NULL,
    machines_flagged BIGINT NOT NULL,
    pct_flagged DOUBLE NOT NULL,
    critical_count BIGINT NOT NULL,
    warning_count BIGINT NOT NULL,
    days_covered BIGINT NOT NULL,
    generated_at_utc TIMESTAMP NOT NULL
""")

#: Beside the marts: when machines were last read, by the types they were read as.
PRESENCE = _schema("""
    equipment_id STRING NOT NULL,
    equipment_type STRING,
    last_seen_utc TIMESTAMP NOT NULL,
    last_loaded_utc TIMESTAMP
""")

EQUIPMENT_TYPES = ("excavator", "dozer", "loader", "generator_engine")
#: Slugs of other spellings and the type they mean.
TYPE_SYNONYMS = {
    "bulldozer": "dozer",
    "bull_dozer": "dozer",
    "crawler_dozer": "dozer",
    "track_dozer": "dozer",
    "wheel_loader": "loader",
    "wheeled_loader": "loader",
    "front_end_loader": "loader",
    "digger": "excavator",
    "genset": "generator_engine",
    "gen_set": "generator_engine",
    "generator_set": "generator_engine",
    "generator": "generator_engine",
}
UNDER_LOAD_OIL_PSI = 5.0
#: Inclusive bounds.
VALID_RANGES = {
    "engine_hours": (0.0, 200_000.0),
    "fuel_level_pct": (0.0, 100.0),
    "coolant_temp_c": (-50.0, 200.0),
    "oil_pressure_psi": (0.0, 200.0),
    "gps_lat": (-90.0, 90.0),
    "gps_lon": (-180.0, 180.0),
}
FLAG_ORDER = ("assumed_utc", *(f"{c}_out_of_range" for c in VALID_RANGES), "gps_null_island")
REJECT_REASONS = ("missing_equipment_id", "unparseable_timestamp", "unknown_equipment_type")

TEMP_PERCENTILE, OIL_PRESSURE_PERCENTILE = 0.95, 0.05
REFUEL_DELTA_PCT = 20.0
MIN_OPERATING_HOURS_FOR_RATE = 0.05
TEMP_TREND_C_PER_HOUR, TEMP_HIGH_C, TEMP_CRITICAL_C = 0.35, 105.0, 115.0
OIL_PRESSURE_LOW_PSI, OIL_PRESSURE_CRITICAL_PSI = 30.0, 20.0
FAULT_REPEAT_COUNT, FAULT_STORM_COUNT, RECURRING_FAULT_CODE_COUNT = 3, 25, 3
STALE_TELEMETRY_HOURS = 3.0
MIN_UNDER_LOAD_READINGS, WARMUP_READINGS = 12, 9
#: Rules in order, with what each takes off a health score of 100.
HEALTH_PENALTIES = {
    "temp_trending_up": 15.0,
    "temp_high": 20.0,
    "temp_critical": 40.0,
    "oil_pressure_low": 20.0,
    "oil_pressure_critical": 40.0,
    "repeated_faults": 10.0,
    "fault_storm": 30.0,
    "recurring_fault_code": 15.0,
    "stale_telemetry": 10.0,
}
RULE_ORDER = tuple(HEALTH_PENALTIES)
CRITICAL_RULES = ("temp_critical", "oil_pressure_critical", "fault_storm")
DEFAULT_WINDOW_HOURS, ACTIVE_WINDOW_HOURS, DEFAULT_LOOKBACK_DAYS = 24, 24, 30


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the schema's columns, in its order and types; a missing one raises KeyError."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema))


def null_violations(df: DataFrame, schema: StructType) -> dict[str, int]:
    """Nulls in columns that the schema says are never null, by column (empty: none)."""
    needed = [f.name for f in schema if not f.nullable]
    row = df.agg(*(F.count_if(F.col(n).isNull()).alias(n) for n in needed)).first() if needed else None
    return {n: row[n] for n in needed if row[n]} if row else {}
