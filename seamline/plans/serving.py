"""Serving queries over the gold views: bound statements of ``serving.sql``, and JSON-safe rows."""

from __future__ import annotations

import json
import zlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conform import json_safe, split_flags
from ..sources.lake import SLICES
from .warehouse import load_queries

SEVERITIES = ("warning", "critical")
_STATEMENTS = load_queries(Path(__file__).with_name("serving.sql"))


def canonical_filter(equipment_type: str | None) -> str | None:
    """Trimmed lower case; blank means no filter."""
    return (equipment_type or "").strip().lower() or None


def _bounded(name: str, value: int, most: int) -> int:
    if not 1 <= value <= most:
        raise ValueError(f"{name} must be between 1 and {most}")
    return int(value)


def statement(spark: SparkSession, name: str, **values) -> DataFrame:
    """A statement of ``serving.sql`` with its parameters bound."""
    return spark.sql(_STATEMENTS[name].sql, args=values)


def fleet_totals(spark: SparkSession) -> DataFrame:
    """One row: the fleet's size and flagged machines, zeros without any type."""
    return statement(spark, "fleet_totals")


def fleet_by_type(spark: SparkSession) -> DataFrame:
    """The largest type first."""
    return statement(spark, "fleet_by_type")


def health_flags(spark: SparkSession, equipment_type: str | None = None, severity: str | None = None, limit: int = 200) -> DataFrame:
    """Flagged machines, the most urgent first."""
    if severity is not None and severity not in SEVERITIES:
        raise ValueError(f"severity is one of {', '.join(SEVERITIES)}")
    return statement(spark, "health_flags", equipment_type=canonical_filter(equipment_type), severity=severity, limit=_bounded("limit", limit, 5000))


def equipment(spark: SparkSession, equipment_type: str | None = None, flagged_only: bool = False, limit: int = 500) -> DataFrame:
    """Known machines with their flag if they have one, the lowest score first."""
    return statement(spark, "equipment", equipment_type=canonical_filter(equipment_type), flagged_only=bool(flagged_only), limit=_bounded("limit", limit, 5000))


def _machine(equipment_id: str) -> dict:
    return {"equipment_id": equipment_id, "slice": zlib.crc32(equipment_id.encode()) % SLICES}


def equipment_identity(spark: SparkSession, equipment_id: str) -> DataFrame:
    """Exactly one row; nulls for a machine that gold doesn't know."""
    return statement(spark, "equipment_identity", **_machine(equipment_id))


def equipment_days(spark: SparkSession, equipment_id: str, days: int = 30) -> DataFrame:
    """The newest ``days`` days of the table, for one machine."""
    return statement(spark, "equipment_days", **_machine(equipment_id), days=_bounded("days", days, 3650))


def equipment_flag(spark: SparkSession, equipment_id: str) -> DataFrame:
    return statement(spark, "equipment_flag", **_machine(equipment_id))


def rows(df: DataFrame) -> list[dict]:
    """JSON-safe rows of a small result."""
    names = df.columns
    return [json.loads(r[0]) for r in json_safe(df).select(F.to_json(F.struct(*(F.col(f"`{n}`") for n in names)), {"ignoreNullFields": "false"})).collect()]


def health(spark: SparkSession) -> dict:
    """Degraded rather than failing when a view is missing."""
    needed = ("daily_equipment_summary", "fleet_health_flags", "fleet_summary_by_type")
    missing = [n for n in needed if not spark.catalog.tableExists(n)]
    return {"status": "degraded" if missing else "ok", "missing": missing}


def fleet_summary(spark: SparkSession) -> dict:
    return rows(fleet_totals(spark))[0] | {"by_type": rows(fleet_by_type(spark))}


def equipment_history(spark: SparkSession, equipment_id: str, days: int = 30) -> dict:
    """Identity, days and current flag of a machine; LookupError for an unknown one."""
    who = rows(equipment_identity(spark, equipment_id))[0]
    if who["last_day"] is None:
        raise LookupError(f"unknown equipment: {equipment_id}")
    flags = rows(equipment_flag(spark, equipment_id))
    return {"equipment_id": equipment_id, **who, "history": rows(equipment_days(spark, equipment_id, days)), "flag": flags[0] if flags else None}


# Derivations of the dashboard, as functions over the by-type summary and the flags.


def _of_type(df: DataFrame, equipment_type: str | None) -> DataFrame:
    wanted = canonical_filter(equipment_type)
    return df if wanted is None else df.where(F.col("equipment_type") == wanted)


def scoped(by_type: DataFrame, equipment_type: str | None = None) -> DataFrame:
    """One row of cards: sums, machine-weighted temperature and the flagged share, for all types or one."""
    df = _of_type(by_type, equipment_type)
    known = F.when(F.col("avg_coolant_temp_c").isNotNull(), F.col("machine_count"))
    return df.agg(
        F.coalesce(F.sum("machine_count"), F.lit(0)).alias("machines"),
        F.coalesce(F.sum("machines_flagged"), F.lit(0)).alias("machines_flagged"),
        (F.sum(F.col("avg_coolant_temp_c") * known) / F.nullif(F.sum(known), F.lit(0))).alias("avg_coolant_temp_c"),
        F.max("max_coolant_temp_c").alias("max_coolant_temp_c"),
        (F.lit(100.0) * F.sum("machines_flagged") / F.nullif(F.sum("machine_count"), F.lit(0))).alias("pct_flagged"),
    )


def by_urgency(flags: DataFrame) -> DataFrame:
    """Critical, then warning, then unknown severities; lowest score first."""
    order: Column = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return flags.orderBy(order, F.col("health_score").asc_nulls_last(), "equipment_id")


def reasons(flags: DataFrame) -> DataFrame:
    """One row per machine and reason."""
    return flags.select("equipment_id", F.explode(split_flags(F.col("flag_reasons"))).alias("reason"))
