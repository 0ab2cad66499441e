"""Bronze to silver: conform, quarantine, validate, deduplicate, audit.

The order of the steps is part of the contract: text, times, types, quarantine, ranges,
dedup, derived columns, flags.  A bad field costs the field, not the row; no row is lost
silently: rows in = rows out + quarantined + duplicates.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions import conform as c


@dataclass
class CleaningResult:
    """Frames of one cleaning run, all derived from one conformed frame."""

    conformed: DataFrame  # every bronze row with reject_reason, flags and dedup verdict
    silver: DataFrame
    quarantine: DataFrame

    def audit(self) -> dict:
        """Counters of the run, from one aggregation over the conformed frame."""
        f = self.conformed
        kept = F.col("_verdict") == "kept"
        flags = [F.count_if(kept & F.col(f"_flag_{n}")).alias(f"flag_{n}") for n in schemas.FLAG_ORDER]
        reasons = [F.count_if(F.col("reject_reason") == r).alias(f"reject_{r}") for r in schemas.REJECT_REASONS]
        verdicts = [F.count_if(F.col("_verdict") == v).alias(v) for v in ("kept", "exact_resend", "cross_batch_resend")]
        row = f.agg(F.count("*").alias("rows_in"), F.count_if(F.col("reject_reason").isNotNull()).alias("quarantined"), *reasons, *verdicts, *flags).first().asDict()
        fired = {n: row[f"flag_{n}"] for n in schemas.FLAG_ORDER}
        nulled = {n: fired[f"{n}_out_of_range"] for n in schemas.VALID_RANGES}
        for axis in ("gps_lat", "gps_lon"):
            nulled[axis] += fired["gps_null_island"]
        return {
            "rows_in": row["rows_in"],
            "rows_out": row["kept"],
            "rows_quarantined": row["quarantined"],
            "reject_reasons": {r: row[f"reject_{r}"] for r in schemas.REJECT_REASONS},
            "exact_resends": row["exact_resend"],
            "cross_batch_resends": row["cross_batch_resend"],
            "duplicates_removed": row["exact_resend"] + row["cross_batch_resend"],
            "flags": fired,
            "values_nulled": nulled,
        }


def reconcile(audit: dict) -> None:
    """Raise unless every row is accounted for."""
    out = audit["rows_out"] + audit["rows_quarantined"] + audit["duplicates_removed"]
    if audit["rows_in"] != out:
        raise ValueError(f"row counts do not reconcile: {audit['rows_in']} in, {out} accounted for")


def conform_rows(bronze: DataFrame) -> DataFrame:
    """Text, times and types conformed; ``reject_reason`` names the first reason to refuse a row."""
    time = c.event_time(F.col("timestamp"))
    df = bronze.withColumns(
        {
            "_raw_type": F.col("equipment_type"),
            "equipment_id": c.strip(F.col("equipment_id")),
            "fault_code": c.blank_to_null(F.col("fault_code")),
            "_time": time,
            "equipment_type": c.equipment_type(F.col("equipment_type")),
        }
    )
    df = df.withColumns({"event_time": F.col("_time.at"), "_flag_assumed_utc": F.col("_time.assumed_utc")}).drop("_time")
    reason = (
        F.when(F.col("equipment_id").isNull() | (F.col("equipment_id") == ""), schemas.REJECT_REASONS[0])
        .when(F.col("event_time").isNull(), schemas.REJECT_REASONS[1])
        .when(F.col("equipment_type").isNull(), schemas.REJECT_REASONS[2])
    )
    return df.withColumns({"event_date": F.to_date("event_time"), "reject_reason": reason})


def apply_ranges(df: DataFrame) -> DataFrame:
    """Sensors out of range become null and flagged; then positions at null island."""
    checked = {n: c.in_range(n, F.col(n)) for n in schemas.VALID_RANGES}
    df = df.withColumns({n: v for n, (v, _) in checked.items()} | {f"_flag_{n}_out_of_range": f for n, (_, f) in checked.items()})
    df = df.withColumn("_flag_gps_null_island", c.null_island(F.col("gps_lat"), F.col("gps_lon")))
    return df.withColumns({n: F.when(~F.col("_flag_gps_null_island"), F.col(n)) for n in ("gps_lat", "gps_lon")})


def mark_duplicates(df: DataFrame, keys: list[str], accepted) -> DataFrame:
    """``_verdict``: kept, exact_resend or cross_batch_resend; null for rows not ``accepted``.

    The earliest ingested reading of a business key stays; ties go by batch, then by the
    file and place the row was read from, so reruns agree.
    """
    tie = [F.col(n).asc_nulls_last() for n in ("_source_file", "_source_row") if n in df.columns]
    # refused rows get keys of their own, so they do not meet in one window partition
    salt = F.when(~accepted, F.xxhash64("timestamp", "_ingest_batch_id", "equipment_id"))
    df = df.withColumn("_refused", salt)
    w = W.partitionBy(*keys, "_refused").orderBy(F.col("_ingested_at_utc").asc_nulls_last(), F.col("_ingest_batch_id").asc_nulls_last(), *tie)
    first = F.first("_ingest_batch_id").over(w)
    nth = F.row_number().over(w)
    df = df.withColumns({"_nth": nth, "_first_batch": first})
    resend = F.when(F.col("_ingest_batch_id").eqNullSafe(F.col("_first_batch")), "exact_resend").otherwise("cross_batch_resend")
    return df.withColumn("_verdict", F.when(accepted, F.when(F.col("_nth") == 1, "kept").otherwise(resend))).drop("_nth", "_first_batch", "_refused")


def clean(bronze: DataFrame, at: datetime | None = None) -> CleaningResult:
    """Clean bronze rows (with ``dt`` if partitioned: duplicates are looked for within it)."""
    stamp = F.lit(at or datetime.now(timezone.utc)).cast("timestamp")
    extra = ["dt"] if "dt" in bronze.columns else []
    df = apply_ranges(conform_rows(bronze))
    df = mark_duplicates(df, [*extra, "equipment_id", "event_time"], F.col("reject_reason").isNull())
    flags = {n: F.col(f"_flag_{n}") for n in schemas.FLAG_ORDER}
    df = df.withColumns(
        {
            "has_fault": F.col("fault_code").isNotNull(),
            "is_under_load": c.under_load(F.col("oil_pressure_psi")),
            "quality_flags": c.joined_flags(flags),
            "_silver_processed_at_utc": stamp,
            "_quarantined_at_utc": stamp,
        }
    )

    def shaped(frame: DataFrame, schema) -> DataFrame:
        return frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema), *extra)

    silver = shaped(df.where(F.col("_verdict") == "kept"), schemas.SILVER)
    refused = df.where(F.col("reject_reason").isNotNull()).withColumn("equipment_type", F.col("_raw_type"))
    return CleaningResult(df, silver, shaped(refused, schemas.QUARANTINE))
