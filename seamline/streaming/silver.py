"""Streaming bronze to silver, beyond the batch contract.

Late resends within the watermark are dropped by key; resends that come later than that
survive here, which is why the batch build stays authoritative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions import conform as c
from ..operators.cleaning import apply_ranges, conform_rows


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """Files of a dt=-partitioned folder as they land."""
    return spark.readStream.schema(schemas.StructType([*schemas.BRONZE.fields]).add("dt", "date")).parquet(path)


def to_silver(bronze: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Conformed, valid, deduplicated readings of a stream."""
    df = apply_ranges(conform_rows(bronze)).where(F.col("reject_reason").isNull())
    df = df.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["equipment_id", "event_time"])
    flags = {n: F.col(f"_flag_{n}") for n in schemas.FLAG_ORDER}
    df = df.withColumns({"has_fault": F.col("fault_code").isNotNull(), "is_under_load": c.under_load(F.col("oil_pressure_psi")), "quality_flags": c.joined_flags(flags), "_silver_processed_at_utc": F.current_timestamp()})
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.SILVER))


def start(silver: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to a dt=-partitioned folder."""
    writer = silver.withColumn("dt", F.col("event_date")).writeStream.format("parquet").partitionBy("dt").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
