"""Bronze to silver (incremental, idempotent) and silver to gold (full rebuild)."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from collections.abc import Iterable
from datetime import date, datetime, timedelta, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..config import get_settings
from ..operators import cleaning, gold
from ..session import get_session
from ..sources import lake as lakes
from ..sources import snapshots
from ..sources.lake import Lake
from ..sources.snapshots import Snapshot

MANIFEST_VERSION = 1
GOLD_TABLES = {"daily_equipment_summary": schemas.DAILY, "fleet_health_flags": schemas.FLAGS, "fleet_summary_by_type": schemas.FLEET}


def fingerprint(keys: Iterable[str]) -> str:
    """Of the set of files a partition was built from."""
    return hashlib.sha256("\n".join(sorted(keys)).encode()).hexdigest()


def manifest_key(version: str, day: date, silver: str = lakes.SILVER) -> str:
    """A manifest lies with the version it describes and never changes."""
    return f"{silver}/v={version}/dt={day}.json"


def is_current(lake: Lake, day: date, keys: list[str], snapshot: Snapshot | None = None) -> bool:
    """Whether readers see a silver built from exactly these files; an unreadable manifest means no."""
    entry = (snapshot or snapshots.latest(lake, lake.silver)).days.get(day)
    if entry is None or entry.get("fingerprint") != fingerprint(keys):
        return False
    try:
        found = json.loads(lake.read_bytes(manifest_key(entry["version"], day, lake.silver)))
        return found["version"] == MANIFEST_VERSION and found["bronze_fingerprint"] == entry["fingerprint"]
    except (ValueError, KeyError, TypeError, Py4JJavaError):
        return False


_EPOCH = date(1970, 1, 1)


def _observed(conformed: DataFrame, days: int) -> tuple[DataFrame, Observation]:
    """The frame, and what is counted while it is written.

    A histogram with a bin for every value it meets is exact: it counts rows by day.
    """
    seen = Observation()
    kept = F.col("_verdict") == "kept"
    nulls = [F.count_if(kept & F.col(f.name).isNull()).alias(f"null_{f.name}") for f in schemas.SILVER if not f.nullable]
    flags = [F.count_if(kept & F.col(f"_flag_{n}")).alias(f"flag_{n}") for n in schemas.FLAG_ORDER]
    reasons = [F.count_if(F.col("reject_reason") == r).alias(f"reject_{r}") for r in schemas.REJECT_REASONS]
    by_day = F.histogram_numeric(F.date_diff("dt", F.lit(_EPOCH)), F.lit(days + 1)).alias("rows_in")
    return conformed.observe(seen, by_day, *nulls, *flags, *reasons), seen


def _write_version(result: cleaning.CleaningResult, lake: Lake, version: str, days: int) -> dict:
    """Every conformed row in one pass over bronze, by layer and day; returns what was counted on the way.

    Kept and refused rows become their layers, resends leave a row each in layers that nobody
    reads: a day's counts are then those of its files, without reading one of their columns.
    """
    conformed, seen = _observed(result.conformed, days)
    refused = F.col("reject_reason").isNotNull()
    layer = F.when(refused, "quarantine").when(F.col("_verdict") == "kept", "silver").otherwise(F.col("_verdict"))
    fields = {f.name: f for f in (*schemas.SILVER, *schemas.QUARANTINE)}
    value = lambda f: F.when(refused, F.col("_raw_type")).otherwise(F.col(f.name)) if f.name == "equipment_type" else F.col(f.name)
    shown = F.col("layer").isin("silver", "quarantine")
    rows = conformed.withColumn("layer", layer).select(*(F.when(shown, value(f).cast(f.dataType)).alias(f.name) for f in fields.values()), "layer", "dt")
    dealt = lakes.dealt_for_writing(rows, "layer", "dt").sortWithinPartitions("layer", "dt", "event_time", "equipment_id")
    dealt.write.partitionBy("layer", "dt").option("compression", "zstd").parquet(lake.uri(f"{lake.silver}/v={version}"))
    return seen.get


LAYERS = {"rows_out": "silver", "rows_quarantined": "quarantine", "exact_resends": "exact_resend", "cross_batch_resends": "cross_batch_resend"}


def _written(lake: Lake, version: str) -> dict[date, dict]:
    """Rows of a version by day and layer: the files' own counts, no column is read."""
    shape = StructType().add("layer", "string").add("dt", "date")
    written = lake.spark.read.schema(shape).parquet(lake.uri(f"{lake.silver}/v={version}"))
    found: dict[date, dict] = {}
    for r in written.groupBy("dt", "layer").count().collect():  # at most four rows a day
        found.setdefault(r["dt"], {})[r["layer"]] = r["count"]
    return found


def _audited(lake: Lake, version: str, seen: dict, bronze: DataFrame) -> dict[date, dict]:
    """Counts by day of a written version, reconciled with the rows that came in."""
    refused = {n.removeprefix("null_"): v for n, v in seen.items() if n.startswith("null_") and v}
    if refused:
        raise ValueError(f"silver would hold nulls where none may be: {refused}")
    came = {_EPOCH + timedelta(days=round(b["x"])): round(b["y"]) for b in seen["rows_in"] or () if b["y"]}
    written = _written(lake, version)
    # a task that ran again after an executor was lost counts its rows again: then bronze is counted by itself
    if came != {d: sum(w.values()) for d, w in written.items()}:
        came = {r["dt"]: r["count"] for r in bronze.groupBy("dt").count().collect()}
    counts = {}
    for day, rows in came.items():
        c = {"rows_in": rows} | {name: written.get(day, {}).get(layer, 0) for name, layer in LAYERS.items()}
        counts[day] = c | {"duplicates_removed": c["exact_resends"] + c["cross_batch_resends"]}
        cleaning.reconcile(counts[day])
    return counts


def build_silver(spark: SparkSession, root: str | Lake, dates: Iterable[date] | None = None, full_refresh: bool = False, at: datetime | None = None) -> dict:
    """Rebuild the silver days whose bronze files changed, all in one pass; returns a summary.

    Readers see the days as they were until the new version is written, reconciled and
    committed, and then all of them new.  A stop at any step leaves the old snapshot.
    """
    lake, stamp = lakes.as_lake(spark, root), at or datetime.now(timezone.utc)
    found = lakes.bronze_partitions(lake)
    base = snapshots.latest(lake, lake.silver)
    wanted = {d: k for d, k in found.items() if dates is None or d in set(dates)}
    stale = {d: k for d, k in wanted.items() if full_refresh or not is_current(lake, d, k, base)}
    summary = {"partitions_found": len(wanted), "partitions_built": len(stale), "partitions_skipped": len(wanted) - len(stale), "partitions": {}}
    if not stale:
        return summary
    bronze = lake.with_source(lake.read_partitioned(lake.bronze, schemas.BRONZE)).where(F.col("dt").isin(sorted(stale)))
    version = snapshots.new_version(base)
    try:
        seen = _write_version(cleaning.clean(bronze, stamp), lake, version, len(stale))
        counts = _audited(lake, version, seen, bronze)
        changed = {}
        for day, keys in stale.items():
            c = counts.get(day, dict.fromkeys(("rows_in", *LAYERS, "duplicates_removed"), 0))  # files without rows
            manifest = {
                "version": MANIFEST_VERSION,
                "partition_date": str(day),
                "silver_key": snapshots.folder_of(lake.silver, {"version": version}, day),
                "quarantine_key": snapshots.folder_of(lake.silver, {"version": version}, day, "quarantine") if c["rows_quarantined"] else None,
                "rows_in": c["rows_in"],
                "rows_out": c["rows_out"],
                "rows_quarantined": c["rows_quarantined"],
                "duplicates_removed": c["duplicates_removed"],
                "bronze_file_count": len(keys),
                "bronze_fingerprint": fingerprint(keys),
                "bronze_keys": sorted(keys),
                "processed_at_utc": stamp.isoformat(),
            }
            lake.write_bytes(manifest_key(version, day, lake.silver), json.dumps(manifest, indent=2).encode())
            changed[day] = {"version": version, "fingerprint": manifest["bronze_fingerprint"], "rows": {layer: c[name] for name, layer in LAYERS.items()}}
            summary["partitions"][str(day)] = c
        snapshots.commit(lake, lake.silver, base, changed)
    except BaseException:
        lake.delete_prefix(f"{lake.silver}/v={version}")
        raise
    snapshots.vacuum(lake, lake.silver)
    for name in ("rows_in", "rows_out", "rows_quarantined", "duplicates_removed"):
        summary[name] = sum(c[name] for c in summary["partitions"].values())
    summary["flags"] = {n: seen[f"flag_{n}"] for n in schemas.FLAG_ORDER}
    summary["reject_reasons"] = {r: seen[f"reject_{r}"] for r in schemas.REJECT_REASONS}
    return summary


def read_silver(lake: Lake, layer: str = "silver") -> DataFrame:
    """Silver, or its quarantine, as the latest snapshot has it."""
    return snapshots.read(lake, lake.silver, schemas.QUARANTINE if layer == "quarantine" else schemas.SILVER, layer=layer)


def build_gold(spark: SparkSession, root: str | Lake, window_hours: int = schemas.DEFAULT_WINDOW_HOURS, lookback_days: int = schemas.DEFAULT_LOOKBACK_DAYS, at: datetime | None = None) -> dict:
    """Rebuild the three marts from the lookback of silver; each is swapped in whole."""
    lake, stamp = lakes.as_lake(spark, root), at or datetime.now(timezone.utc)
    base = snapshots.latest(lake, lake.silver)
    if not base.newest():
        raise FileNotFoundError(f"no silver under {lake.uri(lake.silver)}: build silver first")
    silver = snapshots.recent(lake, lake.silver, schemas.SILVER, lookback_days, base)
    # one narrow pass gives what flags and fleet need of days before the window; it stays beside the marts
    rows = {"machine_presence": mart(lake, "machine_presence").swap(gold.machine_presence(silver))}
    presence = mart(lake, "machine_presence").read()
    rows["daily_equipment_summary"] = mart(lake, "daily_equipment_summary").swap(gold.daily_equipment_summary(silver), ["day"], newest_day=F.max("day"))
    rows["fleet_health_flags"] = mart(lake, "fleet_health_flags").swap(gold.fleet_health_flags(silver, window_hours, stamp, presence))
    daily, flags = mart(lake, "daily_equipment_summary").read(), mart(lake, "fleet_health_flags").read()
    rows["fleet_summary_by_type"] = mart(lake, "fleet_summary_by_type").swap(gold.fleet_summary_by_type(silver, daily, flags, stamp, presence))
    reasons = flags.select(F.explode(F.split("flag_reasons", ",")).alias("reason")).groupBy("reason").count()
    read_days = base.newest(lookback_days)
    return {"silver_rows": sum(base.days[d]["rows"]["silver"] for d in read_days), "rows": rows, "reasons": {r["reason"]: r["count"] for r in reasons.orderBy("reason").collect()}, "generated_at_utc": stamp.isoformat()}


def mart(lake: Lake, name: str) -> lakes.Mart:
    """A gold table, or the presence table beside them; those by machine are sliced by it."""
    schema = (GOLD_TABLES | {"machine_presence": schemas.PRESENCE})[name]
    return lakes.Mart(lake, f"{lake.gold}/{name}", schema, "equipment_id" if "equipment_id" in schema.names else None)


def run_etl(spark: SparkSession, root: str | Lake, **options) -> dict:
    """Silver, then gold; an error in silver stops before gold."""
    silver_options = {k: options[k] for k in ("dates", "full_refresh", "at") if k in options}
    gold_options = {k: options[k] for k in ("window_hours", "lookback_days", "at") if k in options}
    return {"silver": build_silver(spark, root, **silver_options), "gold": build_gold(spark, root, **gold_options)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description="Build silver and gold of a telemetry lake")
    parser.add_argument("root", nargs="?", help="default: the lake that the environment names")
    parser.add_argument("--date", action="append", type=date.fromisoformat, dest="dates")
    parser.add_argument("--full-refresh", action="store_true")
    parser.add_argument("--window-hours", type=int, default=schemas.DEFAULT_WINDOW_HOURS)
    parser.add_argument("--lookback-days", type=int, default=schemas.DEFAULT_LOOKBACK_DAYS)
    args = vars(parser.parse_args(argv))
    spark = spark or get_session("seamline-etl")
    print(json.dumps(run_etl(spark, lakes.configured(spark, get_settings(), args.pop("root")), **args), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
