"""Snapshots of a dt-partitioned layer: which version of each day readers see.

A build writes its days once, under a version of its own, ``v=<version>/layer=<layer>/dt=<day>``,
where nobody looks; then one small file, ``_snapshots/<number>.json``, names for every day
the version that holds it.  The file appears whole, by a rename that fails if its number is
taken, so readers see all days of a build or none, and of two builds at once the second
starts again from the first one's snapshot.  Readers take the highest number that can be
read and open the folders that it names; no day is missing at any time.  Versions that the
latest snapshots don't name are deleted after a commit, but for the newest ones, which
readers may still be in.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .lake import Lake

FORMAT = 1
#: Snapshots whose versions stay: the last one, and those that readers may have begun with.
KEPT = 3
_NUMBER = re.compile(r"(?:^|/)_snapshots/(\d{12})\.json$")


class ConflictError(RuntimeError):
    """Another build replaced a day of this one since this one began."""


@dataclass(frozen=True)
class Snapshot:
    """``days``: by date, at least ``version`` and ``fingerprint``, and the rows of each layer under ``rows``."""

    number: int = 0
    days: dict[date, dict] = field(default_factory=dict)

    def newest(self, count: int | None = None) -> list[date]:
        """Days that hold rows, in order; of the last ``count`` calendar days up to the newest."""
        held = sorted(d for d, entry in self.days.items() if entry["rows"].get("silver"))
        return [d for d in held if count is None or d > held[-1] - timedelta(days=count)]


def _numbers(lake: Lake, folder: str) -> list[int]:
    return sorted(int(m[1]) for k in lake.list_names(f"{folder}/_snapshots") if (m := _NUMBER.search(f"_snapshots/{k}")))


def _key(folder: str, number: int) -> str:
    return f"{folder}/_snapshots/{number:012d}.json"


def _parse(data: bytes, number: int) -> Snapshot:
    found = json.loads(data)
    if found["format"] != FORMAT:
        raise ValueError(f"snapshot format {found['format']}")
    return Snapshot(number, {date.fromisoformat(d): dict(e, rows=dict(e["rows"]), version=str(e["version"])) for d, e in found["days"].items()})


def latest(lake: Lake, folder: str) -> Snapshot:
    """The snapshot readers see; an unreadable one is passed over, and none at all has no days."""
    numbers = _numbers(lake, folder)
    for number in reversed(numbers):
        try:
            return _parse(lake.read_bytes(_key(folder, number)), number)
        except (ValueError, KeyError, TypeError, AttributeError):
            continue
    return Snapshot()


def new_version(base: Snapshot) -> str:
    """A name for a build's folder: the number it would commit, which tells its age, and chance."""
    return f"{base.number + 1:012d}-{uuid.uuid4().hex[:12]}"


def commit(lake: Lake, folder: str, base: Snapshot, changed: dict[date, dict]) -> Snapshot:
    """Make ``changed`` days part of the layer; ``base`` is the snapshot the build began with."""
    gone = sorted({e["version"] for e in changed.values() if not lake.exists(f"{folder}/v={e['version']}")})
    if gone:
        raise ConflictError(f"versions that were deleted as too old: {', '.join(gone)}")
    while True:
        now = latest(lake, folder)
        lost = [d for d in changed if now.days.get(d, {}).get("version") != base.days.get(d, {}).get("version")]
        if lost:
            raise ConflictError(f"replaced by another build: {', '.join(map(str, sorted(lost)))}")
        number = max([now.number, *_numbers(lake, folder)]) + 1
        days = now.days | changed
        body = {"format": FORMAT, "days": {str(d): days[d] for d in sorted(days)}}
        if lake.create_once(_key(folder, number), json.dumps(body, indent=1).encode()):
            return Snapshot(number, days)


def vacuum(lake: Lake, folder: str, kept: int = KEPT) -> int:
    """Delete versions and snapshots that no kept snapshot names; returns how many versions went."""
    numbers = _numbers(lake, folder)
    named: set[str] = set()
    for number in numbers[-kept:]:
        try:
            named |= {e["version"] for e in _parse(lake.read_bytes(_key(folder, number)), number).days.values()}
        except (ValueError, KeyError, TypeError, AttributeError):
            return 0  # what it names is not known
    held = [n.removeprefix("v=") for n in lake.list_names(folder) if n.startswith("v=")]
    # a version of about the last snapshot's age may belong to a build that has not committed yet
    gone = [v for v in held if v not in named and int(v.split("-")[0]) <= numbers[-1] - kept]
    for version in gone:
        lake.delete_prefix(f"{folder}/v={version}")
    for number in numbers[:-kept]:
        lake.delete_prefix(_key(folder, number))
    return len(gone)


def folder_of(folder: str, entry: dict, day: date, layer: str = "silver") -> str:
    return f"{folder}/v={entry['version']}/layer={layer}/dt={day}"


def read(lake: Lake, folder: str, schema: StructType, snapshot: Snapshot | None = None, layer: str = "silver", days: Iterable[date] | None = None) -> DataFrame:
    """The layer's columns and ``dt``: the days' folders that the snapshot names, and only these are listed."""
    snapshot = snapshot or latest(lake, folder)
    wanted = snapshot.days if days is None else {d: snapshot.days[d] for d in days}
    paths = [lake.uri(folder_of(folder, e, d, layer)) for d, e in sorted(wanted.items()) if e["rows"].get(layer)]
    if not paths:
        return lake.spark.createDataFrame([], schema).withColumn("dt", F.lit(None).cast("date"))
    dated = StructType([*schema.fields]).add("v", "string").add("layer", "string").add("dt", "date")
    return lake.spark.read.schema(dated).option("basePath", lake.uri(folder)).parquet(*paths).drop("v", "layer")


def recent(lake: Lake, folder: str, schema: StructType, days: int, snapshot: Snapshot | None = None) -> DataFrame:
    """The last ``days`` days up to the newest that holds rows; that day comes from the snapshot, not from the files."""
    snapshot = snapshot or latest(lake, folder)
    return read(lake, folder, schema, snapshot, days=snapshot.newest(days))
