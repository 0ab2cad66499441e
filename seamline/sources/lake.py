"""The lake: keys under a root URI, through Hadoop file systems (file:, hdfs:, abfss:, ...)."""

from __future__ import annotations

import json
import logging
import re
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import conform, null_violations

_LOG = logging.getLogger(__name__)
_PARTITION = re.compile(r"(?:^|/)dt=(\d{4}-\d{2}-\d{2})(?:/|$)")
BRONZE, SILVER, GOLD = "raw", "silver", "gold"


def partition_date(key: str) -> date | None:
    """The dt= date in a key, if it has a valid one."""
    found = _PARTITION.search(key)
    try:
        return date.fromisoformat(found[1]) if found else None
    except ValueError:
        return None


class Lake:
    """Objects by POSIX-like keys relative to a root, and where its layers are."""

    def __init__(self, spark: SparkSession, root: str, bronze: str = BRONZE, silver: str = SILVER, gold: str = GOLD):
        self.spark, self.root = spark, root.rstrip("/")
        self.bronze, self.silver, self.gold = bronze, silver, gold
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, key: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}".rstrip("/"))

    def uri(self, key: str) -> str:
        return f"{self.root}/{key}".rstrip("/")

    def list_keys(self, prefix: str = "", suffix: str = ".parquet") -> list[str]:
        """Sorted keys of the files below a folder; a missing folder has none."""
        top = self._path(prefix)
        if not self._fs.exists(top):
            return []
        base, found = self._fs.makeQualified(self._path("")).toUri().getPath().rstrip("/"), []
        files = self._fs.listFiles(top, True)
        while files.hasNext():
            key = files.next().getPath().toUri().getPath()[len(base) + 1 :]
            if key.endswith(suffix):
                found.append(key)
        return sorted(found)

    def list_names(self, prefix: str = "") -> list[str]:
        """Names of what a folder holds, folders included; a missing folder holds nothing."""
        top = self._path(prefix)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def create_once(self, key: str, data: bytes) -> bool:
        """Write an object that appears whole, unless its key is taken: then nothing changes and the result is false."""
        aside = f"_tmp/{uuid.uuid4().hex}"
        self.write_bytes(aside, data)
        self._fs.mkdirs(self._path(key).getParent())
        taken = self._jvm.org.apache.hadoop.fs.FileAlreadyExistsException
        try:
            self._renamed(aside, key)
            return True
        except Py4JJavaError as problem:
            if not self.spark.sparkContext._jvm.java.lang.Class.forName(taken._fqn).isInstance(problem.java_exception):
                raise
            return False
        finally:
            self._fs.delete(self._path(aside), False)

    def _renamed(self, source: str, key: str, overwrite: bool = False) -> None:
        """An atomic rename of a file."""
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE if overwrite else kinds.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(self._path(source)), self._fs.makeQualified(self._path(key)), how)

    def exists(self, key: str) -> bool:
        return bool(self._fs.exists(self._path(key)))

    def read_bytes(self, key: str) -> bytes:
        stream = self._fs.open(self._path(key))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write_bytes(self, key: str, data: bytes) -> None:
        stream = self._fs.create(self._path(key), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def delete_prefix(self, prefix: str) -> int:
        """Delete a folder; returns how many files it held."""
        count = len(self.list_keys(prefix, ""))
        self._fs.delete(self._path(prefix), True)
        return count

    def rename(self, prefix: str, target: str) -> None:
        """Move a folder; the target must not exist, its parents are made."""
        self._fs.mkdirs(self._path(target).getParent())
        if not self._fs.rename(self._path(prefix), self._path(target)):
            raise OSError(f"cannot move {self.uri(prefix)} to {self.uri(target)}")

    def read(self, keys: Iterable[str], schema: StructType) -> DataFrame:
        """Files by name of their columns; no keys give an empty frame."""
        paths = [self.uri(k) for k in keys]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read_partitioned(self, folder: str, schema: StructType) -> DataFrame:
        """A dt=-partitioned folder: its columns and ``dt``; predicates on dt prune directories."""
        return self.spark.read.schema(StructType([*schema.fields]).add("dt", "date")).option("basePath", self.uri(folder)).parquet(self.uri(folder))

    def with_source(self, df: DataFrame) -> DataFrame:
        """Add the file and row a bronze reading came from, as last ties of the dedup."""
        return df.select("*", F.col("_metadata.file_path").alias("_source_file"), F.col("_metadata.row_index").alias("_source_row"))

    def swap_single(self, df: DataFrame, key: str, schema: StructType) -> int:
        """Write one file aside and rename it over ``key``: readers see the old or the new one.

        Nulls in columns that the schema says are never null refuse the file; the old one stays.
        """
        aside = f"_tmp/{uuid.uuid4().hex}"
        conform(df, schema).coalesce(1).write.option("compression", "zstd").parquet(self.uri(aside))
        refused = null_violations(self.spark.read.parquet(self.uri(aside)), schema)
        if refused:
            self.delete_prefix(aside)
            raise ValueError(f"{key} would hold nulls where none may be: {refused}")
        part = next(k for k in self.list_keys(aside) if k.rsplit("/", 1)[1].startswith("part-"))
        self._fs.mkdirs(self._path(key).getParent())
        self._renamed(part, key, overwrite=True)
        self.delete_prefix(aside)
        return self.spark.read.schema(schema).parquet(self.uri(key)).count()


#: Slices of a mart by machine: a lookup of one machine opens the files of one.
SLICES = 64


def slice_of(machine) -> Column:
    """The slice of a machine's rows; of a literal, a literal that prunes folders."""
    return (F.crc32(machine.cast("binary")) % SLICES).cast("int")


@dataclass(frozen=True)
class Mart:
    """A table kept as a folder of versions, ``<key>/v=<id>``, and a pointer, ``<key>/_current.json``, that names one.

    A version is written whole by as many tasks as it asks for, checked, and becomes the
    table by the atomic rename of the pointer; the version before it stays for readers that
    have begun.  With ``sliced`` (a column) rows lie in ``slice=<n>`` folders by its hash and
    sorted by it, so a predicate on the slice opens only one folder's files.
    """

    lake: Lake
    key: str
    schema: StructType
    sliced: str | None = None

    def _pointer(self) -> dict | None:
        key = f"{self.key}/_current.json"
        return json.loads(self.lake.read_bytes(key)) if self.lake.exists(key) else None

    def exists(self) -> bool:
        return self._pointer() is not None

    def facts(self) -> dict:
        """What was stated of the current version when it was swapped in."""
        return self._pointer()["facts"]

    def read(self) -> DataFrame:
        """The current version; a sliced one has ``slice`` as its last column."""
        found = self._pointer()
        if found is None:
            return self.lake.spark.createDataFrame([], self.schema)
        schema = StructType([*self.schema.fields])
        if self.sliced:
            schema = schema.add("slice", "integer")
        folder = f"{self.key}/v={found['version']}"
        return self.lake.spark.read.schema(schema).option("basePath", self.lake.uri(folder)).parquet(self.lake.uri(folder))

    def swap(self, df: DataFrame, order: Iterable[str] = (), **facts: Column) -> int:
        """Write a version and make it the table; ``facts`` are aggregates over it.  Returns its rows.

        Nulls in columns that the schema says are never null refuse it; the old version stays.
        """
        before, version = self._pointer(), uuid.uuid4().hex
        folder = f"{self.key}/v={version}"
        rows = conform(df, self.schema)
        if self.sliced:
            rows = dealt_for_writing(rows.withColumn("slice", slice_of(F.col(self.sliced))), "slice")
            rows.sortWithinPartitions("slice", self.sliced, *order).write.partitionBy("slice").option("compression", "zstd").parquet(self.lake.uri(folder))
        else:
            dealt_for_writing(rows).sortWithinPartitions(*order or self.schema.names[:1]).write.option("compression", "zstd").parquet(self.lake.uri(folder))
        try:
            written = self.lake.spark.read.schema(self.schema).parquet(self.lake.uri(folder))
            needed = [f.name for f in self.schema if not f.nullable]
            row = written.agg(F.count("*").alias("rows"), *(F.count_if(F.col(n).isNull()).alias(f"null_{n}") for n in needed), *(c.cast("string").alias(f"fact_{n}") for n, c in facts.items())).first()
            refused = {n: row[f"null_{n}"] for n in needed if row[f"null_{n}"]}
            if refused:
                raise ValueError(f"{self.key} would hold nulls where none may be: {refused}")
            aside = f"_tmp/{uuid.uuid4().hex}"
            self.lake.write_bytes(aside, json.dumps({"version": version, "rows": row["rows"], "facts": {n: row[f"fact_{n}"] for n in facts}}).encode())
            self.lake._renamed(aside, f"{self.key}/_current.json", overwrite=True)
        except BaseException:
            self.lake.delete_prefix(folder)
            raise
        for name in self.lake.list_names(self.key):
            if name.startswith("v=") and name.removeprefix("v=") not in (version, (before or {}).get("version")):
                self.lake.delete_prefix(f"{self.key}/{name}")
        return row["rows"]


def as_lake(spark: SparkSession, place: str | Lake) -> Lake:
    """A lake, given as one or by its root."""
    return place if isinstance(place, Lake) else Lake(spark, place)


def configured(spark: SparkSession, settings, root: str | None = None) -> Lake:
    """The lake of the settings, or the one at ``root`` with their layer names."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name, value in settings.storage.items():
        hadoop.set(name.removeprefix("spark.hadoop."), value)
    return Lake(spark, root or settings.root, **settings.prefixes())


def scratch(spark: SparkSession, tag: str) -> str:
    """A folder of its own that all executors see, removed when the application ends."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="seamline-")
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def bronze_partitions(lake: Lake) -> dict[date, list[str]]:
    """Bronze files by the date of their directory; others are left out, with a warning."""
    found: dict[date, list[str]] = {}
    for key in lake.list_keys(lake.bronze):
        day = partition_date(key)
        if day is None:
            _LOG.warning("%s has no dt= date in its key and is left out", key)
        else:
            found.setdefault(day, []).append(key)
    return dict(sorted(found.items()))


def dealt_for_writing(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of one partition together, but for those of a large one: adaptive execution splits it by size.

    So a day takes as many tasks and files as its bytes ask for, and a small one a single file.
    """
    return df.hint("rebalance", *keys)


def land(df: DataFrame, lake: Lake, batch: str, time: str = "event_time") -> int:
    """Land a batch of bronze readings, each under the date of its own event; returns the number of days.

    The batch is written aside and each day's folder, ``dt=<day>/<batch>``, appears by one
    rename.  Landing a batch again replaces what it landed, days that it no longer has
    included, so a repeat after a stop at any step ends like a single landing.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    aside = f"_tmp/{uuid.uuid4().hex}"
    dated = df.withColumn("dt", F.to_date(time)).drop(time)
    dealt_for_writing(dated, "dt").write.partitionBy("dt").option("compression", "zstd").parquet(lake.uri(aside))
    try:
        landed = {n for n in lake.list_names(aside) if partition_date(n)}
        before = [n for n in lake.list_names(lake.bronze) if partition_date(n) and lake.exists(f"{lake.bronze}/{n}/{batch}")]
        for name in before:
            lake.delete_prefix(f"{lake.bronze}/{name}/{batch}")
        for name in sorted(landed):
            lake.rename(f"{aside}/{name}", f"{lake.bronze}/{name}/{batch}")
    finally:
        lake.delete_prefix(aside)
    return len(landed)
