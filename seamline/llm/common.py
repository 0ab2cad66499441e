"""Plumbing shared by the corpus operators: shipping code, shared tables, batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_code

#: Rows of one Arrow batch that a Python stage holds at a time.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Make this package importable in Python workers and bound their Arrow batches."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a session of one machine gets a temporary folder; on a cluster, whose
    executors would not see that, it is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        else:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="seamline-shared-")
            sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders made within ``freed``, innermost last.
_MADE: list[list[str]] = []


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the tables that were materialised inside: for work whose result has been written elsewhere."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            files, target = _folder(spark, path)
            files.delete(target, True)


def materialise(df: DataFrame, tag: str, stays: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and return a scan of it.

    Cuts lineage: a lost executor rereads the table instead of redoing its inputs, and
    every later reader prunes columns.  The folder goes when the application ends, or with
    the enclosing ``freed`` unless it ``stays``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, target = _folder(spark, path)
    files.deleteOnExit(target)
    if _MADE and not stays:
        _MADE[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it unlike every column of ``df``."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found


def own_columns(df: DataFrame) -> list:
    """The columns of ``df`` by name, whatever characters the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def text_bytes(col: str = "text"):
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.encode(F.col(col).cast("string"), "UTF-8"), F.lit(b""))


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-made table as a local relation (no Python tasks to read it)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))
    columns = list(zip(*rows)) if rows else [()] * len(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.types)], schema=kind), schema)
