"""Session factory: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def get_session(app: str = "seamline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the lakehouse relies on; ``conf`` uses "__" for dots.

    WAREHOUSE_MEMORY_LIMIT and WAREHOUSE_THREADS size a local session.
    """
    builder = SparkSession.builder.appName(app)
    threads = os.environ.get("WAREHOUSE_THREADS")
    if master or threads:
        builder = builder.master(master or f"local[{int(threads)}]")
    memory = os.environ.get("WAREHOUSE_MEMORY_LIMIT")
    if memory:
        builder = builder.config("spark.driver.memory", memory.replace("GB", "g").replace("MB", "m"))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers, whether or not it is on their path.

    It is added as a zip, once per application.
    """
    sc = spark.sparkContext
    if getattr(sc, "_seamline_shipped", None) != sc.applicationId:
        fd, name = tempfile.mkstemp(prefix="seamline-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(_PACKAGE.rglob("*.py")):
                z.write(p, Path(_PACKAGE.name) / p.relative_to(_PACKAGE))
        sc.addPyFile(name)
        sc._seamline_shipped = sc.applicationId
