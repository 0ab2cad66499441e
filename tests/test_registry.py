"""Registered queries against DuckDB on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from seamline.plans import registry
from seamline.sources import lake as lakes
from seamline.sources.lake import Lake


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_matches_sql(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    con = duckdb.connect()
    for p in Path(small).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(want.fetchall(), want.columns)


def test_lake_facts_hold_for_days_of_several_files(spark, small, tmp_path, monkeypatch):
    lake = Lake(spark, f"file://{tmp_path}/facts")
    monkeypatch.setattr(lakes, "scratch", lambda spark, tag: lake.root)
    parts = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in parts}
    for k, v in parts.items():
        spark.conf.set(k, v)
    try:
        got = dict(registry.w_lake_facts(spark, small).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{small}/events.parquet'")
    assert got == dict(con.sql(registry.ORACLE_SQL["w_lake_facts"]).fetchall())
    silver = [k for k in lake.list_keys("silver") if "/layer=silver/" in k]
    assert len(silver) > 2 * got["days in silver"] and len(lake.list_keys("raw")) > 1 + got["days in bronze"]


def test_entry_without_corpus_operators():
    """In a process where the folder and the pipeline cannot be imported: all other queries are there, and other failures are errors."""
    code = """
import importlib.abc, sys, warnings
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('seamline.llm'):
            raise ModuleNotFoundError(f'No module named {name!r}', name=sys.argv[1] or name)
sys.meta_path.insert(0, Gone())
warnings.simplefilter('ignore')
import __spark_entry__ as entry
from seamline.plans import registry
assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLE_SQL)
"""
    run = lambda missing: subprocess.run([sys.executable, "-c", code, missing], cwd=Path(__file__).parents[1], capture_output=True)
    found = run("")
    assert found.returncode == 0, found.stderr
    assert b"ModuleNotFoundError" in run("pyarrow").stderr


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
