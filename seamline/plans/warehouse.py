"""Views over the lake's layers, the SQL catalogue, and its command line."""

from __future__ import annotations

import argparse
import re
import sys
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import get_settings
from ..session import get_session
from ..sources import lake as lakes
from ..sources import snapshots
from ..sources.lake import Lake
from .etl import GOLD_TABLES, mart

CATALOGUE = Path(__file__).with_name("catalogue.sql")
LAYERS = ("bronze", "silver", "gold")
BUILD_COMMAND = {"bronze": "seamline.sources.lake.land", "silver": "python -m seamline.plans.etl ROOT", "gold": "python -m seamline.plans.etl ROOT"}
MAX_ROWS, MAX_CELL = 50, 44
#: Columns that a pivot may have.
MAX_TYPES = 1_000


class MissingLayerError(RuntimeError):
    """A layer has no data; the message names the command that builds it."""


@dataclass(frozen=True)
class Query:
    name: str
    layer: str
    question: str
    sql: str
    pivot: str | None = None


def load_queries(path: str | Path = CATALOGUE) -> dict[str, Query]:
    """Statements with ``-- name/layer/question`` headers, in file order."""
    found: dict[str, Query] = {}
    for part in re.split(r"(?m)^(?=-- name:)", Path(path).read_text()):
        head = dict(re.findall(r"(?m)^-- (name|layer|question|pivot):\s*(.+?)\s*$", part))
        if not head:
            continue
        sql = "\n".join(x for x in part.splitlines() if not re.match(r"-- (name|layer|question|pivot):", x)).strip().rstrip(";")
        missing = {"name", "layer", "question"} - head.keys()
        if missing or not sql or head["name"] in found:
            raise ValueError(f"bad catalogue entry {head.get('name')!r}: " + (f"no {', '.join(sorted(missing))}" if missing else "no SQL or a repeated name"))
        found[head["name"]] = Query(sql=sql, pivot=head.get("pivot"), **{k: head[k] for k in ("name", "layer", "question")})
    return found


def register_views(spark: SparkSession, root: str | Lake, layers=LAYERS) -> list[str]:
    """Temporary views of the chosen layers; raises MissingLayerError for one without files."""
    lake, made = lakes.as_lake(spark, root), []

    def need(layer: str, prefix: str, found) -> None:
        if not found:
            raise MissingLayerError(f"the {layer} layer has no data at {lake.uri(prefix)}; build it with: {BUILD_COMMAND[layer]}")

    def add(view: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(view)
        made.append(view)

    # beside each layer its days, from names alone: an anchored predicate opens no file to find its anchor
    if "bronze" in layers:
        days = list(lakes.bronze_partitions(lake))
        need("bronze", lake.bronze, days)
        add("bronze_telemetry", lake.read_partitioned(lake.bronze, schemas.BRONZE))
        add("bronze_days", _days(spark, days))
    if "silver" in layers:
        base = snapshots.latest(lake, lake.silver)
        need("silver", lake.silver, base.newest())
        add("silver_telemetry", snapshots.read(lake, lake.silver, schemas.SILVER, base))
        add("silver_days", _days(spark, base.newest()))
    if "gold" in layers:
        for name in GOLD_TABLES:
            table = mart(lake, name)
            need("gold", table.key, table.exists())
            add(name, table.read())
        # the newest day as the mart's pointer states it: a lookup of one machine opens no other's files to find it
        newest = mart(lake, "daily_equipment_summary").facts()["newest_day"]
        add("daily_newest", spark.createDataFrame([(newest,)], "day string").select(F.col("day").cast("date")))
        add("fleet_hours_by_type", fleet_hours_by_type(spark.table("daily_equipment_summary")))
    return made


def _days(spark: SparkSession, days: list) -> DataFrame:
    return spark.createDataFrame([(d,) for d in days], "dt date")


def fleet_hours_by_type(daily: DataFrame) -> DataFrame:
    """Operating hours by day, a column for each equipment type that the table holds."""
    known = daily.where(F.col("equipment_type").isNotNull()).select("equipment_type").distinct()
    types = sorted(r[0] for r in known.limit(MAX_TYPES + 1).collect())
    if len(types) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} equipment types: too many for columns")
    return daily.groupBy("day").pivot("equipment_type", types or list(schemas.EQUIPMENT_TYPES)).agg(F.round(F.sum("operating_hours"), 1))


def materialised_objects(spark: SparkSession) -> list[str]:
    """Views that are not temporary, or cached: a warehouse over files has none."""
    return [t.name for t in spark.catalog.listTables() if t.tableType != "TEMPORARY" or spark.catalog.isCached(t.name)]


def get_warehouse(root: str | Lake, layers=LAYERS, spark: SparkSession | None = None) -> SparkSession:
    spark = spark or get_session("seamline-warehouse")
    register_views(spark, root, layers)
    return spark


def statement(spark: SparkSession, query: Query, limit: int | None = None) -> DataFrame:
    """The query, capped as a subquery where a limit is asked for."""
    return spark.sql(f"SELECT * FROM ({query.sql}) LIMIT {int(limit)}" if limit else query.sql)


def explain(spark: SparkSession, query: Query) -> str:
    return "\n".join(r[0] for r in spark.sql(f"EXPLAIN FORMATTED {query.sql}").collect())


@dataclass(frozen=True)
class Scan:
    """What one scan of an executed plan opened: ``files`` of the ``known`` ones, and rows it gave."""

    role: str  # main, or subquery: an anchor or a list that another scan's predicate asks for
    files: int
    known: int
    rows: int
    folders: int  # that the files opened lie in: one a partition, however many files it takes; a table without partitions is one


def _items(found) -> list:
    return [found.apply(i) for i in range(found.size())]


def scans_read(df: DataFrame) -> tuple[list[Scan], int]:
    """Run a frame; what each of its scans opened, those of subqueries included, and how many rows it has.

    The plan is executed and its rows are counted where they are: no result comes to the
    driver.  A subquery or exchange that the plan uses twice runs, and counts, once.
    """
    execution, identity = df._jdf.queryExecution(), df.sparkSession.sparkContext._jvm.java.lang.System.identityHashCode
    rows, scans, seen = execution.toRdd().count(), [], set()
    stack = [(execution.executedPlan(), "main")]
    while stack:
        node, role = stack.pop()
        # by identity: the numbers of query stages repeat
        kind, this = node.getClass().getSimpleName(), identity(node)
        if kind.startswith("Reused") or this in seen:
            continue
        seen.add(this)
        stack += [(x, "subquery") for x in _items(node.subqueries())]
        if kind == "AdaptiveSparkPlanExec":
            stack.append((node.executedPlan(), role))
        elif kind.endswith("QueryStageExec"):
            stack.append((node.plan(), role))
        elif kind == "InMemoryTableScanExec":
            stack.append((node.relation().cachedPlan(), role))
        else:
            stack += [(x, role) for x in _items(node.children())]
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            known = len(node.relation().location().inputFiles()) if kind == "FileSourceScanExec" else 0
            files = metrics.apply("numFiles").value()
            folders = metrics.apply("numPartitions").value() if metrics.contains("numPartitions") else min(files, 1)
            scans.append(Scan(role, files, known, metrics.apply("numOutputRows").value(), folders))
    return scans, rows


def files_read(df: DataFrame) -> tuple[int, int]:
    """Files that a frame opens when it runs, in all its scans and subqueries, and its rows."""
    scans, rows = scans_read(df)
    return sum(x.files for x in scans), rows


def analyze(spark: SparkSession, query: Query) -> str:
    """The query's executed plan, and what running it read and returned: each scan by itself, then all."""
    df, began = statement(spark, query), time.perf_counter()
    scans, rows = scans_read(df)
    took = time.perf_counter() - began
    lines = [f"{x.role} scan: {x.files} of {x.known} files, {x.rows} rows" for x in scans]
    return "\n".join([df._jdf.queryExecution().executedPlan().toString(), *lines, f"files read: {sum(x.files for x in scans)}  rows: {rows}  seconds: {took:.3f}"])


def render_table(df: DataFrame) -> str:
    """Rows as text in columns: at most 50 rows, cells of at most 44 characters."""
    rows = df.limit(MAX_ROWS + 1).collect()
    text = [[("" if v is None else f"{v:g}" if isinstance(v, float) else str(v)) for v in r] for r in rows[:MAX_ROWS]]
    text = [[c if len(c) <= MAX_CELL else c[: MAX_CELL - 1] + "…" for c in r] for r in text]
    wide = [max([len(n), *(len(r[i]) for r in text)]) for i, n in enumerate(df.columns)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, wide)).rstrip()
    more = [f"... more than {MAX_ROWS} rows"] if len(rows) > MAX_ROWS else []
    return "\n".join([line(df.columns), line(["-" * w for w in wide]), *map(line, text), *more])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: all ran; 1: a missing layer, a failure, or an empty result with --require-rows; 2: unknown query."""
    parser = argparse.ArgumentParser(description="Run catalogue queries over a telemetry lake")
    parser.add_argument("root", nargs="?", help="default: the lake that the environment names")
    parser.add_argument("--query", action="append")
    parser.add_argument("--list", action="store_true")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--explain", action="store_true", help="the plan, without running the query")
    parser.add_argument("--analyze", action="store_true", help="the executed plan with the files and rows it read and returned")
    parser.add_argument("--require-rows", action="store_true")
    args = parser.parse_args(argv)
    queries = load_queries()
    if args.list:
        for q in queries.values():
            print(f"{q.name} [{q.layer}] {q.question}")
        return 0
    unknown = [n for n in args.query or [] if n not in queries]
    if unknown:
        print(f"unknown query: {', '.join(unknown)}; known: {', '.join(queries)}", file=sys.stderr)
        return 2
    spark = spark or get_session("seamline-warehouse")
    before = set(materialised_objects(spark))
    try:
        get_warehouse(lakes.configured(spark, get_settings(), args.root), spark=spark)
    except MissingLayerError as missing:
        print(missing, file=sys.stderr)
        return 1
    made = sorted(set(materialised_objects(spark)) - before)
    if made:
        print(f"the warehouse holds copies of data, not views of files: {', '.join(made)}", file=sys.stderr)
        return 1
    failed = False
    for name in args.query or queries:
        print(f"\n## {name}: {queries[name].question}")
        try:
            if args.explain:
                print(explain(spark, queries[name]))
                continue
            if args.analyze:
                print(analyze(spark, queries[name]))
                continue
            df = statement(spark, queries[name], args.limit)
            print(render_table(df))
            if args.require_rows and df.isEmpty():
                print(f"{name} has no rows", file=sys.stderr)
                failed = True
        except Exception as problem:  # one failing query doesn't stop the others
            print(f"{name} failed: {problem}", file=sys.stderr)
            failed = True
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
