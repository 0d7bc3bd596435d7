"""Commands beside the loads of :mod:`strata.__main__`: what is there, workbooks, training and inference.

Each takes the parsed arguments and returns the exit status: 0 done, 1 nothing to work on or not promoted.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import column_name, with_plain_names
from strata.ml import boosting, jobs, models
from strata.operators import monitor
from strata.session import Settings
from strata.sources import catalog, manifest, workbook
from strata.sources.scratch import stored
from strata.sources.sinks import Tables
from strata.streaming import telemetry
from strata.streaming.replay import late_plan, with_offset, write_batches

RUNS, REJECTS = "dq_runs", "_rejects"


def resources(args: argparse.Namespace, settings: Settings, tables: Tables) -> int:
    """The resources of the packages that would be landed."""
    found = catalog.selected(catalog.package_resources(tables.spark, args.catalog), args.include, args.exclude, args.format)
    found.select("resource_id", "name", "format", "size", "last_modified").orderBy("name").show(args.n, truncate=False)
    return 0


def attempts(args: argparse.Namespace, settings: Settings, tables: Tables) -> int:
    """The newest attempts in the manifest."""
    log = tables.read("ops_manifest")
    if log is None:
        return 1
    manifest.newest(log, args.n).select("id", "resource_name", "status", "bytes", "finished_at", "error").show(args.n, truncate=60)
    return 0


def inspect(args: argparse.Namespace, settings: Settings, tables: Tables) -> int:
    """The tables of a database: runs of contracts, rejects by reason, or rows and files by partition and the last write."""
    found = [t for t in tables.spark.catalog.listTables(args.namespace) if not t.isTemporary and args.table in (None, t.name)]
    for t in sorted(found, key=lambda t: t.name):
        name = f"{args.namespace}.{t.name}"
        df = tables.spark.table(name)
        print(name)
        if t.name == RUNS:
            monitor.newest_runs(df, 10).show(truncate=False)
        elif t.name.endswith(REJECTS):
            monitor.rejects_by_reason(df).show(truncate=False)
        else:
            by = [c.name for c in tables.spark.catalog.listColumns(name) if c.isPartition]
            monitor.partition_counts(df, *by).orderBy(*by).show(1000, truncate=False)
            monitor.last_written(df).show(truncate=False)
    return 0 if found else 1


def workbooks(args: argparse.Namespace, settings: Settings, tables: Tables) -> int:
    """Loads landed workbooks that are new or changed; each replaces its resource's partition."""
    log, table = tables.read("ops_manifest"), settings.table(args.table)
    if log is None:
        return 1
    layout = workbook.Layout(**json.loads(Path(args.layout).read_text()))
    # stored, as the table that it is told from is replaced
    pending = stored(workbook.pending_workbooks(log, tables.read(table), args.dataset), "pending")
    if args.dry_run:
        pending.select("resource_id", "resource_name", "landing_key").show(truncate=False)
        return 0
    rows = workbook.load_workbooks(tables.spark, pending, args.root, layout, F.current_timestamp())
    if rows is not None:
        tables.replace(table, rows, ("_resource_id",))
    return 0


def _windows(args: argparse.Namespace) -> jobs.Windows:
    return jobs.Windows(args.series, args.ts, tuple(args.sensor), args.width, args.step, args.most)


def _report(done: jobs.Trained) -> int:
    for name, score in done.scores.items():
        print(f"{name}: {score:.4f}")
    print(f"version {done.version}, {'promoted' if done.promoted else 'not promoted'}")
    return 0 if done.promoted else 1


def train_windows(args: argparse.Namespace, settings: Settings, tables: Tables) -> int:
    """Trains the classifier of windows; the first group decides."""
    readings, windows = tables.read(args.readings), _windows(args)
    if readings is None:
        return 1
    groups = [args.series, *args.group]
    cut = windows.cut(readings, F.col(args.code))
    if args.group:
        cut = cut.join(readings.groupBy(args.series).agg(*[F.min(g).alias(g) for g in args.group]), args.series)
    splits = [jobs.Split(g, g, args.folds) for g in groups]
    single = f"{args.sensor[0]}_std"
    return _report(jobs.train_classifier(stored(cut, "windows"), windows.features, splits, single, models.Models(tables.spark, args.models), args.name, _boosting(args)))


def _boosting(args: argparse.Namespace) -> boosting.Boosting | None:
    """Trees that stop early, if asked for."""
    return boosting.Boosting(rounds=args.boosted, patience=20, least_rows=50) if args.boosted else None


def detect(args: argparse.Namespace, settings: Settings, tables: Tables) -> int:
    """Writes the alerts of the last hours, in the place of those before."""
    readings = tables.read(args.readings)
    store = models.Models(tables.spark, args.models)
    found = readings if readings is None else jobs.detect(readings, _windows(args), args.hours, store, args.name, F.current_timestamp())
    return _publish(found, args, settings, tables)


def train_rows(args: argparse.Namespace, settings: Settings, tables: Tables) -> int:
    """Trains the regressor of a table's rows."""
    rows = tables.read(args.rows)
    if rows is None:
        return 1
    features = models.Features(tuple(args.number), tuple(args.category))
    split = jobs.Split(args.group, args.group, args.folds)
    how = _boosting(args)
    return _report(jobs.train_regressor(rows, features, args.target, split, models.Models(tables.spark, args.models), args.name, {"boosted": how} if how else None))


def predict(args: argparse.Namespace, settings: Settings, tables: Tables) -> int:
    """Writes the predictions for the rows of a population, in the place of those before."""
    rows = tables.read(args.rows)
    if rows is not None:
        store, complete = models.Models(tables.spark, args.models), F.expr(args.complete)
        rows = jobs.predict(rows.where(args.where), args.key, args.target, complete, store, args.name, F.current_timestamp())
    return _publish(rows, args, settings, tables)


def replay(args: argparse.Namespace, settings: Settings, tables: Tables) -> int:
    """Writes a table's readings as files of JSON events in the order of emission, some of them late, for ``consume``."""
    rows = tables.read(args.readings)
    if rows is None:
        return 1
    rows = with_offset(with_plain_names(rows), args.series, args.ts)
    rows = rows.withColumns({"_key": F.pmod(F.xxhash64(args.series, args.ts), F.lit(1 << 40)), "_s": F.floor(F.col("offset_us") / 1_000_000)})
    rows = late_plan(rows, "_key", "_s", args.base, permille=args.late)
    event_time = F.timestamp_micros(F.unix_micros(F.lit(args.base).cast("timestamp")) + F.col("offset_us"))
    events = rows.withColumns({"event_time": event_time, "series": F.col(args.series).cast("string")}).drop("_s", "late", "delay_s", "offset_us")
    n = write_batches(events, ["emit_at", "_key"], args.files, args.out, "json")
    print(f"{n} files in {args.out}")
    return 0


def consume(args: argparse.Namespace, settings: Settings, tables: Tables) -> int:
    """Stores the events of a folder as they come and their tumbling aggregates, for so many seconds; prints the totals."""
    fields = ["event_time timestamp", "series string", f"{args.code} int", *[f"{column_name(s)} double" for s in args.sensor]]
    pace = telemetry.Pace(args.watermark, args.width, files_per_batch=args.files_per_batch, every=args.every)
    schema = tables.spark.createDataFrame([], ", ".join(fields)).schema
    source = tables.spark.readStream.schema(schema).option("maxFilesPerTrigger", pace.files_per_batch).option("recursiveFileLookup", "true").json(args.events)
    raw = telemetry.start_raw(source, f"{args.out}/raw", f"{args.out}/checkpoints/raw", pace=pace)
    sums = telemetry.start_tumbling(source.withColumnRenamed(args.code, "code"), f"{args.out}/tumbling", f"{args.out}/checkpoints/tumbling", [column_name(s) for s in args.sensor], pace)
    print(json.dumps(telemetry.run_for([raw, sums], args.seconds), sort_keys=True))
    return 0


def _publish(rows: DataFrame | None, args: argparse.Namespace, settings: Settings, tables: Tables) -> int:
    if rows is None:
        return 1
    if args.dry_run:
        rows.show(10, truncate=False)
    else:
        tables.replace(settings.table(args.table), rows)
    return 0


COMMANDS: dict[str, Callable[[argparse.Namespace, Settings, Tables], int]] = {
    "resources": resources, "manifest": attempts, "inspect": inspect, "workbooks": workbooks,
    "train-windows": train_windows, "detect": detect, "train-rows": train_rows, "predict": predict, "replay": replay, "consume": consume,
}


def add_commands(commands: argparse._SubParsersAction) -> None:
    at = {name: commands.add_parser(name, help=f.__doc__.splitlines()[0]) for name, f in COMMANDS.items()}
    at["resources"].add_argument("catalog", help="JSON files")
    for option in ("--format", "--include", "--exclude"):
        at["resources"].add_argument(option, action="append", default=[])
    for name in ("resources", "manifest"):
        at[name].add_argument("-n", type=int, default=20)
    at["inspect"].add_argument("namespace", nargs="?", default="default")
    at["inspect"].add_argument("--table")
    at["workbooks"].add_argument("layout", help="JSON file: key, identity, levels, sheets")
    at["workbooks"].add_argument("root", help="landing folder, a URI")
    at["workbooks"].add_argument("table")
    at["workbooks"].add_argument("--dataset")
    for name in ("train-windows", "detect"):
        at[name].add_argument("readings", help="table")
        for option in ("--series", "--ts"):
            at[name].add_argument(option, required=True)
        at[name].add_argument("--sensor", action="append", required=True)
        for option, value in (("--width", 180), ("--step", 60), ("--most", 200)):
            at[name].add_argument(option, type=int, default=value)
    at["train-windows"].add_argument("--code", required=True, help="column of class codes")
    at["train-windows"].add_argument("--group", action="append", default=[], help="a further criterion of validation")
    at["detect"].add_argument("--hours", type=int, default=24)
    for name in ("train-rows", "predict"):
        at[name].add_argument("rows", help="table")
        at[name].add_argument("--target", required=True)
    at["train-rows"].add_argument("--number", action="append", required=True)
    at["train-rows"].add_argument("--category", action="append", default=[])
    at["train-rows"].add_argument("--group", required=True)
    at["predict"].add_argument("--key", action="append", required=True)
    at["predict"].add_argument("--where", default="true", help="SQL condition: the population")
    at["predict"].add_argument("--complete", default="true", help="SQL condition: the actual value is final")
    for name in ("train-windows", "train-rows"):
        at[name].add_argument("--folds", type=int, default=5)
        at[name].add_argument("--boosted", type=int, default=0, metavar="ROUNDS", help="trees on histograms with missing values, at most so many rounds")
    for name in ("train-windows", "detect", "train-rows", "predict"):
        at[name].add_argument("--models", required=True, help="folder of the models")
        at[name].add_argument("--name", required=True)
    for name in ("detect", "predict"):
        at[name].add_argument("table", help="table to replace")
    for name in ("workbooks", "detect", "predict"):
        at[name].add_argument("--dry-run", action="store_true")
    at["replay"].add_argument("readings", help="table")
    at["replay"].add_argument("out", help="folder of the files")
    for option in ("--series", "--ts"):
        at["replay"].add_argument(option, required=True)
    at["replay"].add_argument("--base", default="2030-01-01", help="time of the first reading of each series")
    at["replay"].add_argument("--late", type=int, default=50, help="events in a thousand that are held back")
    at["replay"].add_argument("--files", type=int, default=100)
    at["consume"].add_argument("events", help="folder of JSON files")
    at["consume"].add_argument("out", help="folder of the tables and checkpoints")
    at["consume"].add_argument("--sensor", action="append", required=True)
    at["consume"].add_argument("--code", default="code")
    for option, value in (("--watermark", "2 minutes"), ("--width", "1 minute"), ("--every", None)):
        at["consume"].add_argument(option, default=value)
    at["consume"].add_argument("--files-per-batch", type=int, default=100)
    at["consume"].add_argument("--seconds", type=float, default=3600)
