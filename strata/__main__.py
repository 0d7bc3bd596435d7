"""Command line: ``python -m strata COMMAND ...``.

Exit status: 0 done, 1 something failed, 2 no such query or contract.
"""

from __future__ import annotations

import argparse
import dataclasses
import datetime
import logging
import sys
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.commands import COMMANDS, add_commands
from strata.operators.contracts import Contract, load_pending
from strata.plans import REGISTRIES
from strata.session import Settings, session
from strata.sources import catalog, files, landing, manifest
from strata.sources.sinks import Tables

logger = logging.getLogger("strata")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strata")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names of all queries")
    one = commands.add_parser("run", help="runs a query and shows or writes its rows")
    one.add_argument("query")
    one.add_argument("tables", help="folder of the tables")
    one.add_argument("--out", help="Parquet folder")
    ingest = commands.add_parser("ingest", help="lands the resources of catalog packages and logs the attempts")
    ingest.add_argument("catalog", help="JSON files")
    ingest.add_argument("root", help="landing folder, a URI")
    ingest.add_argument("--format", action="append", default=[])
    ingest.add_argument("--include", action="append", default=[])
    ingest.add_argument("--exclude", action="append", default=[])
    ingest.add_argument("--only")
    ingest.add_argument("--limit", type=int, help="the first so many by name")
    ingest.add_argument("--dry-run", action="store_true")
    raw = commands.add_parser("raw", help="loads a delimited file into a raw table, replacing that resource")
    raw.add_argument("path")
    raw.add_argument("table")
    raw.add_argument("--resource-id", required=True)
    raw.add_argument("--dry-run", action="store_true")
    silver = commands.add_parser("silver", help="loads new or changed resources of a raw table by a contract")
    silver.add_argument("contract", help="YAML file")
    silver.add_argument("--resource-id")
    add_commands(commands)
    args = parser.parse_args(argv)

    known = {name: f for r in REGISTRIES for name, f in r.queries.items()}
    if args.command == "queries":
        print("\n".join(sorted(known)))
        return 0
    settings = Settings.load()
    if args.command == "run":
        if args.query not in known:
            print(f"no query {args.query}", file=sys.stderr)
            return 2
        df = known[args.query](session(settings), args.tables)
        df.write.mode("overwrite").parquet(args.out) if args.out else df.show(truncate=False)
        return 0
    spark = session(settings)
    tables = Tables(spark)
    if args.command in COMMANDS:
        return COMMANDS[args.command](args, settings, tables)
    if args.command == "ingest":
        now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        found = catalog.selected(catalog.package_resources(spark, args.catalog), args.include, args.exclude, args.format, args.only)
        found = landing.with_status(found if args.limit is None else found.orderBy("name", "resource_id").limit(args.limit))
        log = tables.read("ops_manifest")
        log = spark.createDataFrame([], manifest.SCHEMA) if log is None else log
        if args.dry_run:
            manifest.decisions(found, log).select("resource_id", "name", "decision").show(truncate=False)
            return 0
        made, run_id = landing.land(found, log, args.root, now.date().isoformat()), uuid.uuid4().hex
        order = F.row_number().over(Window.orderBy("resource_id")) + (log.agg(F.max("id")).first()[0] or 0)
        rows = made.withColumns({"id": order.cast("long"), "run_id": F.lit(run_id), "dataset": F.lit(args.catalog), "ingest_date": F.lit(now.date()), "started_at": F.lit(now), "finished_at": F.lit(now)})
        # the attempts are made by this write, once; what they came to is read from the log
        tables.append("ops_manifest", rows.select(*[F.col(f.name).cast(f.dataType) for f in manifest.SCHEMA]))
        logged = tables.read("ops_manifest").where(F.col("run_id") == run_id)
        manifest.run_summary(logged).show()
        return int(logged.where("status = 'failed'").count() > 0)
    if args.command == "raw":
        found = files.hashed_files(spark, args.path).first()
        if args.dry_run:
            print(f"{found['path']} {found['size']} {found['sha256']}")
            return 0
        rows = files.with_lineage(files.read_delimited(spark, args.path), args.resource_id, found["path"].rpartition("/")[2], found["path"], found["sha256"], datetime.date.today().isoformat())
        tables.replace(settings.table(args.table), rows, ("_resource_id",))
        return 0
    try:
        contract = Contract.from_yaml(args.contract)
        # both ends carry the environment's suffix, so that a trial never writes to the tables of another environment
        contract = dataclasses.replace(contract, table=settings.table(contract.table), source=settings.table(contract.source))
    except OSError as e:
        print(e, file=sys.stderr)
        return 2
    raw_rows = tables.read(contract.source)
    if raw_rows is None:
        print(f"there is no table {contract.source}", file=sys.stderr)
        return 2
    if args.resource_id:
        raw_rows = raw_rows.where(F.col("_resource_id") == args.resource_id)
    runs = load_pending(raw_rows, tables.read(contract.table), contract, datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None), tables, settings.table("ops.dq_runs") if settings.environment else "dq_runs")
    failed = 0
    # one after the other, however many there are
    for failed, r in enumerate(runs.where("status = 'failed'").select("resource_id").toLocalIterator(), 1):
        logger.error("contract %s failed for: %s", args.contract, r["resource_id"])
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
