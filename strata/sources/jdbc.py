"""The manifest in a database: the latest good attempts, chosen by the database and read by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.sources.manifest import OK

#: What is read of an attempt.
FIELDS = ("id", "resource_id", "resource_name", "landing_key", "sha256", "ingest_date")


def latest_query(table: str, dataset: str | None = None, status: str = OK, fields: tuple[str, ...] = FIELDS) -> str:
    """A subquery with the last attempt of the status of each resource, of several at one time that with the greatest id; attempts without
    a time come before all others. It is plain SQL, and an index on ``resource_id`` serves it."""
    for name in (table, status, *fields, *([dataset] if dataset else [])):
        if not name.replace("_", "").replace(".", "").isalnum():
            raise ValueError(f"not a name: {name}")
    among = f" AND {{0}}.dataset = '{dataset}'" if dataset else ""
    at = "COALESCE({0}.finished_at, {{ts '0001-01-01 00:00:00'}})".format
    later = f"({at('b')} > {at('a')} OR ({at('b')} = {at('a')} AND b.id > a.id))"
    return (
        f"(SELECT {', '.join(f'a.{f}' for f in fields)} FROM {table} a WHERE a.status = '{status}'{among.format('a')} AND NOT EXISTS "
        f"(SELECT 1 FROM {table} b WHERE b.resource_id = a.resource_id AND b.status = '{status}'{among.format('b')} AND {later})) latest"
    )


def latest_attempts(
    spark: SparkSession, options: dict[str, str], table: str, dataset: str | None = None, status: str = OK,
    fields: tuple[str, ...] = FIELDS, tasks: int = 8,
) -> DataFrame:
    """The rows of ``latest_query`` by so many connections, each with its range of ids. ``options`` are those of Spark's JDBC source (see
    ``session.jdbc_options``); with several tasks the bounds of the ids are asked for first, one row."""
    reader = spark.read.format("jdbc").options(**options)
    if tasks == 1:
        return reader.option("dbtable", latest_query(table, dataset, status, fields)).load()
    low, high = reader.option("dbtable", f"(SELECT MIN(id) AS low, MAX(id) AS high FROM {table}) bounds").load().first()
    source = reader.option("dbtable", latest_query(table, dataset, status, fields))
    if low is None or low == high:
        return source.load()
    return source.option("partitionColumn", "id").option("lowerBound", low).option("upperBound", high + 1).option("numPartitions", tasks).load()
