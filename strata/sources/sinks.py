"""Writes: partition replace, append, whole replace. Plain table writes of Spark in one place."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Catalog tables in Parquet below the session's warehouse."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def replace(self, table: str, df: DataFrame, partition_by: Sequence[str] = ()) -> None:
        """Replaces the partitions that ``df`` has rows of; without partition columns, the whole table."""
        if partition_by and self.spark.catalog.tableExists(table):
            before = self.spark.table(table)
            new = [c for c in df.columns if c not in before.columns]
            if new:
                self.spark.sql(f"alter table {table} add columns ({', '.join(f'`{c}` {df.schema[c].dataType.simpleString()}' for c in new)})")
            order = self.spark.table(table).schema
            from pyspark.sql import functions as F

            aligned = df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in order])
            aligned.write.option("partitionOverwriteMode", "dynamic").insertInto(table, overwrite=True)
            return
        writer = df.write.format("parquet")
        if partition_by or not self.spark.catalog.tableExists(table):
            # there is no table before it
            (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
            return
        # the new table is whole before the old one goes; a write that fails leaves the old one as it is
        new = f"{table}_{uuid.uuid4().hex}"
        try:
            writer.saveAsTable(new)
        except BaseException:
            self.spark.sql(f"drop table if exists {new}")
            raise
        self.spark.sql(f"drop table {table}")
        self.spark.sql(f"alter table {new} rename to {table}")

    def append(self, table: str, df: DataFrame) -> None:
        df.write.mode("append").format("parquet").saveAsTable(table)

    def read(self, table: str) -> DataFrame | None:
        return self.spark.table(table) if self.spark.catalog.tableExists(table) else None
