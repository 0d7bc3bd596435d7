"""Health and quality of the published tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inventory(tables: Sequence[tuple[str, str | None, DataFrame, str | None]]) -> DataFrame:
    """``table_name``, ``contract``, ``n_rows``, ``last_at`` of (name, contract, frame, time column)."""

    def one(name: str, contract: str | None, df: DataFrame, at: str | None) -> DataFrame:
        last = F.max(at).cast("date") if at else F.lit(None).cast("date")
        return df.agg(F.count(F.lit(1)).alias("n_rows"), last.alias("last_at")).select(F.lit(name).alias("table_name"), F.lit(contract).cast("string").alias("contract"), "n_rows", "last_at")

    return reduce(DataFrame.unionByName, [one(*t) for t in tables])


def daily_quality(runs: DataFrame) -> DataFrame:
    """Per contract and day: runs, rows, rejected rows and their share, failed resources."""
    return runs.groupBy("contract", F.col("run_at").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("rows_in").alias("rows_in"), F.sum("rows_rejected").alias("rows_rejected"),
        F.round(F.sum("rows_rejected") / F.nullif(F.sum("rows_in"), F.lit(0)), 6).alias("reject_rate"),
        F.count_distinct(F.when(F.col("status") == "failed", F.col("resource_id"))).alias("failed_resources"),
    )


def last_quality(runs: DataFrame) -> DataFrame:
    """Per contract: the last run and its status (failed if any of its resources failed)."""
    by_run = runs.groupBy("contract", "run_at").agg(F.max(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("failed"))
    by_run = by_run.withColumn("state", F.when(F.col("failed") == 1, "failed").otherwise("ok"))
    return by_run.groupBy("contract").agg(F.max("run_at").alias("last_run"), F.max_by("state", "run_at").alias("last_status"))


def rejects_by_reason(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "reject_reason")


def health(tables: DataFrame, quality: DataFrame, quarantine: DataFrame, now: Column) -> DataFrame:
    """The inventory with the last quality status, rejected rows and age; a table without a contract matches neither."""
    out = tables.join(quality, "contract", "left").join(quarantine.select("contract", F.col("n_rows").alias("n_rejected")), "contract", "left")
    return out.withColumn("age_days", F.datediff(now, "last_at")).orderBy("table_name")


def partition_counts(df: DataFrame, *partitions: str) -> DataFrame:
    """Rows and files of each partition of a file-backed frame; one row without partition columns."""
    return df.groupBy(*partitions).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col("_metadata.file_path")).alias("n_files"))


def last_written(df: DataFrame) -> DataFrame:
    """``written_at``: when the newest file of a file-backed frame was written; null without files."""
    return df.agg(F.max("_metadata.file_modification_time").alias("written_at"))


def newest_runs(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.col("run_at").desc(), "contract", "resource_id").limit(n)


def run_totals(runs: DataFrame) -> DataFrame:
    """One row: rows in, out and rejected, and the failed runs."""
    return runs.agg(F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"), F.sum("rows_rejected").alias("rows_rejected"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))
