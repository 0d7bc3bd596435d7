"""The manifest: a row for each attempt at a resource, and what follows from the attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OK, UNCHANGED, FAILED = "ok", "unchanged", "failed"
ERROR_CHARS = 2000

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("id", T.LongType()), ("run_id", T.StringType()), ("dataset", T.StringType()), ("resource_id", T.StringType()), ("resource_name", T.StringType()), ("url", T.StringType()),
    ("status", T.StringType()), ("size", T.LongType()), ("last_modified", T.StringType()), ("sha256", T.StringType()), ("landing_key", T.StringType()), ("ingest_date", T.DateType()),
    ("started_at", T.TimestampType()), ("finished_at", T.TimestampType()), ("bytes", T.LongType()), ("error", T.StringType()),
)])


def latest_attempts(manifest: DataFrame, statuses: Sequence[str] = (OK,)) -> DataFrame:
    """The last attempt with one of the statuses of each resource; of several at one time, that with the greatest id."""
    order = Window.partitionBy("resource_id").orderBy(F.col("finished_at").desc_nulls_last(), F.col("id").desc())
    return manifest.where(F.col("status").isin(list(statuses))).withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def resolved(attempts: DataFrame) -> DataFrame:
    """One row an attempt out of the one written at its start (failed until known better) and the one at its end."""
    order = Window.partitionBy("id").orderBy(F.col("finished_at").desc_nulls_last())
    return attempts.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place").withColumn("error", F.substring("error", 1, ERROR_CHARS))


def pending(found: DataFrame, loaded: DataFrame) -> DataFrame:
    """The rows of ``found`` whose ``sha256`` isn't the one loaded for the resource, or that aren't loaded."""
    before = loaded.select(F.col("resource_id").alias("_id"), F.col("sha256").alias("_sha"))
    return found.join(before, F.col("resource_id") == F.col("_id"), "left").where(F.col("_id").isNull() | ~F.col("sha256").eqNullSafe(F.col("_sha"))).drop("_id", "_sha")


def decisions(resources: DataFrame, manifest: DataFrame) -> DataFrame:
    """``decision`` for each resource before any download: ``unchanged`` if size and time are known and those of its last
    good attempt, else ``download``."""
    last = latest_attempts(manifest, (OK, UNCHANGED)).select(F.col("resource_id").alias("_id"), F.col("size").alias("_size"), F.col("last_modified").alias("_at"))
    same = (F.col("size") == F.col("_size")) & (F.col("last_modified") == F.col("_at"))
    out = resources.join(last, F.col("resource_id") == F.col("_id"), "left")
    return out.withColumn("decision", F.when(same, UNCHANGED).otherwise("download")).drop("_id", "_size", "_at")


def after_download(status_before: DataFrame) -> DataFrame:
    """``status`` of a download by its hash: ``unchanged`` if it is that of the last good attempt."""
    return status_before.withColumn("status", F.when(F.col("sha256") == F.col("last_sha256"), UNCHANGED).otherwise(OK))


def run_summary(manifest: DataFrame) -> DataFrame:
    """Attempts and bytes by status."""
    return manifest.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))


def newest(manifest: DataFrame, n: int) -> DataFrame:
    return manifest.orderBy(F.col("finished_at").desc_nulls_last(), F.col("id").desc()).limit(n)
