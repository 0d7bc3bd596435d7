"""Data tests: each returns the rows that violate it, so none is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values found more than once; nulls don't count."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def grain(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def accepted(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values that aren't in the list, with their number; null passes."""
    return df.where(~F.col(column).isin(list(values))).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def relationship(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values without a parent, with their number; null passes."""
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return values.join(parent.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")


def reconciled(a: DataFrame, b: DataFrame, total_a: Column, total_b: Column, tolerance: float = 1.0) -> DataFrame:
    """The two totals, if they differ by more than the tolerance. Both sides are one row."""
    both = a.agg(total_a.alias("total_a")).crossJoin(b.agg(total_b.alias("total_b")))
    return both.where(F.abs(F.col("total_a") - F.col("total_b")) > tolerance)


def freshness(df: DataFrame, loaded_at: str, now: Column, warn_days: int, error_days: int) -> DataFrame:
    """``last_loaded``, ``age_days`` and ``status`` (pass, warn, error; error if there is no row)."""
    out = df.agg(F.max(loaded_at).alias("last_loaded")).withColumn("age_days", F.datediff(now, "last_loaded"))
    status = F.when(F.col("age_days").isNull() | (F.col("age_days") > error_days), "error").when(F.col("age_days") > warn_days, "warn").otherwise("pass")
    return out.withColumn("status", status)
