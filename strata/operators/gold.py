"""Dimensions, facts and the feature mart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.columns import days_between, month_key, months_apart, name_key, squeeze


def entities(names: Sequence[DataFrame], prefix: str) -> DataFrame:
    """``entity_key``, ``name``, ``in_group`` (the name starts with the prefix): the distinct names of several frames of
    one column, whatever their case and spacing. Null names are left out."""
    rows = None
    for df in names:
        one = df.select(squeeze(F.col(f"`{df.columns[0]}`")).alias("name"))
        rows = one if rows is None else rows.union(one)
    rows = rows.where("name is not null").distinct()
    return rows.select(name_key("name").alias("entity_key"), "name", F.col("name").startswith(prefix).alias("in_group"))


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row a month from first to last (dates as text)."""
    months = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("first_day"))
    return months.select(
        month_key("first_day").cast("int").alias("date_key"), F.year("first_day").alias("year"), F.month("first_day").alias("month"), F.quarter("first_day").alias("quarter"),
        F.date_format("first_day", "yyyy-MM").alias("label"), "first_day", F.last_day("first_day").alias("last_day"),
    )


def latest_attributes(rows: DataFrame, key: str, period: Column, attributes: Sequence[str]) -> DataFrame:
    """Attributes of each key at its latest period, null if they are null then."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max_by(F.col(a), period).alias(a) for a in attributes])


def with_age(facts: DataFrame, month: str, registry: DataFrame, key: str, first: str) -> DataFrame:
    """``age_months`` since the registered first month; null without one, negative before it."""
    known = registry.select(F.col(key).alias("_key"), F.col(first).alias("_first"))
    return facts.join(known, F.col(key) == F.col("_key"), "left").withColumn("age_months", months_apart(month, "_first")).drop("_key", "_first")


def with_duration(facts: DataFrame, start: str, end: str) -> DataFrame:
    return facts.withColumn("duration_days", days_between(start, end))


def grouped_distinct(rows: DataFrame, keys: Sequence[str], distinct: str, value: str) -> DataFrame:
    """``n_distinct`` and ``total`` (null where all are null)."""
    return rows.groupBy(*keys).agg(F.count_distinct(distinct).alias("n_distinct"), F.sum(value).alias("total"))


def first_months(facts: DataFrame, key: str, age: str, measures: Sequence[str], horizons: Sequence[int] = (3, 6, 12)) -> DataFrame:
    """Sums over the first months of each key, and ``months_observed`` within the longest. Ages out of range don't count."""
    top = max(horizons)
    within = facts.where(F.col(age).between(0, top - 1))
    sums = [F.sum(F.when(F.col(age) < h, F.col(m))).alias(f"{m}_{h}m") for m in measures for h in horizons]
    return within.groupBy(key).agg(*sums, F.count(F.lit(1)).alias("months_observed"))


def last_of(rows: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """The latest row of each key; of several, that with the greatest ``tie``."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(by).desc_nulls_last(), F.col(tie).desc()))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")
