"""Type-2 history out of periodic observations, and as-of joins to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import fingerprint, key_of


def segments(observed: DataFrame, key: str, month: str, tracked: Sequence[str], last: Sequence[str] = ()) -> DataFrame:
    """One row for each stretch of months of a key in which the tracked values stay the same.

    ``valid_from`` is the first day of the first month, ``valid_to`` the last day of the last month observed, null for
    the current one. Months without observation open no segment and belong to none. ``last`` columns have the last value
    observed in the segment, which may be null. ``month`` is a date, one row for each key and month.
    """
    order = Window.partitionBy(key).orderBy(month)
    rows = observed.withColumn("_print", fingerprint(*tracked))
    before = F.lag("_print").over(order)
    rows = rows.withColumn("_opens", F.when(before.isNull() | (before != F.col("_print")), 1).otherwise(0))
    rows = rows.withColumn("segment", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = [F.first(c).alias(c) for c in tracked] + [F.max_by(c, month).alias(c) for c in last]
    out = rows.groupBy(key, "segment").agg(F.min(month).alias("valid_from"), F.max(month).alias("_until"), F.count(F.lit(1)).alias("months"), *kept)
    current = F.col("segment") == F.max("segment").over(Window.partitionBy(key))
    out = out.withColumn("is_current", current).withColumn("valid_to", F.when(~F.col("is_current"), F.last_day("_until")))
    return out.withColumn("segment_key", key_of(F.col(key), F.col("valid_from"))).drop("_until")


def as_of(facts: DataFrame, history: DataFrame, key: str, at: Column | str, columns: Sequence[str]) -> DataFrame:
    """Left join of each fact to the segment that holds at its time (both ends inclusive); null in gaps.

    The equal key makes it a sort-merge or hash join with the range as a residual condition, so no key meets more than
    its own segments; Spark splits keys with very many facts.
    """
    at = F.col(at) if isinstance(at, str) else at
    h = history.select(F.col(key).alias("_key"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), *columns)
    held = (F.col(key) == F.col("_key")) & (at >= F.col("_from")) & (F.col("_to").isNull() | (at <= F.col("_to")))
    return facts.join(h, held, "left").drop("_key", "_from", "_to")


def overlaps(history: DataFrame, key: str) -> DataFrame:
    """All pairs of a key's segments that overlap, neighbours or not; none in a sound history. The join is by key, and a key has few
    segments; those that no later one begins in are left out before it."""
    order = Window.partitionBy(key).orderBy("valid_from", "segment")
    until = F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))
    rows = history.withColumn("_until", until)
    open_ = rows.withColumn("_next", F.lead("valid_from").over(order)).where(F.col("_next") <= F.col("_until"))
    later = rows.select(F.col(key).alias("_key"), F.col("segment").alias("next_segment"), F.col("valid_from").alias("next_from"))
    after = (F.col("next_from") > F.col("valid_from")) | ((F.col("next_from") == F.col("valid_from")) & (F.col("next_segment") > F.col("segment")))
    pairs = open_.join(later, (F.col(key) == F.col("_key")) & after & (F.col("next_from") <= F.col("_until")))
    return pairs.select(key, "segment", "next_segment", "valid_from", "valid_to", "next_from")
