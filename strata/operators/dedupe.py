"""One row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order. Spark drops the others in part before the shuffle."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def latest(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The row of each key with the greatest values of ``by``, nulls last; any row if ``by`` is empty."""
    return ranked_first(df, keys, [F.col(c).desc_nulls_last() for c in by]) if by else df.dropDuplicates(list(keys))
