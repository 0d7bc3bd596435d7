"""Recorded series as a stream of events: offsets, a plan of late ones, rebased times, ordered files."""

from __future__ import annotations

import re
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.sources.listing import walk
from strata.sources.scratch import stored


def with_offset(rows: DataFrame, series: str, ts: str) -> DataFrame:
    """``offset_us`` since the first time of the series."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    first = rows.groupBy(F.col(series).alias("_series")).agg(F.min(at).alias("_from"))
    return rows.join(first, F.col(series) == F.col("_series")).withColumn("offset_us", at - F.col("_from")).drop("_series", "_from")


def looped(rows: DataFrame, times: int, series: str) -> DataFrame:
    """The rows several times, each round a second after the last row of the one before it."""
    last = rows.groupBy(F.col(series).alias("_series")).agg(F.max("offset_us").alias("_last"))
    rows = rows.join(last, F.col(series) == F.col("_series")).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return rows.withColumn("offset_us", F.col("offset_us") + F.col("round") * (F.col("_last") + 1_000_000)).drop("_series", "_last")


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``place`` in the order of all rows, from 1, without bringing them to one task: the place in each range of a
    range-partitioned sort, plus the rows of the ranges before it.

    The ranges are stored with their numbers before anything is counted: ranges made twice may have other bounds, and rows
    would be lost or numbered twice. Rows equal in ``order`` are one range's, and numbered in any order.
    """
    # the number that Spark gives a row has the range above 33 bits, and the place in it below them
    at = F.monotonically_increasing_id()
    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranges")
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    # one row a range
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select(F.col("_range").alias("_r"), before.alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(before, F.col("_range") == F.col("_r")).withColumn("place", place).drop("_at", "_range", "_r", "_before")


def write_ordered(rows: DataFrame, order: Sequence[str], path: str) -> DataFrame:
    """Writes JSON files whose names are in the order of their rows: the files of a later range come later, so a file source
    that takes the oldest names first replays the order. Returns the rows with their ``place``."""
    placed = stored(numbered(rows, order), "placed")
    body = placed.select([c for c in placed.columns if c != "place"] + ["place"])
    body.repartitionByRange("place").sortWithinPartitions("place").drop("place").write.mode("overwrite").json(path)
    return placed


def write_batches(rows: DataFrame, order: Sequence[str], batches: int, path: str, kind: str = "parquet") -> int:
    """Deals the rows, in their order, evenly to so many files, which a file source then reads in this order: one file a batch with
    one file a trigger. Rows held back to the end (by ``late_plan``) are the last files' own. Returns the number of files.

    The file source goes by the times of files, so these are set a second apart; only names pass through the driver.
    """
    placed = stored(numbered(rows, order), "placed")
    n = placed.count()
    batch = F.lpad(F.floor((F.col("place") - 1) * batches / F.lit(max(n, 1))).cast("string"), 9, "0")
    dealt = placed.withColumn("batch", batch).drop("place")
    dealt.repartition("batch").sortWithinPartitions("batch", *order).write.partitionBy("batch").format(kind).save(path)
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [p for p, _ in walk(spark, path) if re.search("/batch=[0-9]+/part-[^/]*$", p)]
    begin = int(time.time() * 1000) - 1000 * len(found)
    for i, at in enumerate(found):
        fs.setTimes(hadoop(at), begin + 1000 * i, -1)
    return len(found)


def late_plan(rows: DataFrame, key: str, offset_s: str, base: str, permille: int = 50, least_s: int = 30, most_s: int = 120) -> DataFrame:
    """``late``, ``delay_s`` and ``emit_at``: which events are held back and for how long, by fixed arithmetic on the key, so
    that every run has the same plan."""
    late = F.pmod(F.col(key) * 7919 + 17, F.lit(1000)) < permille
    delay = F.when(late, least_s + F.pmod(F.col(key) * 104729 + 7, F.lit(most_s - least_s + 1))).otherwise(0)
    emit = F.timestamp_seconds(F.unix_seconds(F.lit(base).cast("timestamp")) + F.col(offset_s) + F.col("delay_s")).cast("timestamp_ntz")
    return rows.withColumn("late", late).withColumn("delay_s", delay).withColumn("emit_at", emit)


def rebased(rows: DataFrame, ts: str, base: str) -> DataFrame:
    """``event_time`` counted from ``base`` as the time was from the first; the time as it was in ``original``."""
    first = rows.agg(F.min(ts).alias("_first"))
    # one row
    moved = F.timestamp_micros(F.unix_micros(F.lit(base).cast("timestamp")) + F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp")))
    return rows.crossJoin(F.broadcast(first)).withColumn("event_time", moved.cast("timestamp_ntz")).withColumnRenamed(ts, "original").drop("_first")
