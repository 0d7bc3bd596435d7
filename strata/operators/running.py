"""Running sums and exact quantiles over all rows, without bringing a group's rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.sources.scratch import stored


def running_sums(rows: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``rows`` and ``<column>_sum`` of each column: the sum over all rows up to this one in ``order``.

    Rows are sorted in ranges; a range sums its own rows and adds the totals of the ranges before it, a row each. The ranges are
    stored first, as ranges made twice may have other bounds. Rows equal in ``order`` are one range's; the order should be total.
    """
    at = F.monotonically_increasing_id()
    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranges")
    # the number that Spark gives a row has the range above 33 bits
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{i}") for i, c in enumerate(columns)])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"_{i}").over(earlier), F.lit(0)).alias(f"_{i}") for i in range(len(columns))]
    before = totals.select(F.col("_range").alias("_r"), *before)
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"{c}_sum": F.sum(c).over(inside) + F.col(f"_{i}") for i, c in enumerate(columns)}
    out = ranged.join(F.broadcast(before), F.col("_range") == F.col("_r")).withColumns(sums)
    return out.drop("_at", "_range", "_r", *[f"_{i}" for i in range(len(columns))])


def same_group(a: str, b: str, by: Sequence[str]):
    """Rows of one group, null keys included."""
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


def exact_quantiles(
    rows: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], weight: str | None = None, between: bool = True
) -> DataFrame:
    """``by``, ``probability``, ``quantile``: interpolated between the two values around the rank, or without ``between`` the least value
    that this share of the rows doesn't exceed. ``weight`` counts a row so many times. Nulls and NaN are no values; a group
    without values has no row.

    Values are counted in each task first; of the distinct ones, in ranges of the sorted order, only those at the ranks go on.
    """
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = known.groupBy(*by, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("long").alias("n")).where("n > 0")
    placed = running_sums(counts, [*by, value], ["n"]).withColumn("_from", F.col("n_sum") - F.col("n"))
    groups = placed.groupBy(*by).agg(F.min("_from").alias("_first"), F.sum("n").alias("_rows"))
    rank = (lambda p: p * (F.col("_rows") - 1)) if between else (lambda p: F.greatest(F.lit(0.0), F.ceil(p * F.col("_rows")) - 1).cast("double"))
    # one expression for all of them: hundreds are too much for a method of Java
    asked = F.transform(F.lit([float(p) for p in probabilities]), lambda p: F.struct(p.alias("probability"), rank(p).alias("rank")))
    groups = groups.withColumn("_asked", asked)
    joined = placed.alias("p").join(groups.alias("g"), same_group("p", "g", by)).select(*[f"p.{c}" for c in by], value, "_asked", (F.col("_from") - F.col("_first")).alias("_lo"), "n")
    holds = lambda r: (r >= F.col("_lo")) & (r < F.col("_lo") + F.col("n"))
    at = F.inline(F.filter("_asked", lambda a: holds(F.floor(a["rank"])) | holds(F.ceil(a["rank"]))))
    found = joined.select(*by, F.col(value).alias("_v"), "_lo", "n", at)
    low, high = (F.max(F.when(holds(f("rank")), F.col("_v"))) for f in (F.floor, F.ceil))
    out = found.groupBy(*by, "probability", "rank").agg(low.alias("_low"), high.alias("_high"))
    quantile = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("rank") - F.floor("rank")) if between else F.col("_low")
    return out.select(*by, "probability", quantile.alias("quantile"))
