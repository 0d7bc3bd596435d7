"""Sliding windows that begin with each series, their statistics and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = ("mean", "std", "min", "max", "slope", "delta")


def adaptive_step(duration_s: Column, step_s: int, most: int) -> Column:
    """The step that gives a series of this duration at most about ``most`` windows."""
    return F.greatest(F.lit(step_s), F.ceil(duration_s / most)).cast("long")


def windowed(rows: DataFrame, series: str, ts: str, width_s: int, step_s: int | None = None, step: Column | None = None) -> DataFrame:
    """Each row once for each complete window that holds it: ``k`` (from 0), ``dt`` (seconds since the series began) and
    ``window_start`` (likewise).

    Windows are half open and begin every step from the series' first time; the last ones that the series doesn't fill are
    left out. ``step`` is a column that is constant in a series.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    # bounds are summed in each task first and joined, so a very long series isn't brought to one task
    bounds = rows.groupBy(F.col(series).alias("_series")).agg(F.min(at).alias("_from"), F.max(at).alias("_to"))
    rows = rows.join(bounds, F.col(series) == F.col("_series"))
    rows = rows.withColumn("dt", (at - F.col("_from")) / 1_000_000).withColumn("_last", (F.col("_to") - F.col("_from")) / 1_000_000).withColumn("_step", F.lit(step_s) if step is None else step)
    first = F.greatest(F.lit(0), F.floor((F.col("dt") - width_s) / F.col("_step")) + 1)
    rows = rows.withColumn("k", F.explode(F.sequence(first.cast("long"), F.floor(F.col("dt") / F.col("_step")).cast("long"))))
    rows = rows.withColumn("window_start", F.col("k") * F.col("_step")).where(F.col("window_start") + width_s <= F.col("_last"))
    return rows.drop("_last", "_step", "_series", "_from", "_to")


def statistics(sensor: str, t: str = "dt") -> list[Column]:
    """Mean, population deviation, least, greatest, slope over time and last minus first of a sensor; all null with fewer
    than two samples. NaN is no sample. The slope is null where all samples are of one instant, and 0 of a sensor that doesn't vary."""
    y = F.when(~F.isnan(F.col(sensor)), F.col(sensor))
    when = F.when(y.isNotNull(), F.col(t))
    values = {
        "mean": F.avg(y), "std": F.stddev_pop(y), "min": F.min(y), "max": F.max(y),
        "slope": F.when(F.var_pop(when) > 0, F.regr_slope(y, F.col(t))), "delta": F.max_by(y, when) - F.min_by(y, when),
    }
    return [F.when(F.count(y) >= 2, values[s]).alias(f"{sensor}_{s}") for s in STATISTICS]


def label_severity(code: Column) -> Column:
    """Of a class code: 0 normal (0), 1 transient (100 and more), 2 event (all others); null and NaN have none."""
    known = code.isNotNull() & ~F.isnan(code.cast("double"))
    return F.when(known, F.when(code == 0, 0).when(code >= 100, 1).otherwise(2))


def severity_label(severity: Column) -> Column:
    return F.when(severity == 2, "event").when(severity == 1, "transient").when(severity == 0, "normal")


def features(rows: DataFrame, series: str, sensors: Sequence[str], label: Column | None = None, trained: bool = False) -> DataFrame:
    """One row a window with a sensor: statistics of all sensors, and the worst label. ``trained`` leaves out windows without one."""
    count = F.greatest(*[F.count(F.when(~F.isnan(F.col(s)), F.col(s))) for s in sensors]) if len(sensors) > 1 else F.count(F.when(~F.isnan(F.col(sensors[0])), F.col(sensors[0])))
    found = [c for s in sensors for c in statistics(s)]
    worst = F.max(label_severity(label)) if label is not None else F.lit(None).cast("int")
    out = rows.groupBy(series, "k", "window_start").agg(F.count(F.lit(1)).alias("n_rows"), count.alias("_samples"), *found, severity_label(worst).alias("label"))
    out = out.where("_samples > 0").drop("_samples")
    return out.where("label is not null") if trained else out
