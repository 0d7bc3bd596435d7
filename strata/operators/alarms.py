"""Milestones of labelled series, alarms, and how early they came."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.running import exact_quantiles
from strata.operators.sliding import label_severity, severity_label


def milestones(rows: DataFrame, series: str, ts: str, code: Column) -> DataFrame:
    """First time of a transient and of an event of each series; null without."""
    label = severity_label(label_severity(code))
    return rows.groupBy(series).agg(F.min(F.when(label == "transient", F.col(ts))).alias("transient_at"), F.min(F.when(label == "event", F.col(ts))).alias("event_at"))


def first_alarms(windows: DataFrame, series: str, predicted: str, end: str) -> DataFrame:
    return windows.where(F.col(predicted) != "normal").groupBy(series).agg(F.min(end).alias("alarm_at"))


def lead_times(marks: DataFrame, alarms: DataFrame, series: str) -> DataFrame:
    """``moment`` (none, early: before the transient, late: after the event began, on_time) and ``lead_s`` of on-time alarms."""
    out = marks.where("event_at is not null").join(alarms, series, "left")
    moment = F.when(F.col("alarm_at").isNull(), "none").when(F.col("alarm_at") < F.col("transient_at"), "early").when(F.col("alarm_at") > F.col("event_at"), "late").otherwise("on_time")
    lead = F.unix_timestamp(F.col("event_at").cast("timestamp")) - F.unix_timestamp(F.col("alarm_at").cast("timestamp"))
    return out.withColumn("moment", moment).withColumn("lead_s", F.when(F.col("moment") == "on_time", lead))


def lead_statistics(leads: DataFrame, by: str) -> DataFrame:
    """Per group: alarms by moment; mean (0 without any) and median lead of those on time."""
    counts = [F.count(F.when(F.col("moment") == m, 1)).alias(f"n_{m}") for m in ("none", "early", "late", "on_time")]
    means = leads.groupBy(by).agg(*counts, F.coalesce(F.avg("lead_s"), F.lit(0.0)).alias("mean_lead_s"))
    medians = exact_quantiles(leads, [by], "lead_s", [0.5]).select(F.col(by).alias("_by"), F.col("quantile").alias("median_lead_s"))
    return means.join(medians, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def alerts(predictions: DataFrame, label: str, probabilities: Column, version: str, at: Column) -> DataFrame:
    """The windows that aren't normal, with the greatest probability and the model's version."""
    return predictions.where(F.col(label) != "normal").withColumns({"probability": F.array_max(probabilities), "model_version": F.lit(version), "detected_at": at})
