"""Metrics of predictions, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """One row a true label (only those there), one column ``as_<label>`` a predicted one."""
    return df.groupBy(F.col(truth).alias("truth")).agg(*[F.count(F.when(F.col(predicted) == x, 1)).alias(f"as_{x}") for x in labels])


def class_metrics(df: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support of each label, 0 where undefined."""
    spark = df.sparkSession
    names = spark.createDataFrame([(x,) for x in labels], "label string")
    counts = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # each pair counts for its true label and for its predicted one
    sides = F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("true")), F.struct(F.col("p").alias("label"), F.lit(0).alias("true")))
    rows = counts.select("t", "p", "n", F.inline(sides))
    sums = {"hit": (F.col("true") == 1) & (F.col("t") == F.col("p")), "support": F.col("true") == 1, "found": F.col("true") == 0}
    sums = rows.groupBy("label").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in sums.items()])
    out = names.join(sums, "label", "left").select("label", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("hit", "support", "found")])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = out.withColumns({"precision": share("hit", "found"), "recall": share("hit", "support")})
    both = F.col("precision") + F.col("recall")
    return out.select("label", "precision", "recall", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)).alias("f1"), "support")


def log_and_plain(df: DataFrame, truth: str, predicted: str, fold: str, back) -> DataFrame:
    """``scale`` (log, plain), ``fold`` (null: the mean of the folds, which weigh the same), ``mae``, ``rmse``, ``r2``. ``truth`` and
    ``predicted`` are in the log scale; ``back`` takes a column to the plain one."""
    scales = [("log", F.col(truth), F.col(predicted)), ("plain", back(F.col(truth)), back(F.col(predicted)))]
    rows = df.select(fold, F.inline(F.array(*[F.struct(F.lit(n).alias("scale"), t.alias("_t"), p.alias("_p")) for n, t, p in scales])))
    folds = rows.groupBy("scale", fold).agg(*regression(F.col("_t"), F.col("_p")))
    means = folds.groupBy("scale").agg(*[F.avg(c).alias(c) for c in ("mae", "rmse", "r2")])
    return folds.unionByName(means.withColumn(fold, F.lit(None).cast(df.schema[fold].dataType)))


def macro_f1(df: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    return class_metrics(df, truth, predicted, labels).agg(F.avg("f1").alias("macro_f1"))


def regression(truth: Column, predicted: Column) -> list[Column]:
    """``mae``, ``rmse``, ``r2`` (null if the truth doesn't vary)."""
    rest = F.sum(F.pow(truth - predicted, F.lit(2)))
    spread = F.var_pop(truth) * F.count(truth)
    return [F.avg(F.abs(truth - predicted)).alias("mae"), F.sqrt(F.avg(F.pow(truth - predicted, F.lit(2)))).alias("rmse"), (1 - rest / F.nullif(spread, F.lit(0.0))).alias("r2")]
