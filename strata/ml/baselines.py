"""Baselines that are exact: the best single threshold on a feature, and the linear model of least squares.

Both take all folds in one pass: what they need of the rows is summed by fold, and a fold's model has the sums of the others.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.ml.folds import others
from strata.operators.running import exact_quantiles, running_sums, same_group


def _missing(column: str) -> Column:
    return F.col(column).isNull() | F.isnan(F.col(column).cast("double"))


def stumps(counts: DataFrame, by: Sequence[str], feature: str, label: str, labels: Sequence, n: str = "n") -> DataFrame:
    """The tree of depth one for each group of ``by``: ``threshold``, ``fill`` (the median, in place of missing values), ``low`` and ``high`` (the
    labels at most at the threshold and beyond it).

    ``counts`` has a row a group, value and label, with the rows in ``n``; ``labels`` are all there are, in their order. Labels weigh the
    same in total. The threshold halves two neighbouring values; of all, that with the least weighted impurity (Gini), of equals
    the least. Where the feature doesn't vary there is no threshold, and both sides have the heaviest label, the first of equals.
    """
    known = counts.where(~_missing(feature))
    fills = exact_quantiles(known, by, feature, [0.5], weight=n).withColumnRenamed("quantile", "fill")
    one = [F.sum(F.when(F.col(label) == x, F.col(n)).otherwise(0)).cast("long").alias(f"c{i}") for i, x in enumerate(labels)]
    names = [f"c{i}" for i in range(len(labels))]
    filled = counts.alias("c").join(F.broadcast(fills.alias("f")), same_group("c", "f", by), "left")
    value = F.when(_missing(f"c.{feature}"), F.coalesce("fill", F.lit(0.0))).otherwise(F.col(f"c.{feature}").cast("double"))
    sides = filled.select(*[f"c.{c}" for c in by], value.alias("x"), F.col(f"c.{label}").alias(label), F.col(f"c.{n}").alias(n))
    placed = running_sums(sides.groupBy(*by, "x").agg(*one), [*by, "x"], names)
    ends = placed.groupBy(*by).agg(*[F.min(F.col(f"{c}_sum") - F.col(c)).alias(f"{c}_first") for c in names], *[F.sum(c).alias(f"{c}_all") for c in names])
    rows = placed.alias("p").join(F.broadcast(ends.alias("e")), same_group("p", "e", by)).drop(*[F.col(f"e.{c}") for c in by])
    share = lambda part, c: F.when(F.col(f"{c}_all") > 0, part / F.col(f"{c}_all")).otherwise(F.lit(0.0))
    left = [share(F.col(f"{c}_sum") - F.col(f"{c}_first"), c) for c in names]
    right = [share(F.col(f"{c}_all") - F.col(f"{c}_sum") + F.col(f"{c}_first"), c) for c in names]
    total = lambda xs: sum(xs[1:], xs[0])
    # the less impure the sides, the greater the sum of squares over their weight
    purity = total([x * x for x in left]) / total(left) + total([x * x for x in right]) / total(right)
    heaviest = lambda xs: F.array_position(F.array(*xs), F.array_max(F.array(*xs)))
    tried = rows.select(
        *by, "x", F.when(total(right) > 0, purity).alias("purity"), heaviest(left).alias("low"), heaviest(right).alias("high"),
    )
    best = tried.groupBy(*by).agg(F.max(F.struct("purity", (-F.col("x")).alias("less"), "low", "high")).alias("b"))
    best = best.select(*by, (-F.col("b.less")).alias("_x"), F.col("b.purity").isNotNull().alias("_splits"), F.col("b.low").alias("_l"), F.col("b.high").alias("_h"))
    after = tried.alias("t").join(F.broadcast(best.alias("b")), same_group("t", "b", by)).where("x > _x")
    after = after.groupBy(*[F.col(f"b.{c}") for c in by]).agg(F.min("x").alias("_next"))
    out = best.alias("b").join(after.alias("a"), same_group("b", "a", by), "left").drop(*[F.col(f"a.{c}") for c in by])
    out = out.alias("o").join(fills.drop("probability").alias("f"), same_group("o", "f", by), "left").drop(*[F.col(f"f.{c}") for c in by])
    names_of = F.array(*map(F.lit, labels))
    threshold = F.when(F.col("_splits"), (F.col("_x") + F.col("_next")) / 2)
    return out.select(
        *by, threshold.alias("threshold"), "fill", F.element_at(names_of, F.col("_l").cast("int")).alias("low"),
        F.when(F.col("_splits"), F.element_at(names_of, F.col("_h").cast("int"))).otherwise(F.element_at(names_of, F.col("_l").cast("int"))).alias("high"),
    )


def stump_says(feature: str) -> Column:
    """The label that a stump beside the row gives it."""
    value = F.when(_missing(feature), F.col("fill")).otherwise(F.col(feature).cast("double"))
    return F.when(value > F.col("threshold"), F.col("high")).otherwise(F.col("low"))


def out_of_fold_stump(rows: DataFrame, feature: str, label: str, folds: int) -> DataFrame:
    """``predicted``: for each fold what the best threshold of the other folds says. ``rows`` has ``fold``. The labels come to the driver."""
    counts = rows.groupBy("fold", feature, label).agg(F.count(F.lit(1)).alias("n"))
    labels = [r[0] for r in counts.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
    found = stumps(others(counts.where(F.col(label).isNotNull()), folds), ["held"], feature, label, labels)
    out = rows.join(F.broadcast(found), F.col("fold") == F.col("held"), "left").withColumn("predicted", stump_says(feature))
    return out.drop("held", "threshold", "fill", "low", "high")


def out_of_fold_linear(rows: DataFrame, features: Sequence[str], target: str, folds: int) -> DataFrame:
    """``prediction``: for each fold by least squares over the other folds, missing features as the other folds' median. ``rows`` has ``fold``;
    those without a target are predicted and not learned from.

    One pass sums the products of the target, the features and their missing marks by fold; as a filled feature is the sum of
    the feature and so many times its mark, any medians fit these sums. They are a few numbers a fold, and solved on the driver; of
    dependent columns, the solution of least length is taken.
    """
    k = len(features)
    # 1, the features (0 where missing), their marks, the target
    terms = [F.lit(1.0), *[F.when(_missing(c), 0.0).otherwise(F.col(c).cast("double")) for c in features], *[_missing(c).cast("double") for c in features], F.col(target).cast("double")]
    pairs = [(i, j) for i in range(2 * k + 2) for j in range(i, 2 * k + 2)]
    known = rows.where(~_missing(target)).select("fold", *[t.alias(f"t{i}") for i, t in enumerate(terms)])
    sums = known.groupBy("fold").agg(*[F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"s{i}_{j}") for i, j in pairs]).collect()
    moments = np.zeros((folds, 2 * k + 2, 2 * k + 2))
    for r in sums:
        for i, j in pairs:
            moments[r["fold"], i, j] = moments[r["fold"], j, i] = r[f"s{i}_{j}"]
    medians = {}
    for c in features:
        counts = rows.where(~_missing(target)).groupBy("fold", F.col(c).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        for r in exact_quantiles(others(counts, folds), ["held"], "v", [0.5], weight="n").collect():
            medians[r["held"], c] = r["quantile"]
    out = F.lit(None).cast("double")
    for held in range(folds):
        m = moments.sum(0) - moments[held]
        if not m[0, 0]:
            continue
        fill = [medians.get((held, c), 0.0) for c in features]
        take = np.zeros((k + 2, 2 * k + 2))
        take[0, 0] = take[k + 1, 2 * k + 1] = 1
        for i in range(k):
            take[1 + i, 1 + i], take[1 + i, 1 + k + i] = 1, fill[i]
        g = take @ m @ take.T
        # columns of length one, so that their scales don't decide what counts as dependent
        size = np.sqrt(np.maximum(np.diag(g)[:-1], 1e-300))
        b = np.linalg.lstsq(g[:-1, :-1] / np.outer(size, size), g[:-1, -1] / size, rcond=1e-12)[0] / size
        fit = F.lit(float(b[0]))
        for i, c in enumerate(features):
            fit = fit + F.lit(float(b[1 + i])) * F.when(_missing(c), F.lit(float(fill[i]))).otherwise(F.col(c).cast("double"))
        out = F.when(F.col("fold") == held, fit).otherwise(out)
    return rows.withColumn("prediction", out)
