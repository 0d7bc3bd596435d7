"""Folds that never split a group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.running import exact_quantiles
from strata.sources.scratch import stored
from strata.streaming.replay import numbered


def _deal(folds: int):
    """(size, groups) from the largest size down to runs of groups: those at the places from ``since`` to before ``until`` go to the
    folds of ``turn``, one after the other and again from the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, place = [0] * folds, 1
        for batch in batches:
            out = []
            for size, left in zip(batch["n"].to_pylist(), batch["groups"].to_pylist()):
                while left:
                    order = sorted(range(folds), key=lambda f: (sums[f], f))
                    low = order[0]
                    # those that are lightest once before the lightest one is lightest again
                    turn = [f for f in order if (sums[f], f) < (sums[low] + size, low)]
                    # how often they take turns before another fold is among them
                    others = [(sums[f] - sums[low] - (f < low)) // size for f in order[len(turn):]]
                    rounds = min([left // len(turn), *others])
                    taken = rounds * len(turn) or left
                    for f in turn[: min(taken, len(turn))]:
                        sums[f] += size * max(rounds, 1)
                    out.append((size, place, place + taken, turn))
                    place, left = place + taken, left - taken
            if out:
                arrays = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(arrays, ["n", "since", "until", "turn"])

    return run


def group_folds(rows: DataFrame, group: str, folds: int, broadcast_sizes: int = 100_000) -> DataFrame:
    """``group``, ``n``, ``fold``: groups from the largest down (of equals, the least first) each go to the fold with the fewest rows so far
    (of equals, the first).

    Groups of one size are dealt together: the folds that are lightest take turns until others come in. What one task sees is a row a
    distinct size, at most the root of twice the number of rows; it holds a sum a fold.
    """
    sizes = stored(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")), "sizes")
    kinds = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups"))
    runs = kinds.repartition(1).sortWithinPartitions(F.col("n").desc()).mapInArrow(_deal(folds), "n long, since long, until long, turn array<int>")
    runs = stored(runs.groupBy(F.col("n").alias("_n")).agg(F.collect_list(F.struct("since", "until", "turn")).alias("runs")), "runs")
    placed = numbered(sizes.withColumn("_less", -F.col("n")), ["_less", group])
    placed = placed.join(F.broadcast(runs) if runs.count() <= broadcast_sizes else runs, F.col("n") == F.col("_n"))
    run = F.get(F.filter("runs", lambda r: (F.col("place") >= r["since"]) & (F.col("place") < r["until"])), F.lit(0))
    fold = F.get(run["turn"], F.pmod(F.col("place") - run["since"], F.size(run["turn"])).cast("int"))
    return placed.select(group, "n", fold.alias("fold"))


def with_folds(rows: DataFrame, group: str, folds: int, broadcast_groups: int = 100_000) -> DataFrame:
    """``rows`` and ``fold``; rows without a group are one group.

    Of the two sides only the groups are ever broadcast, and they are counted first: Spark, which doesn't know their number, would send all
    rows to the driver where these are the smaller files.
    """
    dealt = stored(group_folds(rows, group, folds).select(F.col(group).alias("_group"), "fold"), "dealt")
    dealt = F.broadcast(dealt) if dealt.count() <= broadcast_groups else dealt.hint("merge")
    return rows.join(dealt, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def others(counts: DataFrame, folds: int) -> DataFrame:
    """``counts`` (with ``fold``) once for each other fold, named ``held``."""
    held = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    return counts.withColumn("held", held).where("held <> fold")


def out_of_fold_median(rows: DataFrame, target: str, folds: int) -> DataFrame:
    """``predicted``: for each fold the median target of the other folds. ``rows`` has ``fold``."""
    # values are counted first, so only distinct ones are repeated for each fold
    counts = rows.groupBy("fold", target).agg(F.count(F.lit(1)).alias("n"))
    medians = exact_quantiles(others(counts, folds), ["held"], target, [0.5], weight="n").select("held", F.col("quantile").alias("predicted"))
    return rows.join(F.broadcast(medians), F.col("fold") == F.col("held"), "left").drop("held")


def out_of_fold_majority(rows: DataFrame, label: str, folds: int) -> DataFrame:
    """``predicted``: for each fold the label found most often in the other folds, the least of equals. ``rows`` has ``fold``."""
    counts = rows.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n"))
    sums = others(counts, folds).groupBy("held", label).agg(F.sum("n").alias("n"))
    most = sums.groupBy("held").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("l")))["l"].alias("predicted"))
    return rows.join(F.broadcast(most), F.col("fold") == F.col("held"), "left").drop("held")


def permuted(rows: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """``rows`` with the values of a column dealt anew: those of the i-th row by key go to the i-th by a hash of it."""
    by_key = numbered(rows, [key])
    values = numbered(rows.select(column, F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))).alias("_h"), key), ["_h", key]).select(F.col("place").alias("_p"), F.col(column).alias("_v"))
    return by_key.join(values, F.col("place") == F.col("_p")).withColumn(column, F.col("_v")).select(*rows.columns)


def with_weights(rows: DataFrame, label: str) -> DataFrame:
    """``weight``: rows / (classes * rows of the class), so that all classes weigh the same."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # one row a class
    every = Window.partitionBy()
    weights = counts.select(F.col(label).alias("_label"), (F.sum("_n").over(every) / (F.count(F.lit(1)).over(every) * F.col("_n"))).alias("weight"))
    return rows.join(weights, F.col(label) == F.col("_label")).drop("_label")
