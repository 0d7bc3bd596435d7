"""What filters do to each other: for every order in which they may be applied, what each step removes.

A document fails or passes each filter whatever the order, so all that an order decides follows from the counts of
documents by the set of filters they fail (a cell). Cells are unpivoted against the steps of all orders; a running bit-or
over the steps of an order tells which failures came earlier.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import hot_keys, let, spread_join, stored, text_of, words_of


@dataclass(frozen=True)
class Rules:
    """When filters A to D fail; E fails for the text of a smaller doc_id."""

    least_words: int = 100
    distinct_percent: int = 80
    upper_percent: int = 10
    symbols: str = "[#$%&*|]"


FILTERS = "ABCDE"


def text_mask(text: Column, rules: Rules) -> Column:
    """Bits 0 to 3: the filters A to D that the text fails."""
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))

    def mask(words: Column) -> Column:
        failed = [
            F.size(words) < rules.least_words,
            100 * F.size(F.array_distinct(words)) < rules.distinct_percent * F.size(words),
            100 * upper > rules.upper_percent * F.length(text),
            F.regexp_like(text, F.lit(rules.symbols)),
        ]
        bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)]
        return bits[0] + bits[1] + bits[2] + bits[3]

    return let(words_of(text), mask)


def cells(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``part``, ``mask`` (bits 0 to 4: the filters A to E that fail), ``n``, ``n_good``, ``n_toxic``: documents by part and mask.

    Texts are read once; what goes on is a short row a document. Copies are found by the SHA-256 of the text: the least id of
    each repeated text is taken per task first and joined to its rows, frequent texts by broadcast.
    """
    text = text_of()
    rows = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_mask(text, rules).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    says = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    rows = stored(rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"]), "masks")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("good").cast("long").alias("n_good"), F.sum("toxic").cast("long").alias("n_toxic")]
    every = rows.groupBy("part", "mask").agg(*sums)
    repeated = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "texts")
    known = spread_join(rows, repeated.select("digest", "first"), ["digest"], hot_keys(repeated, "digest"))
    later = known.where("doc_id > first").groupBy("part", "mask").agg(*sums)
    # a later copy leaves the cell of its text for the one with bit 4
    moved = F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), F.lit(-1).alias("sign")), F.struct((F.col("mask") + 16).alias("mask"), F.lit(1).alias("sign")),
    ))
    later = later.select("part", "n", "n_good", "n_toxic", moved)
    later = later.select("part", "mask", *[(F.col("sign") * F.col(c)).alias(c) for c in ("n", "n_good", "n_toxic")])
    out = every.unionByName(later).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "n_good", "n_toxic")])
    return out.where("n > 0")


def audit(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``found`` (of ``cells``; ``mask`` has a bit a filter, in the order of ``filters``) as a row a part, order and step.

    ``kept`` after the step, ``removed`` here, ``redundant``: removed earlier but failing here too, ``unique_fails``: failing this
    filter only, ``good_lost`` and ``toxic_lost``: of those removed here, ``shapley``: what the filter removes, summed over all orders.
    There are at most 2 ** filters cells a part, and filters! orders; one order's steps are one window.
    """
    orders = ["".join(o) for o in itertools.permutations(filters)]
    steps = found.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    steps = steps.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    steps = steps.withColumn("bit", F.element_at(F.create_map(*[x for i, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << i))]), F.col("filter")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("bit").over(before), F.lit(0)))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    conditions = {
        "kept": (~fails & ~gone, "n"), "removed": (fails & ~gone, "n"), "redundant": (fails & gone, "n"),
        "unique_fails": (F.col("mask") == F.col("bit"), "n"), "good_lost": (fails & ~gone, "n_good"), "toxic_lost": (fails & ~gone, "n_toxic"),
    }
    sums = [F.sum(F.when(c, F.col(n)).otherwise(0)).alias(name) for name, (c, n) in conditions.items()]
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(*sums)
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit_filters(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The audit of the five filters over ``docs`` (``doc_id``, ``text``, ``lang``), with the marks of ``labels`` (``doc_id``, ``quality``,
    ``toxic``); other columns are not read, so their names can't clash.

    A null text is an empty one, a null ``lang`` the part with the empty name (which a ``lang`` of no letters shares). A row without
    ``doc_id`` is no later copy, makes none, and has no labels. Rows that repeat a ``doc_id`` with its text (ties) all count as first.
    A document is good (toxic) if any of its label rows says so. Texts of any length are read whole. An empty table gives no rows, a
    table without failures rows of zeros.
    """
    return audit(cells(docs, labels, rules))
