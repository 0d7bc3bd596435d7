"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.sources.scratch import scratch_path, spread, stored  # noqa: F401

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def total(values: Column, zero: str = "bigint") -> Column:
    return F.aggregate(values, F.lit(0).cast(zero), lambda a, x: a + x)


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own names can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def hot_keys(counts: DataFrame, *key: str, n: str = "n", parts: int = 1000) -> DataFrame:
    """The keys of ``counts`` (a row a key, with its rows in ``n``) that hold more than one row in ``parts`` of all: fewer
    than ``parts`` keys, whatever the data, so the table can be broadcast."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) * parts > total).select(*key)


def spread_join(rows: DataFrame, table: DataFrame, key: list[str], hot: DataFrame) -> DataFrame:
    """``rows`` joined with ``table`` (a row a key): the keys of ``hot`` (of ``hot_keys``) where they are, by broadcast, so that
    none of them fills a task; all others by shuffle."""
    hot = F.broadcast(hot)
    here = rows.join(F.broadcast(table.join(hot, key, "left_semi")), key)
    return here.unionByName(rows.join(hot, key, "left_anti").join(table, key))
