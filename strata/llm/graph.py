"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import stored


def _with_least(links: DataFrame) -> DataFrame:
    """Each (u, v) with ``m``, the least of u and all its v. The sums are taken before the join, so a node with
    very many links is only a key that the join may split."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return links.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).union(found.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id``, ``component`` (the least id reachable) of every node that has a link to another and isn't
    itself the least. Rounds grow with the logarithm of the longest path; each is stored."""
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    mark = None
    while True:
        links = stored(_small_star(_large_star(links)), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = now
