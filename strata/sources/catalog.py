"""Catalogs of resources: discovery, selection, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# a pattern is searched for, whatever the case of all letters
SEARCH = "(?iu)"
PACKAGE = "result struct<resources:array<struct<id:string,name:string,url:string,format:string,size:string,last_modified:string,created:string>>>"


def package_resources(spark: SparkSession, path: str) -> DataFrame:
    """Resources of catalog packages in JSON files: sizes as numbers, ``created`` where ``last_modified`` is missing."""
    return _resources(spark.read.schema(PACKAGE).option("multiLine", True).json(path))


def package_resources_by_line(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with a package a line, which any number of tasks can read."""
    return _resources(spark.read.schema(PACKAGE).json(path))


def _resources(raw: DataFrame) -> DataFrame:
    r = raw.select(F.posexplode("result.resources").alias("place", "r")).select("place", "r.*")
    return r.select("place", F.col("id").alias("resource_id"), "name", "url", F.upper("format").alias("format"), F.trim("size").try_cast("long").alias("size"), F.coalesce(F.nullif("last_modified", F.lit("")), "created").alias("last_modified"))


def yearly_resources(spark: SparkSession, name: str, url: str, years: Sequence[int]) -> DataFrame:
    """One resource a year of a templated address (``%d``); its id is of the address, so it stays the same."""
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, years))).alias("year")).withColumn("url", F.format_string(url, "year"))
    return rows.select(F.substring(F.sha2("url", 256), 1, 16).alias("resource_id"), F.concat_ws(" ", F.lit(name), "year").alias("name"), "url", "year")


def selected(resources: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), formats: Sequence[str] = (), only: str | None = None, name: str = "name", place: str = "place") -> DataFrame:
    """Resources of an allowed format, with any of the included patterns and none of the excluded; the first of each id."""
    text, keep = F.coalesce(F.col(name), F.lit("")), F.lit(True)
    if formats:
        keep = keep & F.upper("format").isin([f.upper() for f in formats])
    if include:
        keep = keep & F.regexp_like(text, F.lit(SEARCH + "|".join(f"(?:{p})" for p in include)))
    if exclude:
        keep = keep & ~F.regexp_like(text, F.lit(SEARCH + "|".join(f"(?:{p})" for p in exclude)))
    if only:
        keep = keep & F.regexp_like(text, F.lit(SEARCH + only))
    first = F.row_number().over(Window.partitionBy("resource_id").orderBy(place))
    return resources.where(keep).withColumn("_first", first).where("_first = 1").drop("_first")


def route(name: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The table of the first pattern found in the name; null if none is."""
    return F.coalesce(*[F.when(F.regexp_like(name, F.lit(SEARCH + p)), F.lit(table)) for p, table in rules])


def picked(files: DataFrame, group: str, name: str, quota: int) -> DataFrame:
    """At most ``quota`` files, one of each group in turn by name."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(name))
    return files.withColumn("turn", turn).orderBy("turn", group).limit(quota)


def within_quotas(files: DataFrame, group: str, name: str, quotas: dict) -> DataFrame:
    """Of each group its first files by name, up to its quota; groups without one give none."""
    limit = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    place = F.row_number().over(Window.partitionBy(group).orderBy(name))
    return files.withColumn("place", place).where(F.col("place") <= F.coalesce(limit[F.col(group)], F.lit(0)))


def dealt(items: DataFrame, item: str, targets: DataFrame, target: str) -> DataFrame:
    """Each item with a target, the i-th item by name with target i modulo their number. No targets is an error.

    Both are numbered by stored ranges, so neither needs to be short.
    """
    n = targets.select(target).distinct().count()
    if not n:
        raise ValueError("there is no target to deal to")
    from strata.streaming.replay import numbered

    # both in order, numbered from 0
    number = lambda df, c: numbered(df.select(c).distinct(), [c]).select(c, (F.col("place") - 1).alias("i"))
    left, right = number(items, item), number(targets, target)
    return left.withColumn("j", F.pmod("i", F.lit(n))).join(right.withColumnRenamed("i", "j"), "j").select(item, target)
