"""Delimited text, landing folders and JSON events."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.scratch import spread

PIECE = 8 << 20


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text; names without byte order mark and space around them."""
    df = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("encoding", "UTF-8").csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def with_lineage(df: DataFrame, resource_id: str, name: str, key: str, sha256: str, ingest_date: str, origin: str = "real") -> DataFrame:
    return df.withColumns({"_resource_id": F.lit(resource_id), "_resource_name": F.lit(name), "_landing_key": F.lit(key), "_source_sha256": F.lit(sha256), "_ingest_date": F.lit(ingest_date).cast("date"), "data_origin": F.lit(origin)})


def hashed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and sha256 of whole files of any size: tasks read them in parts, one file each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(sha256=[digest(p) for p in b["path"]])

    # only the names and lengths are read here
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("size"))
    return spread(found, found.agg(F.sum("size")).first()[0]).mapInPandas(run, "path string, size long, sha256 string")


def digest(uri: str) -> str:
    system, path = pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))
    sha = hashlib.sha256()
    with system.open_input_stream(path, compression=None) as stream:
        while piece := stream.read(PIECE):
            sha.update(piece)
    return sha.hexdigest()


def parsed_events(df: DataFrame, value: str, schema: T.StructType) -> DataFrame:
    """The fields of JSON texts of a known schema; texts that aren't such give nulls."""
    return df.select(F.from_json(F.col(value).cast("string"), schema).alias("e")).select("e.*")


def sparse_json(columns: list[Column]) -> Column:
    """JSON of what is there: no key for null. Pass doubles through ``without_nan``."""
    return F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "ignoreNullFields": "true"})


def without_nan(c: str) -> Column:
    return F.when(~F.isnan(F.col(c)), F.col(c)).alias(c)


def lookback(df: DataFrame, ts: str, hours: int) -> DataFrame:
    """Rows of the last hours before the latest time in the data. The time is looked up first, so that the filter reaches the scan."""
    last = df.agg(F.max(ts)).first()[0]
    return df.where(F.lit(False)) if last is None else df.where(F.col(ts) >= F.lit(last - datetime.timedelta(hours=hours)).cast(df.schema[ts].dataType))


def latest_partition(spark: SparkSession, table: str, column: str):
    """The greatest value of a partition column, from the list of partitions alone: a number if all are numbers, else a text."""
    parts = spark.sql(f"show partitions {table}").select(F.regexp_extract("partition", rf"(?:^|/){column}=([^/]+)", 1).alias("v")).where("v <> '__HIVE_DEFAULT_PARTITION__'")
    number = F.col("v").try_cast("long")
    most, text, odd = parts.agg(F.max(number), F.max("v"), F.count(F.when(number.isNull(), 1))).first()
    return text if odd else most
