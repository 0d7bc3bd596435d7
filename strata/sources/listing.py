"""Directories of another store: what they list, which files are taken, and which of these are landed already."""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.sources.manifest import OK, UNCHANGED, latest_attempts
from strata.sources.scratch import spread

PIECE = 8 << 20


def blob_hash(uri: str, size: int) -> str:
    """The hash by which version control knows a file: SHA-1 of the word blob, the size, a zero byte and the content."""
    # Spark names paths as they are, and a URI has them quoted
    system, path = pafs.FileSystem.from_uri(quote(re.sub("^file:/(?!/)", "file:///", uri), safe=":/@"))
    sha = hashlib.sha1(f"blob {size}\0".encode())
    with system.open_input_stream(path, compression=None) as stream:
        while piece := stream.read(PIECE):
            sha.update(piece)
    return sha.hexdigest()


def walk(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """Paths and sizes of all files below ``root``, in order. Names pass through the driver, as they do in Spark's own index of files, which
    leaves out empty ones."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files, found = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True), []
    while files.hasNext():
        file = files.next()
        found.append((file.getPath().toString(), file.getLen()))
    return sorted(found)


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path``, ``size`` and ``sha`` (``blob_hash``) of the files below ``root``. Tasks read the files, in parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(sha=[blob_hash(p, s) for p, s in zip(b["path"], b["size"])])

    found = [(path, size) for path, size in walk(spark, root) if fnmatch.fnmatch(path.rpartition("/")[2], pattern)]
    rows = spark.createDataFrame(found, "path string, size long")
    return spread(rows, sum(size for _, size in found)).mapInPandas(run, "path string, size long, sha string")


def chosen(files: DataFrame, group: str, owner: str, name: str, quotas: dict, prefix: str = "") -> DataFrame:
    """Of each group up to its quota of the files whose names begin so, dealt over the owners: each owner's first one by name, then each
    one's second. Groups without a quota give none."""
    limit = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    turn = F.row_number().over(Window.partitionBy(group, owner).orderBy(name))
    rows = files.where(F.col(name).startswith(prefix)).withColumn("_turn", turn)
    # no owner gives more than the quota, so no group's window has more than that times its owners
    rows = rows.where(F.col("_turn") <= F.coalesce(limit[F.col(group)], F.lit(0)))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_turn", owner))
    return rows.withColumn("_place", place).where(F.col("_place") <= limit[F.col(group)]).drop("_turn", "_place")


def fetch_decisions(files: DataFrame, manifest: DataFrame, landed: DataFrame) -> DataFrame:
    """``files`` (``resource_id``, ``sha``) and ``decision``: ``unchanged`` if the last good attempt had the same hash and what lies at its landing key
    now (``landed``: ``landing_key``, ``size``) has the size that was landed; else ``download``."""
    last = latest_attempts(manifest, (OK, UNCHANGED)).select(
        F.col("resource_id").alias("_id"), F.col("last_modified").alias("_sha"), F.col("landing_key").alias("_key"), F.col("bytes").alias("_bytes"),
    )
    there = landed.select(F.col("landing_key").alias("_there"), F.col("size").alias("_size"))
    last = last.join(there, F.col("_key") == F.col("_there"), "left")
    same = (F.col("sha") == F.col("_sha")) & (F.col("_size") == F.col("_bytes"))
    out = files.join(last, F.col("resource_id") == F.col("_id"), "left")
    return out.withColumn("decision", F.when(same, UNCHANGED).otherwise("download")).drop("_id", "_sha", "_key", "_bytes", "_there", "_size")
