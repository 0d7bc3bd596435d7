"""Results that are used more than once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a temporary one in local mode."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strata-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/strata-{spark.sparkContext.applicationId}")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(top)
    # a path without a scheme belongs to the default file system
    return f"{fs.makeQualified(top).toString()}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(files: DataFrame, n_bytes: int | None = None) -> DataFrame:
    """A short table with a row for each file, dealt evenly to tasks that will open them: a task a file, up to the shuffle
    partitions, and beyond them one for each 128 MB. The number is given, so that adaptive execution, which sees only how
    short the rows are, doesn't make it one."""
    found = files.count()
    most = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), (n_bytes or 0) >> 27)
    return files.repartitionByRange(max(1, min(found, most)), *files.columns)
