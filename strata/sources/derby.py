"""Tables as Derby databases that every process reads at once: each holds a part of the rows and is packed, so none is locked."""

from __future__ import annotations

import glob
import os
import subprocess
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyspark
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.sources.scratch import scratch_path

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def _load(folder: str, statements: Sequence[str]) -> None:
    """A new database ``db`` in the folder by Derby's own command line, a Java process that ends when the database is whole and closed."""
    jars = glob.glob(os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars", "derby*.jar"))
    java = os.path.join(os.environ["JAVA_HOME"], "bin", "java") if os.environ.get("JAVA_HOME") else "java"
    with open(f"{folder}/load.sql", "w") as script:
        script.writelines(f"{s};\n" for s in ("connect 'jdbc:derby:db;create=true'", *statements, "exit"))
    command = [java, "-Xmx256m", "-XX:+UseSerialGC", f"-Dderby.system.home={folder}", "-cp", ":".join(jars), "org.apache.derby.tools.ij", "load.sql"]
    done = subprocess.run(command, cwd=folder, capture_output=True, text=True)
    # the command goes on after an error and ends well
    if done.returncode or "ERROR " in done.stdout or not os.path.exists(f"{folder}/db/service.properties") or os.path.exists(f"{folder}/db/db.lck"):
        raise RuntimeError(f"Derby failed: {done.stdout[-2000:]}{done.stderr[-2000:]}")


def packed(rows: DataFrame, key: str, table: str, columns: str, index: str, parts: int) -> list[str]:
    """Writes ``rows`` to so many databases, all rows of a ``key`` to one, and returns their addresses; parts without rows have none. ``columns`` are
    those of the rows, in their order, with Derby's types; ``index`` is indexed.

    Every task loads a part and packs it into a file in the shared folder. A packed database is read only, so any number of processes
    can open it, where a folder belongs to one. Only addresses pass through the driver.
    """
    at = urlsplit(scratch_path(rows.sparkSession, "databases"))
    if at.scheme != "file":
        raise ValueError(f"a database can't be opened in {at.scheme}: spark.checkpoint.dir must be a folder of the file system")
    shared = unquote(at.path)
    texts = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in rows.dtypes]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        with tempfile.TemporaryDirectory() as made:
            # a temporary folder named by way of the task's own working folder is another one to the process that loads
            folder = os.path.realpath(made)
            # null is nothing, and an empty text is quoted
            with csv.CSVWriter(f"{folder}/rows.csv", first.schema, write_options=csv.WriteOptions(include_header=False, quoting_style="all_valid")) as out:
                out.write_batch(first)
                for batch in batches:
                    out.write_batch(batch)
            name = table.upper()
            _load(folder, [f"create table {name} ({columns})", f"call SYSCS_UTIL.SYSCS_IMPORT_TABLE(null, '{name}', 'rows.csv', ',', '\"', 'UTF-8', 0)", f"create index by_{name} on {name} ({index})"])
            os.makedirs(shared, exist_ok=True)
            # of a task that runs twice, only the one that ends well tells its file
            path = f"{shared}/{uuid.uuid4().hex}.jar"
            with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as jar:
                for top, _, names in os.walk(f"{folder}/db"):
                    for n in names:
                        jar.write(f"{top}/{n}", os.path.relpath(f"{top}/{n}", folder))
        yield pa.RecordBatch.from_pydict({"path": [path]})

    dealt = rows.select(texts).repartition(parts, key).sortWithinPartitions(key)
    return [f"jdbc:derby:jar:({r['path']})db" for r in dealt.mapInArrow(load, "path string").collect()]
