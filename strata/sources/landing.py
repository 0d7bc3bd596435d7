"""Landing: copies resources as they are and logs every attempt.

Each resource is one row; tasks stream its bytes from its address to the landing folder, with the digest made on the way.
A copy gets its name only when it is whole, and one whose digest is that of the last good attempt is dropped. A
resource that fails is a failed attempt and stops no other.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import safe_key
from strata.sources.scratch import spread
from strata.sources.manifest import ERROR_CHARS, FAILED, OK, UNCHANGED, decisions, latest_attempts

PIECE = 8 << 20
ATTEMPT = T.StructType([T.StructField(n, t) for n, t in (
    ("resource_id", T.StringType()), ("resource_name", T.StringType()), ("url", T.StringType()), ("status", T.StringType()), ("size", T.LongType()), ("last_modified", T.StringType()),
    ("sha256", T.StringType()), ("landing_key", T.StringType()), ("bytes", T.LongType()), ("error", T.StringType()),
)])


def with_landing_key(resources: DataFrame, ingest_date: str) -> DataFrame:
    """``landing_key``: resource_id=.../ingest_date=.../file."""
    file = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
    parts = [F.lit("resource_id="), safe_key("resource_id"), F.lit(f"/ingest_date={ingest_date}/"), safe_key(file)]
    return resources.withColumn("landing_key", F.concat(*parts))


def probed(url: str) -> tuple[int | None, str | None]:
    """(size, last modified) of a file by its address; (None, None) if that can't be told, whatever the reason."""
    try:
        system, path = pafs.FileSystem.from_uri(quote(url, safe=":/%?#&=~+@,;"))
        info = system.get_file_info(path)
        if info.type != pafs.FileType.File:
            return None, None
        return info.size, info.mtime.isoformat() if info.mtime else None
    except Exception:  # noqa: BLE001
        return None, None


def with_status(resources: DataFrame) -> DataFrame:
    """Size and time of those resources that the catalog tells neither of, asked of their addresses by the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [probed(u) for u in b["url"]]
            yield b.assign(size=pd.array([s for s, _ in found], dtype="Int64"), last_modified=[t for _, t in found])

    unknown = F.col("size").isNull() & F.col("last_modified").isNull() & F.col("url").isNotNull()
    asked = spread(resources.where(unknown)).mapInPandas(run, resources.schema)
    return resources.where(~unknown).unionByName(asked)


def copied(url: str, target: str, last_sha256: str | None) -> tuple[str, str, int]:
    """(status, sha256, bytes) of a copy; nothing is left at the target of one that is unchanged."""
    source, path = pafs.FileSystem.from_uri(quote(url, safe=":/%?#&=~+@,;"))
    system, to = pafs.FileSystem.from_uri(target)
    folder, _, name = to.rpartition("/")
    system.create_dir(folder, recursive=True)
    hidden, digest, n = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp", hashlib.sha256(), 0
    try:
        with source.open_input_stream(path, compression=None) as read, system.open_output_stream(hidden, compression=None) as out:
            while piece := read.read(PIECE):
                out.write(piece)
                digest.update(piece)
                n += len(piece)
        same = digest.hexdigest() == last_sha256
        if not same:
            system.move(hidden, to)
        return UNCHANGED if same else OK, digest.hexdigest(), n
    finally:
        if system.get_file_info(hidden).type != pafs.FileType.NotFound:
            system.delete_file(hidden)


def land(resources: DataFrame, manifest: DataFrame, root: str, ingest_date: str) -> DataFrame:
    """One attempt for each resource (``resource_id``, ``name``, ``url``, ``size``, ``last_modified``), given the attempts so far."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                size = None if pd.isna(r.size) else int(r.size)
                sha, n, error = None, None, None
                if r.decision == UNCHANGED:
                    status, sha, n = UNCHANGED, r.last_sha256, 0
                else:
                    try:
                        status, sha, n = copied(r.url, f"{root}/{r.landing_key}", r.last_sha256)
                    except Exception as e:  # noqa: BLE001
                        status, error = FAILED, f"{type(e).__name__}: {e}"[:ERROR_CHARS]
                rows.append((r.resource_id, r.name, r.url, status, size, r.last_modified, sha, r.landing_key, n, error))
            out = pd.DataFrame(rows, columns=ATTEMPT.names, dtype=object)
            yield out.astype({"size": "Int64", "bytes": "Int64"})

    last = latest_attempts(manifest, (OK, UNCHANGED)).select(F.col("resource_id").alias("_id"), F.col("sha256").alias("last_sha256"))
    rows = decisions(with_landing_key(resources, ingest_date), manifest).join(last, F.col("resource_id") == F.col("_id"), "left")
    rows = rows.select("resource_id", "name", "url", "size", "last_modified", "landing_key", "decision", "last_sha256")
    # what is to be read counts, not how short the rows are
    expected = rows.agg(F.sum("size")).first()[0]
    return spread(rows, expected).mapInPandas(run, ATTEMPT)
