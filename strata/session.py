"""Session and configuration."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Values come from the environment, then from a ``.env`` file, then from here; empty ones count as unset."""

    warehouse: str = "spark-warehouse"
    landing: str = "landing"
    #: ``local`` reads and writes s3a:// paths, ``cloud`` s3:// ones.
    target: str = "local"
    environment: str = ""
    shuffle_partitions: str = ""

    @classmethod
    def load(cls, env: Mapping[str, str] = os.environ, dotenv: str | Path = ".env") -> Settings:
        path, filed = Path(dotenv), {}
        if path.is_file():
            for line in path.read_text().splitlines():
                name, eq, value = line.strip().partition("=")
                if eq and not name.startswith("#"):
                    filed[name.strip()] = value.strip().strip("'\"")
        found = {f.name: env.get(k := f"STRATA_{f.name.upper()}") or filed.get(k) for f in fields(cls)}
        return cls(**{k: v for k, v in found.items() if v})

    def uri(self, bucket: str, key: str) -> str:
        return f"{'s3a' if self.target == 'local' else 's3'}://{bucket}/{key.lstrip('/')}"

    def table(self, name: str) -> str:
        """``lake.bronze.x`` becomes ``lake.bronze_dev.x`` in the environment ``dev``."""
        parts = name.split(".")
        if self.environment and len(parts) > 1:
            parts[-2] = f"{parts[-2]}_{self.environment}"
        return ".".join(parts)


def session(settings: Settings | None = None, app: str = "strata") -> SparkSession:
    """A session in UTC with adaptive execution and dynamic partition overwrite. Master, memory and the number of shuffle
    partitions are the cluster's to set."""
    settings = settings or Settings.load()
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.warehouse.dir", settings.warehouse)
    )
    if settings.shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", settings.shuffle_partitions)
    return builder.getOrCreate()


def jdbc_options(dsn: str) -> dict[str, str]:
    """Options of ``spark.read.format("jdbc")`` for a postgresql:// address."""
    from urllib.parse import parse_qs, unquote, urlsplit

    at = urlsplit(dsn)
    mode = parse_qs(at.query).get("sslmode")
    url = f"jdbc:postgresql://{at.hostname}:{at.port or 5432}{at.path}" + (f"?sslmode={mode[0]}" if mode else "")
    return {"url": url, "user": unquote(at.username or ""), "password": unquote(at.password or ""), "driver": "org.postgresql.Driver"}
