"""Queries over the driver's tables, each with its SQL where there is one."""

from strata.plans import gold, ingest, learn, silver, telemetry, trees

REGISTRIES = [gold.query, ingest.query, learn.query, silver.query, telemetry.query, trees.query]
