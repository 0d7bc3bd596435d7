"""strata: lakehouse analytics written as Spark jobs."""
