import pytest
from pyspark.sql import functions as F

from strata.ml.folds import permuted
from strata.streaming.replay import numbered

N = 2_000_000


def fingerprint(rows, column):
    """Rows, and sums that tell one set of values from another."""
    return rows.agg(F.count(F.lit(1)), F.sum(F.col(column).cast("decimal(38,0)")), F.sum(F.xxhash64(column).cast("decimal(38,0)"))).first()


@pytest.mark.parametrize("partitions", ["8", "200"])
def test_places_are_a_permutation_of_many_wide_rows(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.range(N).select("id", F.xxhash64("id").alias("h"), F.repeat(F.col("id").cast("string"), 20).alias("wide"))
        assert fingerprint(numbered(rows, ["h", "id"]), "place") == fingerprint(spark.range(1, N + 1), "id")
        if partitions == "8":
            mixed = permuted(rows, "id", "h", 3)
            assert fingerprint(mixed, "h") == fingerprint(rows, "h") and fingerprint(mixed, "id") == fingerprint(rows, "id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_places_are_in_order(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("h"))
    got = [r["h"] for r in numbered(rows, ["h"]).orderBy("place").collect()]
    assert got == sorted(got)
