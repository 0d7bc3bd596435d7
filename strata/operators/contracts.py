"""Declarative contracts: typed columns out of text, violations to quarantine, hard checks, a log of runs.

A contract becomes Spark expressions: a tolerant cast for each column, and a list of (condition, reason). Every row is
flagged once; rows without a reason go on, the others to quarantine with their texts as they came.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import blank_to_null, flag
from strata.operators.dedupe import latest
from strata.sources.scratch import stored

TYPES = ("string", "int", "bigint", "double", "boolean", "date", "timestamp")
MAX_REJECTED = 0.01
LINEAGE = ("_resource_id", "_source_sha256", "data_origin")


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    nullable: bool = True
    min: float | None = None
    max: float | None = None
    allowed: tuple[str, ...] = ()

    def typed(self) -> Column:
        text = F.col(f"`{self.name}`")
        if self.type == "boolean":
            return flag(text)
        return blank_to_null(text) if self.type == "string" else blank_to_null(text).try_cast(self.type)


@dataclass(frozen=True)
class Contract:
    table: str
    primary_key: tuple[str, ...]
    fields: tuple[Field, ...]
    partition_by: tuple[str, ...] = ()
    dedupe_by: tuple[str, ...] = ()
    source: str = ""
    names: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        names = [f.name for f in self.fields]
        object.__setattr__(self, "names", tuple(names))
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"{self.table}: columns given twice: {', '.join(twice)}")
        if odd := [f"{f.name} {f.type}" for f in self.fields if f.type not in TYPES]:
            raise ValueError(f"{self.table}: unknown types: {', '.join(odd)}")
        for role in ("primary_key", "partition_by", "dedupe_by"):
            if gone := [c for c in getattr(self, role) if c not in names]:
                raise ValueError(f"{self.table}: {role} names no column: {', '.join(gone)}")
        if not self.primary_key:
            raise ValueError(f"{self.table}: no primary key")
        if loose := [f.name for f in self.fields if f.name in self.primary_key and f.nullable]:
            raise ValueError(f"{self.table}: nullable key columns: {', '.join(loose)}")

    @classmethod
    def from_dict(cls, spec: dict) -> Contract:
        fields = tuple(Field(c["name"], c.get("type", "string"), c.get("nullable", True), c.get("min"), c.get("max"), tuple(c.get("allowed_values", ()))) for c in spec["columns"])
        lists = {k: tuple(spec.get(k) or ()) for k in ("primary_key", "partition_by", "dedupe_by")}
        return cls(table=spec["table"], source=spec.get("source", ""), fields=fields, **lists)

    @classmethod
    def from_yaml(cls, path: str | Path) -> Contract:
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text()))

    @property
    def rejects_table(self) -> str:
        return f"{self.table}_rejects"

    def missing(self, columns: list[str]) -> list[str]:
        return [n for n in self.names if n not in columns]

    def rules(self) -> list[tuple[Column, str]]:
        """(violated, reason) in the order of columns; of one column null, too small, too large, not allowed."""
        out = []
        for f in self.fields:
            c = f.typed()
            if f.min is not None:
                out.append((c < F.lit(f.min), f"{f.name} < {f.min}"))
            if f.max is not None:
                out.append((c > F.lit(f.max), f"{f.name} > {f.max}"))
            if f.allowed:
                out.append((~c.isin(list(f.allowed)), f"{f.name} not in list"))
        return out

    def reason(self) -> Column:
        """All reasons, joined; empty if there are none. A comparison with null violates nothing."""
        return F.concat_ws("; ", *[F.when(bad, F.lit(why)) for bad, why in self.rules()])


@dataclass(frozen=True)
class Measures:
    rows_in: int
    rows_rejected: int
    rows: int
    keys: int
    nulls: dict[str, int]

    def failures(self, contract: Contract, most: float = MAX_REJECTED) -> list[str]:
        """Hard failures: nulls where there must be none, a key that repeats, too many rejects."""
        out = [f"{n} nulls in {c}" for c, n in self.nulls.items() if n]
        if self.rows != self.keys:
            out.append(f"{self.rows - self.keys} rows repeat the key {', '.join(contract.primary_key)}")
        if self.rows_in and self.rows_rejected / self.rows_in > most:
            out.append(f"{self.rows_rejected} of {self.rows_in} rows rejected")
        return out


def flagged(raw: DataFrame, contract: Contract) -> DataFrame:
    return raw.withColumn("reject_reason", contract.reason())


def accepted(flags: DataFrame, contract: Contract) -> DataFrame:
    """Typed columns and the lineage that is there, of the rows without a reason."""
    lineage = [c for c in LINEAGE if c in flags.columns]
    return flags.where("reject_reason = ''").select(*[f.typed().alias(f.name) for f in contract.fields], *lineage)


def rejected(flags: DataFrame, contract: Contract) -> DataFrame:
    """The rows with a reason, as they came."""
    lineage = [c for c in LINEAGE if c in flags.columns]
    return flags.where("reject_reason <> ''").select("reject_reason", *contract.names, *lineage)


def deduplicated(typed: DataFrame, contract: Contract) -> DataFrame:
    return latest(typed, contract.primary_key, contract.dedupe_by)


def null_columns(contract: Contract) -> list[Column]:
    """The nulls of each column that must have none."""
    return [F.count(F.when(F.col(f.name).isNull(), 1)).alias(f"null_{f.name}") for f in contract.fields if not f.nullable]


def measure_columns(contract: Contract) -> list[Column]:
    """One pass: rows, distinct keys (without those that have a null), and the nulls of each column that must have none."""
    return [F.count(F.lit(1)).alias("rows"), F.count_distinct(*[F.col(c) for c in contract.primary_key]).alias("keys"), *null_columns(contract)]


def measures(flags: DataFrame, silver: DataFrame, contract: Contract) -> Measures:
    n_in, n_bad = flags.agg(F.count(F.lit(1)), F.count(F.when(F.col("reject_reason") != "", 1))).first()
    m = silver.agg(*measure_columns(contract)).first().asDict()
    return Measures(n_in, n_bad, m.pop("rows"), m.pop("keys"), {k.removeprefix("null_"): v for k, v in m.items()})


RUNS = T.StructType([
    T.StructField("run_at", T.TimestampType()), T.StructField("contract", T.StringType()), T.StructField("resource_id", T.StringType()),
    T.StructField("rows_in", T.LongType()), T.StructField("rows_out", T.LongType()), T.StructField("rows_rejected", T.LongType()),
    T.StructField("hard_failures", T.StringType()), T.StructField("status", T.StringType()),
])


def run_log(flags: DataFrame, silver: DataFrame, contract: Contract, most: float = MAX_REJECTED) -> DataFrame:
    """A row for each resource of ``flags``, as a load of it logs: ``rows_in``, ``rows_out``, ``rows_rejected``, ``hard_failures`` and
    ``status``. ``silver`` is what is left after deduplication. Two sums, whatever the number of resources; a task sorts its rows and
    holds no table of keys."""
    came = flags.groupBy(F.col("_resource_id").alias("resource_id")).agg(
        F.count(F.lit(1)).alias("rows_in"), F.count(F.when(F.col("reject_reason") != "", 1)).alias("rows_rejected"))
    # a key's first row stands for it, whichever that is: in the order of the deduplication, as rows that come from it need no other sort;
    # distinct keys would be held in each task besides, twice
    of_key = Window.partitionBy("_resource_id", *contract.primary_key)
    of_key = of_key.orderBy(*[F.col(c).desc_nulls_last() for c in contract.dedupe_by or contract.primary_key[:1]])
    numbered = silver.withColumn("_of_key", F.row_number().over(of_key))
    known = F.lit(True)
    for c in contract.primary_key:
        known = known & F.col(c).isNotNull()
    keys = F.count(F.when((F.col("_of_key") == 1) & known, 1)).alias("keys")
    left = numbered.groupBy(F.col("_resource_id").alias("_id")).agg(F.count(F.lit(1)).alias("rows"), keys, *null_columns(contract))
    out = came.join(left, F.col("resource_id").eqNullSafe(F.col("_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    found = [(zero(f"null_{f.name}") > 0, F.concat(zero(f"null_{f.name}").cast("string"), F.lit(f" nulls in {f.name}"))) for f in contract.fields if not f.nullable]
    found.append((zero("rows") != zero("keys"), F.concat((zero("rows") - zero("keys")).cast("string"), F.lit(f" rows repeat the key {', '.join(contract.primary_key)}"))))
    found.append((F.col("rows_rejected") / F.col("rows_in") > most, F.format_string("%d of %d rows rejected", "rows_rejected", "rows_in")))
    out = out.withColumn("hard_failures", F.concat_ws("; ", *[F.when(bad, why) for bad, why in found]))
    failed = F.col("hard_failures") != ""
    return out.select(
        F.lit(contract.table).alias("contract"), "resource_id", "rows_in", F.when(failed, 0).otherwise(zero("rows")).cast("long").alias("rows_out"),
        "rows_rejected", "hard_failures", F.when(failed, "failed").otherwise("ok").alias("status"))


def pending_resources(raw: DataFrame, loaded: DataFrame | None) -> DataFrame:
    """``resource_id``, ``sha256`` of the resources in ``raw`` that are new or have another hash than is loaded."""
    from strata.sources.manifest import pending

    hashes = lambda df: df.groupBy(F.col("_resource_id").alias("resource_id")).agg(F.max("_source_sha256").alias("sha256"))
    return hashes(raw) if loaded is None else pending(hashes(raw), hashes(loaded))


def load_pending(raw: DataFrame, loaded: DataFrame | None, contract: Contract, run_at, sink, runs_table: str = "dq_runs") -> DataFrame:
    """Loads all resources whose hash is new or changed, in one pass, and appends the runs.

    Every line is cast and flagged once and stored. Rejects are written before the hard checks; the resources that fail them are
    left out of the write to the typed table, and keep no other out. ``sink`` has ``replace(table, df, partition_by)`` and ``append``.
    """
    spark = raw.sparkSession
    if gone := contract.missing(raw.columns):
        row = (run_at, contract.table, "*", 0, 0, 0, f"missing columns: {', '.join(gone)}", "failed")
        runs = spark.createDataFrame([row], RUNS)
        sink.append(runs_table, runs)
        return runs
    ids = pending_resources(raw, loaded).select("resource_id")
    rows = raw.join(ids, F.col("_resource_id").eqNullSafe(F.col("resource_id")), "left_semi")
    flags = stored(flagged(rows, contract), "flagged")
    typed = accepted(flags, contract)
    keys = ("_resource_id", *contract.primary_key)
    silver = stored(latest(typed, keys, contract.dedupe_by), "typed")
    runs = stored(run_log(flags, silver, contract).select(F.lit(run_at).cast("timestamp").alias("run_at"), "*"), "runs")
    bad = rejected(flags, contract)
    if not bad.isEmpty():
        sink.replace(contract.rejects_table, bad.withColumn("_rejected_at", F.lit(run_at)), ("_resource_id",))
    good = runs.where("status = 'ok'").select("resource_id")
    if not good.isEmpty():
        # resources that have a key in common meet here: of these rows the latest stays
        kept = silver.join(good, F.col("_resource_id").eqNullSafe(F.col("resource_id")), "left_semi")
        sink.replace(contract.table, deduplicated(kept, contract).withColumn("_silver_loaded_at", F.lit(run_at)), contract.partition_by)
    sink.append(runs_table, runs.select(*RUNS.names))
    return runs
