import datetime
import re

import pytest

from strata.operators.contracts import Contract, Field, Measures, accepted, deduplicated, flagged, load_pending, rejected, run_log
from strata.sources.sinks import Tables

WELLS = Contract(
    table="wells", primary_key=("id",), partition_by=("year",), dedupe_by=("seen",),
    fields=(Field("id", "bigint", False), Field("year", "int", False, 2000, 2030), Field("rate", "double", min=0, max=10), Field("kind", allowed=("a", "it's")), Field("open", "boolean"), Field("day", "date"), Field("seen", "timestamp")),
)
COLUMNS = "id string, year string, rate string, kind string, open string, day string, seen string, _resource_id string, _source_sha256 string, data_origin string"


def raw(spark, *rows, resource="r1", sha="s1"):
    return spark.createDataFrame([(*r, resource, sha, "real") for r in rows], COLUMNS)


def test_typing_of_dirty_text(spark):
    rows = raw(spark, (" 1 ", "2001", "", " ", "T", "2020-01-02", None), ("2", "2001", "1e0", "it's", "f", "bad", "2020-01-01 00:00:00"), ("3", "2001", "x", "a", "yes", None, None))
    typed = {r["id"]: r for r in accepted(flagged(rows, WELLS), WELLS).collect()}
    assert typed[1]["rate"] is None and typed[1]["kind"] is None and typed[1]["open"] is True and typed[1]["day"] == datetime.date(2020, 1, 2)
    assert typed[2]["rate"] == 1.0 and typed[2]["open"] is False and typed[2]["day"] is None
    assert typed[3]["rate"] is None and typed[3]["open"] is None


def test_reasons_in_order_and_originals_kept(spark):
    rows = raw(spark, ("1", "1999", " 11 ", "b", "t", "", ""), ("2", "2031", "-1", "a", "t", "", ""), ("3", None, "NaN", "a", "t", "", ""), ("4", "2001", "5", "a", "t", "", ""))
    bad = {r["id"]: r for r in rejected(flagged(rows, WELLS), WELLS).collect()}
    assert bad["1"]["reject_reason"] == "year < 2000; rate > 10; kind not in list" and bad["1"]["rate"] == " 11 "
    assert bad["2"]["reject_reason"] == "year > 2030; rate < 0"
    assert bad["3"]["reject_reason"] == "rate > 10"
    assert set(bad) == {"1", "2", "3"}


def test_dedupe_keeps_the_latest_and_null_loses(spark):
    rows = raw(spark, ("1", "2001", "1", "a", "t", "", ""), ("1", "2001", "2", "a", "t", "", "2020-01-01 00:00:00"), ("1", "2001", "3", "a", "t", "", "2021-01-01 00:00:00"))
    assert [r["rate"] for r in deduplicated(accepted(flagged(rows, WELLS), WELLS), WELLS).collect()] == [3.0]


def test_run_log_counts_keys_without_a_table_of_them(spark):
    two = (raw(spark, ("1", "2001", "1", "a", "t", "", ""), ("1", "2002", "2", "a", "t", "", ""), ("x", "2001", "3", "a", "t", "", ""), ("x", "2001", "3", "a", "t", "", "")),
           raw(spark, ("1", "2001", "1", "a", "t", "", ""), ("2", None, "2", "a", "t", "", ""), resource="r2"), raw(spark, ("1", "2001", "11", "a", "t", "", ""), resource="r3"))
    flags = flagged(two[0].union(two[1]).union(two[2]), WELLS)
    # the rows as they are, not deduplicated: of four in r1 one key is known, which repeats, and two are null
    log = run_log(flags, accepted(flags, WELLS), WELLS)
    found = {r["resource_id"]: (r["rows_in"], r["rows_out"], r["rows_rejected"], r["hard_failures"]) for r in log.collect()}
    assert found == {
        "r1": (4, 0, 0, "2 nulls in id; 3 rows repeat the key id"), "r2": (2, 0, 0, "1 nulls in year"), "r3": (1, 0, 1, "1 of 1 rows rejected"),
    }
    assert not re.search(r"Aggregate\(keys=\[[^\]]*\bid#", log._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("spec, match", [
    (dict(fields=(Field("a", nullable=False), Field("a"))), "twice"), (dict(fields=(Field("a", "money", nullable=False),)), "unknown types"), (dict(fields=(Field("b"),)), "primary_key"),
    (dict(fields=(Field("a"),)), "nullable key"), (dict(fields=(Field("a", nullable=False),), dedupe_by=("z",)), "dedupe_by"), (dict(fields=(Field("a", nullable=False),), primary_key=()), "no primary key"),
])
def test_bad_contracts(spec, match):
    with pytest.raises(ValueError, match=match):
        Contract(**{"table": "t", "primary_key": ("a",)} | spec)


def test_from_yaml(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("table: t\nsource: raw.t\nprimary_key: [a]\ncolumns:\n  - {name: a, type: bigint, nullable: false}\n  - {name: b, min: 0, allowed_values: [x, y]}\n")
    c = Contract.from_yaml(path)
    assert c.names == ("a", "b") and c.fields[1].allowed == ("x", "y") and c.rejects_table == "t_rejects" and c.missing(["a"]) == ["b"]


@pytest.mark.parametrize("m, n", [(Measures(100, 1, 99, 99, {"id": 0}), 0), (Measures(100, 2, 98, 98, {"id": 0}), 1), (Measures(0, 0, 0, 0, {}), 0), (Measures(10, 0, 10, 9, {"id": 1}), 2)])
def test_hard_failures(m, n):
    assert len(m.failures(WELLS)) == n


def test_loads_by_resource(spark):
    tables, now = Tables(spark), datetime.datetime(2024, 1, 1)
    good = [(str(i), "2001", "1", "a", "t", "", "") for i in range(200)]
    first = raw(spark, *good).union(raw(spark, ("900", "2002", "1", "a", "t", "", ""), ("901", "1900", "1", "a", "t", "", ""), resource="r2"))
    runs = {r["resource_id"]: r for r in load_pending(first, None, WELLS, now, tables).collect()}
    assert runs["r1"]["status"] == "ok" and runs["r1"]["rows_out"] == 200
    assert runs["r2"]["status"] == "failed" and "rejected" in runs["r2"]["hard_failures"]
    assert spark.table("wells").count() == 200 and spark.table("wells_rejects").count() == 1
    # the same hash is not loaded again, a new one replaces its partitions
    assert {r["resource_id"] for r in load_pending(first, spark.table("wells"), WELLS, now, tables).collect()} == {"r2"}
    again = raw(spark, *good[:150], sha="s2")
    assert [r["rows_out"] for r in load_pending(again, spark.table("wells"), WELLS, now, tables).collect()] == [150]
    assert spark.table("wells").count() == 150 and spark.table("dq_runs").where("contract = 'wells'").count() == 4
    missing = load_pending(first.drop("rate"), None, WELLS, now, tables).collect()
    assert {r["status"] for r in missing} == {"failed"} and "missing columns: rate" in missing[0]["hard_failures"]
