import json

import pytest

from strata.__main__ import main


def test_raw_to_silver(spark, tmp_path, capsys):
    head = "l_orderkey,l_linenumber,l_quantity,l_discount,l_returnflag,l_linestatus,l_shipdate\n"
    good = "".join(f"{i},1,{i % 50 + 1},0.05,A,O,2020-01-01\n" for i in range(300))
    (tmp_path / "a.csv").write_text(head + good + "1,1,2,0.05,A,O,2021-01-01\n900,9,1,0,A,O,\n")
    assert main(["raw", str(tmp_path / "a.csv"), "raw_lines", "--resource-id", "a", "--dry-run"]) == 0
    assert main(["raw", str(tmp_path / "a.csv"), "raw_lines", "--resource-id", "a"]) == 0
    assert main(["silver", "contracts/lines.yaml"]) == 0
    assert spark.table("silver_lines").count() == 300
    assert spark.table("silver_lines_rejects").first()["reject_reason"] == "l_linenumber > 7"
    # loaded already: nothing to do
    assert main(["silver", "contracts/lines.yaml"]) == 0
    (tmp_path / "b.csv").write_text(head + "1,1,900,0.05,A,F,\n")
    assert main(["raw", str(tmp_path / "b.csv"), "raw_lines", "--resource-id", "b"]) == 0
    assert main(["silver", "contracts/lines.yaml"]) == 1
    assert main(["silver", "contracts/none.yaml"]) == 2
    capsys.readouterr()
    assert main(["queries"]) == 0 and "dim_history" in capsys.readouterr().out
    assert main(["run", "nothing", "/x"]) == 2
    assert main(["run", "dim_calendar", "/x", "--out", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 84


def test_ingest(spark, tmp_path, capsys):
    import json

    (tmp_path / "a.csv").write_bytes(b"x" * 10)
    (tmp_path / "Ñandú b.csv").write_bytes(b"y" * 20)
    root = f"file://{tmp_path}/land"

    def catalog(*rows):
        (tmp_path / "p.json").write_text(json.dumps({"result": {"resources": [dict(zip(("id", "name", "url", "format", "size", "last_modified"), r)) for r in rows]}}))

    def run():
        return main(["ingest", str(tmp_path / "p.json"), root, "--format", "csv"])

    def statuses():
        return {r["resource_id"]: r["status"] for r in spark.table("ops_manifest").orderBy("id").collect()}

    catalog(("a", "A", f"file://{tmp_path}/a.csv", "CSV", "10", "m1"), ("b", "B", f"file://{tmp_path}/Ñandú b.csv", "csv", None, None), ("c", "C", f"file://{tmp_path}/none.csv", "csv", "1", "m"), ("d", "D", f"file://{tmp_path}/a.csv", "shp", "1", "m"))
    assert run() == 1
    assert statuses() == {"a": "ok", "b": "ok", "c": "failed"}
    files = {str(p.relative_to(tmp_path / "land")).split("/")[0]: p for p in (tmp_path / "land").rglob("*.csv")}
    assert files["resource_id=a"].read_bytes() == b"x" * 10 and files["resource_id=b"].name == "nandu-b.csv"
    # a is known to be the same, b turns out to be, c still fails
    assert run() == 1
    assert statuses() == {"a": "unchanged", "b": "unchanged", "c": "failed"}
    (tmp_path / "none.csv").write_bytes(b"")
    (tmp_path / "a.csv").write_bytes(b"z" * 10)
    catalog(("a", "A", f"file://{tmp_path}/a.csv", "CSV", "10", "m2"), ("c", "C", f"file://{tmp_path}/none.csv", "csv", "1", "m"))
    assert main(["ingest", str(tmp_path / "p.json"), root, "--dry-run"]) == 0
    assert run() == 0
    assert statuses()["a"] == "ok" and statuses()["c"] == "ok"
    assert spark.table("ops_manifest").where("resource_id = 'c' and status = 'ok'").first()["bytes"] == 0


def test_probe(tmp_path):
    from strata.sources import landing

    (tmp_path / "x.csv").write_bytes(b"abc")
    size, at = landing.probed(f"file://{tmp_path}/x.csv")
    assert size == 3 and at
    assert landing.probed(f"file://{tmp_path}/none.csv") == (None, None) and landing.probed("nothing:/x") == (None, None)


def test_inspection_and_workbooks(spark, tmp_path, capsys):
    import datetime
    import json

    from strata.sources import manifest
    from tests.test_sources import book

    cells = {(0, 1): "Gas", (1, 1): "Probada", (2, 0): "Operador", (3, 0): "Acme", (3, 1): 5.0}
    root, key = tmp_path / "land", "resource_id=r1/ingest_date=2024-01-01/reserves-2023.xlsx"
    path = root / key
    path.parent.mkdir(parents=True)
    path.write_bytes(book(cells, []))
    (tmp_path / "layout.json").write_text(json.dumps({"key": "OPERADOR", "identity": ["Operador"], "levels": [["fluid", ["Gas"]], ["certainty", ["Probada"]]], "sheets": [["VIDA", "end_of_life"]]}))
    spark.sql("drop table if exists ops_manifest")
    assert main(["workbooks", str(tmp_path / "layout.json"), f"file://{root}", "raw_reserves"]) == 1

    def attempt(n, sha, at):
        row = dict.fromkeys(manifest.SCHEMA.names) | {"id": n, "dataset": "reserves", "resource_id": "r1", "resource_name": "R", "status": "ok", "sha256": sha, "landing_key": key}
        row |= {"ingest_date": datetime.date(2024, 1, 1), "finished_at": datetime.datetime(2024, 1, at)}
        spark.createDataFrame([tuple(row.values())], manifest.SCHEMA).write.mode("append").format("parquet").saveAsTable("ops_manifest")

    attempt(1, "s1", 1)
    load = ["workbooks", str(tmp_path / "layout.json"), f"file://{root}", "raw_reserves", "--dataset", "reserves"]
    assert main([*load, "--dry-run"]) == 0 and main(load) == 0
    row = spark.table("raw_reserves").first()
    assert (row["Operador"], row["value"], row["year"], row["_source_sha256"], row["_resource_id"]) == ("Acme", 5.0, 2023, "s1", "r1")
    assert main(load) == 0 and spark.table("raw_reserves").first()["_loaded_at"] == row["_loaded_at"]  # nothing is pending
    attempt(2, "s2", 2)
    path.write_bytes(book(cells | {(3, 1): 7.0}, []))
    assert main(load) == 0
    assert [(r["value"], r["_source_sha256"]) for r in spark.table("raw_reserves").collect()] == [(7.0, "s2")]
    capsys.readouterr()
    assert main(["inspect", "--table", "raw_reserves"]) == 0
    shown = capsys.readouterr().out
    assert "n_files" in shown and "r1" in shown and "written_at" in shown
    assert main(["inspect", "--table", "nothing"]) == 1
    assert main(["manifest", "-n", "1"]) == 0 and "ok" in capsys.readouterr().out
    spark.sql("drop table ops_manifest")


def test_training_commands(spark, tmp_path, capsys):
    spark.range(200).selectExpr("id", "id % 8 as site", "cast(id % 20 as double) as x", "pow((id % 20) - 10, 2) as y").write.mode("overwrite").saveAsTable("sites")
    at = ["--target", "y", "--models", str(tmp_path / "m"), "--name", "y"]
    assert main(["predict", "sites", "predicted", "--key", "id", *at]) == 1
    assert main(["train-rows", "sites", "--number", "x", "--group", "site", "--folds", "2", *at]) == 0
    assert "promoted" in capsys.readouterr().out
    assert main(["predict", "sites", "predicted", "--key", "id", "--where", "id < 100", "--complete", "id < 50", *at]) == 0
    out = spark.table("predicted")
    assert out.count() == 100 and out.where("actual is not null").count() == 50


def test_replay_and_consume(spark, tmp_path, capsys):
    rows = spark.range(240).selectExpr("concat('w', id % 2) as well", "timestamp_micros(1700000000000000 + (id div 2) * 5000000 + 250000) as ts", "cast(id as double) as `P-PDG`", "cast(id % 3 as int) as code")
    rows.write.mode("overwrite").saveAsTable("readings_to_replay")
    events, out = str(tmp_path / "events"), str(tmp_path / "out")
    assert main(["replay", "nothing", events, "--series", "well", "--ts", "ts"]) == 1
    assert main(["replay", "readings_to_replay", events, "--series", "well", "--ts", "ts", "--files", "6"]) == 0
    assert main(["consume", events, out, "--sensor", "P-PDG", "--files-per-batch", "2", "--seconds", "60"]) == 0
    totals = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert totals["raw"]["rows_read"] == 240 and spark.read.parquet(f"{out}/raw").count() == 240
    sums = spark.read.parquet(f"{out}/tumbling")
    assert {"window_start", "series", "n", "avg_p_pdg", "max_code"} <= set(sums.columns) and sums.count() >= 8


def test_a_silver_load_without_its_source_says_so(spark, tmp_path, capsys):
    spark.sql("drop table if exists raw_lines_gone")
    text = open("contracts/lines.yaml").read()
    source = next(x.split(":", 1)[1].strip() for x in text.splitlines() if x.startswith("source:"))
    (tmp_path / "c.yaml").write_text(text.replace(source, "raw_lines_gone"))
    assert main(["silver", str(tmp_path / "c.yaml")]) == 2 and "raw_lines_gone" in capsys.readouterr().err


def test_a_failed_replacement_leaves_the_table(spark):
    from strata.sources.sinks import Tables

    tables = Tables(spark)
    spark.sql("drop table if exists kept_whole")
    tables.replace("kept_whole", spark.range(5))
    bad = spark.range(3).selectExpr("id", "raise_error('broken') as x")
    with pytest.raises(Exception, match="broken"):
        tables.replace("kept_whole", bad)
    assert spark.table("kept_whole").count() == 5
    tables.replace("kept_whole", spark.table("kept_whole").where("id < 2"))
    assert spark.table("kept_whole").count() == 2
