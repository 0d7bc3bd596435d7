import datetime as dt
import io
import json
import os
import subprocess
import sys
import zipfile

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from strata.session import Settings, jdbc_options
from strata.sources import catalog, derby, files, jdbc, listing, manifest, workbook
from strata.sources.sinks import Tables


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("STRATA_LANDING='filed'\nSTRATA_TARGET=cloud\n# x\n")
    s = Settings.load({"STRATA_TARGET": "", "STRATA_ENVIRONMENT": "dev", "STRATA_LANDING": "set"}, env)
    assert (s.landing, s.target, s.environment, s.warehouse) == ("set", "cloud", "dev", "spark-warehouse")
    assert s.table("lake.bronze.x") == "lake.bronze_dev.x" and s.table("x") == "x" and s.uri("b", "/k") == "s3://b/k"
    assert jdbc_options("postgresql://me:p%40ss@host/db?sslmode=require") == {"url": "jdbc:postgresql://host:5432/db?sslmode=require", "user": "me", "password": "p@ss", "driver": "org.postgresql.Driver"}


def test_delimited_text_stays_text(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("﻿id, name\n01,  Ñ \n2,\n".encode())
    df = files.read_delimited(spark, str(tmp_path / "x.csv"))
    assert df.columns == ["id", "name"] and {f.dataType.simpleString() for f in df.schema} == {"string"}
    assert df.first()["id"] == "01"
    assert files.hashed_files(spark, str(tmp_path), "*.csv").first()["size"] == len("﻿id, name\n01,  Ñ \n2,\n".encode())


def test_catalog_and_selection(spark, tmp_path):
    resources = [{"id": "a", "name": "Producción Año 2023", "url": "u1", "format": "csv", "size": " 12 ", "last_modified": None, "created": "c1"}, {"id": "b", "name": "shapes", "url": "u2", "format": "SHP", "size": "x", "last_modified": "m2", "created": "c2"}, {"id": "a", "name": "PRODUCCIÓN año 2024", "url": "u3", "format": "CSV", "size": None, "last_modified": "", "created": "c3"}]
    (tmp_path / "p.json").write_text(json.dumps({"result": {"resources": resources}}))
    found = catalog.package_resources(spark, str(tmp_path / "p.json"))
    rows = {r["place"]: r for r in found.collect()}
    assert (rows[0]["size"], rows[0]["last_modified"], rows[1]["size"], rows[2]["last_modified"]) == (12, "c1", None, "c3")
    picked = catalog.selected(found, include=["AÑO"], exclude=["shapes"], formats=["csv"])
    assert [r["url"] for r in picked.collect()] == ["u1"]
    assert catalog.selected(found, only="2024").first()["url"] == "u3"
    routed = found.select(catalog.route(F.col("name"), [("año 2024$", "t1"), ("PRODUCCIÓN", "t2")]).alias("t"), "place").orderBy("place").collect()
    assert [r["t"] for r in routed] == ["t2", None, "t1"]


def test_quota_and_dealing(spark):
    items = spark.createDataFrame([("w1", "a"), ("w1", "b"), ("w1", "c"), ("w2", "d"), ("w3", "e")], "w string, f string")
    assert [r["f"] for r in catalog.picked(items, "w", "f", 4).collect()] == ["a", "d", "e", "b"]
    targets = spark.createDataFrame([(7,), (5,)], "t int")
    assert {r["w"]: r["t"] for r in catalog.dealt(items, "w", targets, "t").collect()} == {"w1": 5, "w2": 7, "w3": 5}
    with pytest.raises(ValueError):
        catalog.dealt(items, "w", targets.limit(0), "t")


def test_manifest_resolves_starts_and_ends(spark):
    rows = spark.createDataFrame([(1, "r", "failed", None, None, "boom" * 900), (1, "r", "ok", "2024-01-01 00:00:00", "h", None), (2, "r", "failed", None, None, "e")], "id long, resource_id string, status string, finished_at string, sha256 string, error string").withColumn("finished_at", F.col("finished_at").cast("timestamp"))
    found = {r["id"]: r["status"] for r in manifest.resolved(rows).collect()}
    assert found == {1: "ok", 2: "failed"}
    last = manifest.latest_attempts(manifest.resolved(rows)).first()
    assert last["sha256"] == "h"
    out = manifest.after_download(spark.createDataFrame([("h", "h"), ("n", "h"), ("n", None)], "sha256 string, last_sha256 string"))
    assert [r["status"] for r in out.collect()] == ["unchanged", "ok", "ok"]


def test_partitions_are_replaced_and_schemas_grow(spark):
    tables = Tables(spark)
    tables.replace("raw_x", spark.createDataFrame([("1", "a"), ("2", "b")], "v string, _resource_id string"), ("_resource_id",))
    tables.replace("raw_x", spark.createDataFrame([("3", "new", "b")], "v string, more string, _resource_id string"), ("_resource_id",))
    assert sorted((r["v"], r["_resource_id"], r["more"]) for r in spark.table("raw_x").collect()) == [("1", "a", None), ("3", "b", "new")]
    assert files.latest_partition(spark, "raw_x", "_resource_id") == "b"


def test_sparse_events(spark):
    rows = spark.createDataFrame([(1, float("nan"), None), (2, 1.5, "x")], "id int, p double, s string")
    body = rows.select(files.sparse_json([F.col("id"), files.without_nan("p"), F.col("s")]).alias("b")).collect()
    assert [r["b"] for r in body] == ['{"id":1}', '{"id":2,"p":1.5,"s":"x"}']


def book(cells, merges, name="Vida útil"):
    def ref(r, c):
        return f"{chr(65 + c)}{r + 1}"

    rows = {}
    for (r, c), v in sorted(cells.items()):
        body = f'<c r="{ref(r, c)}"><v>{v}</v></c>' if isinstance(v, float) else f'<c r="{ref(r, c)}" t="inlineStr"><is><t>{v}</t></is></c>'
        rows.setdefault(r, []).append(body)
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f"<worksheet {main}><sheetData>" + "".join(f'<row r="{r + 1}">{"".join(x)}</row>' for r, x in rows.items()) + "</sheetData><mergeCells>" + "".join(f'<mergeCell ref="{ref(*a)}:{ref(*b)}"/>' for a, b in merges) + "</mergeCells></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{name}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


def test_crosstab_workbooks(spark, tmp_path):
    cells = {(0, 2): "Petróleo", (0, 4): "Gas", (1, 2): "Probada", (1, 3): "Posible", (1, 4): "Probada", (1, 5): "Other", (2, 0): "Operador", (2, 1): "Cuenca"}
    for r, who in ((3, "Acme"), (4, "TOTAL"), (6, "Beta")):
        cells |= {(r, 0): who, (r, 1): "N"} | {(r, c): float(r * 10 + c) for c in range(2, 6)}
    data = book(cells, [((0, 2), (0, 3)), ((0, 4), (0, 5))])
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("book.xlsx", data)
    (tmp_path / "reserves_2020_2021.zip").write_bytes(archive.getvalue())
    layout = workbook.Layout("OPERADOR", ("Operador", "Cuenca"), (("fluid", ("Petróleo", "Gas")), ("certainty", ("Probada", "Posible"))), (("VIDA", "end_of_life"), ("CONCESION", "end_of_concession")))
    rows = workbook.read_crosstabs(spark, str(tmp_path), layout).collect()
    assert {(r["Operador"], r["fluid"], r["certainty"], r["value"]) for r in rows} == {("Acme", "PETROLEO", "PROBADA", 32.0), ("Acme", "PETROLEO", "POSIBLE", 33.0), ("Acme", "GAS", "PROBADA", 34.0), ("Beta", "PETROLEO", "PROBADA", 62.0), ("Beta", "PETROLEO", "POSIBLE", 63.0), ("Beta", "GAS", "PROBADA", 64.0)}
    assert {(r["year"], r["sheet_kind"]) for r in rows} == {(2021, "end_of_life")}
    with pytest.raises(ValueError):
        empty = io.BytesIO()
        zipfile.ZipFile(empty, "w").close()
        workbook.unwrapped(empty.getvalue())


def test_latest_attempts_from_a_database_in_several_tasks(spark):
    url = "jdbc:derby:memory:attempts"
    options = {"url": f"{url};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    at = [None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]
    rows = [(i, f"r{i % 7}", ["ok", "ok", "failed"][i % 3], at[i * 5 % 3], ["a", "b"][i // 40]) for i in range(80)]
    df = spark.createDataFrame(rows, "ID long, RESOURCE_ID string, STATUS string, FINISHED_AT timestamp, DATASET string")
    df.write.format("jdbc").options(**options, dbtable="attempts", createTableColumnTypes="RESOURCE_ID varchar(9), STATUS varchar(9), DATASET varchar(9)").save()
    for dataset in (None, "b"):
        got = jdbc.latest_attempts(spark, options, "attempts", dataset, fields=("id", "resource_id"), tasks=5)
        assert got.rdd.getNumPartitions() == 5
        of = [r for r in rows if r[2] == "ok" and dataset in (None, r[4])]
        want = {k: max((r for r in of if r[1] == k), key=lambda r: (r[3] is not None, r[3] or at[1], r[0]))[0] for k in {r[1] for r in of}}
        assert {r["RESOURCE_ID"]: r["ID"] for r in got.collect()} == want
    with pytest.raises(ValueError):
        jdbc.latest_query("attempts", "x'; drop table attempts")


def test_packed_databases_keep_odd_values_and_whole_keys(spark):
    at = dt.datetime(2024, 1, 31, 23, 59, 59, 123456)
    data = [(1, None, at), (2, "", None), (3, 'a "b", c\nd', at), (4, " x ", at), (None, "Ñ", at), (6, "", at)]
    rows = spark.createDataFrame(data, "id long, name string, done timestamp_ntz")
    urls = derby.packed(rows, "name", "odd", "id bigint, name varchar(40), done timestamp", "name", 3)
    parts = [spark.read.format("jdbc").options(url=u, driver=derby.DRIVER, dbtable="odd", preferTimestampNTZ="true").load().collect() for u in urls]
    assert sorted([tuple(r) for p in parts for r in p], key=str) == sorted(data, key=str)
    assert sum(any(r["NAME"] == "" for r in p) for p in parts) == 1
    assert derby.packed(rows.where("id > 9"), "name", "odd", "id bigint, name varchar(40), done timestamp", "name", 3) == []
    with pytest.raises(PythonException, match="Derby failed"):
        derby.packed(rows, "name", "odd", "id bigint, name varchar(2), done timestamp", "name", 1)


def test_latest_attempts_where_executors_are_other_processes(tmp_path):
    """The database was one process's own: executors didn't find its table."""
    code = f"""
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "512m").config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
found = __spark_entry__.queries()["jdbc_latest"](spark, "/root/testdata/sf0.001").collect()
print("rows", sorted((int(r["resource_id"]), r["id"]) for r in found))
"""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": repo, "TMPDIR": "/proc/self/cwd/.."}, capture_output=True, text=True, timeout=300)
    import duckdb

    want = duckdb.sql("select user_id, event_id from '/root/testdata/sf0.001/events.parquet' where event_type = 'purchase' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1 order by 1").fetchall()
    assert f"rows {want}" in done.stdout and len(want) > 5, done.stderr[-2000:]


def test_listing_hashes_quotas_and_decisions(spark, tmp_path):
    import hashlib

    for name, text in (("c=1/WELL-1_a", b"abc"), ("c=1/WELL-1_b", b""), ("c=1/WELL-2_a", b"x" * 70_000), ("c=1/SIM_a", b"no"), ("c=2/WELL-9_a", b"y"), ("c=3/WELL-9_a", b"z")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    found = listing.listed(spark, str(tmp_path))
    files = found.select("size", "sha", F.regexp_extract("path", "c=([0-9])", 1).cast("int").alias("class"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    files = files.withColumn("owner", F.regexp_extract("name", "^([^_]*)", 1)).withColumn("resource_id", F.concat_ws("/", "class", "name"))
    rows = {r["resource_id"]: r for r in files.collect()}
    assert rows["1/WELL-1_a"]["sha"] == hashlib.sha1(b"blob 3\0abc").hexdigest() and rows["1/WELL-1_b"]["sha"] == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    taken = listing.chosen(files, "class", "owner", "name", {1: 2, 2: 5}, "WELL-")
    assert {r["resource_id"] for r in taken.collect()} == {"1/WELL-1_a", "1/WELL-2_a", "2/WELL-9_a"}
    log = [(1, k, "ok", rows[k]["sha"] if k != "2/WELL-9_a" else "old", k, rows[k]["size"], dt.datetime(2024, 1, 1)) for k in rows]
    log = spark.createDataFrame(log, "id long, resource_id string, status string, last_modified string, landing_key string, bytes long, finished_at timestamp")
    landed = files.select(F.col("resource_id").alias("landing_key"), F.when(F.col("name") == "WELL-2_a", 1).otherwise(F.col("size")).alias("size"))
    out = {r["resource_id"]: r["decision"] for r in listing.fetch_decisions(files, log, landed).collect()}
    assert out.pop("2/WELL-9_a") == out.pop("1/WELL-2_a") == "download" and set(out.values()) == {"unchanged"}
