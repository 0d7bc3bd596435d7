import gzip
import hashlib

from strata.llm import warc
from strata.llm.common import scratch_path

LONG = "<html>" + "é" * 60 + "</html>"


def pages(spark):
    rows = [(5, "http://a", LONG), (3, "http://b\nx", LONG), (9, None, LONG), (1, "http://c", "short"), (2, "http://d", "short"), (4, "http://e", None), (6, "http://f", ""), (7, "http://g", "y" * 99), (8, "http://h", "y" * 99), (10, "u", "z" * 300_000), (11, "u", "a\r\n\r\nWARC/1.1\r\n"), (5, "http://a", LONG), (None, "n", LONG)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_round_trip_and_revisits(spark):
    manifest = warc.write_archives(pages(spark), scratch_path(spark, "warc"), warc.Layout(file_bytes=600))
    assert manifest.count() > 4
    rows = sorted(warc.read_archives(manifest).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    want = sorted(pages(spark).collect(), key=lambda r: (r["page_id"] is None, r["page_id"] or 0))
    assert [r["page_id"] for r in rows] == [w["page_id"] for w in want]
    for r, w in zip(rows, want):
        body = (w["html"] or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        revisit = w["html"] == LONG and w["page_id"] in (5, 9)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
        assert r["html"] == (None if revisit else w["html"] or "")


def test_files_are_gzip_members_and_reruns_are_equal(spark):
    a, b = (sorted(tuple(r)[:2] + tuple(r)[3:] for r in warc.write_archives(pages(spark), scratch_path(spark, "warc")).collect()) for _ in range(2))
    assert a == b
    manifest = warc.write_archives(pages(spark), scratch_path(spark, "warc"))
    for r in manifest.collect():
        data = open(r["path"].removeprefix("file:"), "rb").read()
        assert hashlib.sha256(data).hexdigest() == r["sha256"] and len(data) == r["n_bytes"]
        assert gzip.decompress(data).count(b"WARC-Record-ID") == r["n_records"]


def test_empty_table(spark):
    manifest = warc.write_archives(pages(spark).limit(0), scratch_path(spark, "warc"))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


def test_clashing_columns_and_copies_of_a_key(spark):
    names = "record_type string, payload string, payload_digest string, shard int, path string, refers_to long, n_bytes long"
    rows = [(i, f"http://{i}", LONG if i % 2 else None, "x", "y", "z", i, "p", 7, -1) for i in (4, 1, 3, 3)]
    odd = spark.createDataFrame(rows, f"page_id long, url string, html string, {names}")
    found = warc.read_archives(warc.write_archives(odd, scratch_path(spark, "warc"))).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found if r["page_id"] != 3) == [
        (1, "response", None, len(LONG.encode())), (4, "response", None, 0),
    ]
    assert [(r["record_type"], r["refers_to"]) for r in found if r["page_id"] == 3] == [("revisit", 1)] * 2
