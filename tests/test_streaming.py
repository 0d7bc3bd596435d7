import datetime as dt
import json
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import sliding
from strata.streaming import replay, telemetry, windows

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("series", T.StringType()), T.StructField("event_time", T.TimestampType()), T.StructField("p", T.DoubleType()), T.StructField("code", T.IntegerType())])


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"id": i, "series": s, "event_time": f"2024-01-01T00:{m:02d}:{sec:02d}.000Z", "p": p, "code": c}) for i, s, m, sec, p, c in rows))
    time.sleep(0.02)


def run(spark, source, out):
    pace = telemetry.Pace(files_per_batch=1)
    events = telemetry.json_events(spark, str(source), SCHEMA, pace)
    raw = telemetry.start_raw(events, str(out / "raw"), str(out / "raw-cp"))
    agg = telemetry.start_tumbling(events, str(out / "agg"), str(out / "agg-cp"), ["p"], pace)
    telemetry.finish(raw, agg)
    return telemetry.progress(agg)


def test_late_events_and_restart(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    write(source, "1.json", [(1, "a", 0, 10, 1.0, 0), (2, "a", 0, 50, 3.0, 2), (3, "b", 0, 20, 5.0, 0)])
    write(source, "2.json", [(4, "a", 9, 0, 1.0, 0), (5, "a", 8, 30, 2.0, 0)])
    run(spark, source, out)
    # after a restart: one event within the watermark, one far behind it
    write(source, "3.json", [(6, "a", 8, 10, 4.0, 0), (7, "a", 0, 30, 9.0, 0)])
    write(source, "4.json", [(8, "a", 20, 0, 1.0, 0)])
    done = run(spark, source, out)
    raw = spark.read.parquet(str(out / "raw"))
    assert sorted(r["id"] for r in raw.collect()) == list(range(1, 9))
    rows = {(r["series"], r["window_start"].minute): r for r in spark.read.parquet(str(out / "agg")).collect()}
    assert rows["a", 0]["n"] == 2 and rows["a", 0]["avg_p"] == 2.0 and rows["a", 0]["max_code"] == 2
    assert rows["a", 8]["n"] == 2 and rows["a", 8]["max_p"] == 4.0
    assert ("a", 20) not in rows
    assert done["rows_dropped"] == 1 and done["rows_read"] >= 3
    # nothing new: nothing is written again
    run(spark, source, out)
    assert spark.read.parquet(str(out / "raw")).count() == 8


def test_replay_offsets_rounds_and_lateness(spark):
    start = dt.datetime(2020, 1, 1)
    rows = spark.createDataFrame([(i, "ab"[i % 2], start + dt.timedelta(seconds=i)) for i in range(10)], "id long, s string, ts timestamp")
    out = replay.with_offset(rows, "s", "ts")
    assert sorted(r["offset_us"] for r in out.where("s = 'b'").collect()) == [0, 2_000_000, 4_000_000, 6_000_000, 8_000_000]
    again = replay.looped(out, 2, "s").where("s = 'b' and round = 1").agg(F.min("offset_us")).first()[0]
    assert again == 9_000_000
    places = replay.numbered(out, ["offset_us", "id"]).orderBy("place").collect()
    assert [r["place"] for r in places] == list(range(1, 11)) and [r["offset_us"] for r in places] == sorted(r["offset_us"] for r in places)
    late = replay.late_plan(spark.range(5000).selectExpr("id", "id as o"), "id", "o", "2030-01-01").where("late")
    assert 200 <= late.count() <= 300 and late.where("delay_s < 30 or delay_s > 120").count() == 0
    assert replay.late_plan(spark.range(100).selectExpr("id", "id as o"), "id", "o", "2030-01-01", permille=0).where("late").count() == 0


def test_totals_beyond_a_hundred_batches(spark):
    with telemetry.watched(spark) as totals:
        rows = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 3).load()
        query = rows.writeStream.queryName("many").foreachBatch(lambda df, i: df.count()).trigger(processingTime="0 seconds").start()
        while query.lastProgress is None or query.lastProgress["batchId"] < 104:
            query.awaitTermination(0.3)
        done = telemetry.run_for([query], 0.1, report=lambda x: None)
    assert len(query.recentProgress) <= 100
    n = totals.by_query["many"]["batches"]
    assert n >= 105 and totals.by_query["many"]["rows_read"] == 3 * n
    assert done["many"]["rows_read"] > 0 and not totals.failed


def test_batches_come_in_order_and_late_rows_are_dropped(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, start + dt.timedelta(minutes=i), 7 * i % 50, "a") for i in range(60)], "id long, ts timestamp, emit long, series string").withColumn("emit", F.when(F.col("id") % 20 == 3, 1000 + F.col("id")).otherwise(F.col("id")))
    assert replay.write_batches(rows, ["emit"], 6, str(tmp_path / "in")) == 6
    events = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = []
    telemetry.finish(telemetry.start_publishing(events, lambda df, i: seen.append([r["emit"] for r in df.collect()]), str(tmp_path / "c1"), pace=telemetry.Pace(files_per_batch=1)))
    assert [x for b in seen for x in sorted(b)] == sorted(r["emit"] for r in rows.collect()) and len(seen) == 6
    pace = telemetry.Pace("2 minutes", "5 minutes", files_per_batch=1)
    with telemetry.watched(spark) as totals:
        timed = events.withColumnRenamed("ts", "event_time").withColumn("code", F.lit(0))
        telemetry.finish(telemetry.start_tumbling(timed, str(tmp_path / "out"), str(tmp_path / "c2"), ["id"], pace))
    # of the rows held back to the end, those of minutes 3 and 23: the last batch still drops by the watermark before the one before it
    assert totals.by_query["tumbling"]["rows_dropped"] == 2 and totals.by_query["tumbling"]["rows_read"] == 60
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.agg(F.sum("n")).first()[0] == out.count() * 5 - 2


def test_a_batch_written_twice_is_there_once(spark, tmp_path):
    publish = telemetry.replace_batch(str(tmp_path / "out"))
    for batch, n in ((0, 5), (1, 7), (1, 4), (2, 0)):
        publish(spark.range(n), batch)
    assert sorted((r["batch"], r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("batch").count().collect()) == [(0, 5), (1, 4)]


def test_stream_of_sliding_windows_with_gaps_and_disorder(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = [0, 1, 3, 3, 9, 14, 15, 60, 61, 62, 75, 90, 91, 130]
    data = [(s, start + dt.timedelta(seconds=t + off), None if t == 14 else float(t * t % 17), float("nan") if s == "b" else 1.0) for s, off in (("a", 0), ("b", 5)) for t in at]
    rows = spark.createDataFrame(data, "s string, ts timestamp, v double, u double")
    # neighbours in time come in other batches, but none behind the watermark
    mixed = rows.withColumn("place", F.unix_seconds("ts") + F.when(F.unix_seconds("ts") % 2 == 0, 20).otherwise(0))
    replay.write_batches(mixed, ["place", "s", "v"], 5, str(tmp_path / "in"))
    events = spark.readStream.schema(mixed.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = windows.sliding_stream(events, "s", "ts", ["v", "u"], 10, 5, "60 seconds")
    telemetry.finish(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    names = ["s", "k", "window_start", "n_rows", *[f"{c}_{x}" for c in "vu" for x in sliding.STATISTICS]]
    want = sliding.features(sliding.windowed(rows, "s", "ts", 10, 5), "s", ["v", "u"]).select(names)
    clean = lambda df: {(r["s"], r["k"]): [round(x, 9) if isinstance(x, float) else x for x in r] for r in df.collect()}
    # the watermark ends at 135 - 60 seconds
    ended = {k: v for k, v in clean(want).items() if v[2] + 10 + (5 if k[0] == "b" else 0) <= 75}
    got = clean(spark.read.parquet(str(tmp_path / "out")).select(names))
    assert got == ended and len(got) > 8


def slide(spark, rows, folder, batches, order, sensors, width, step, lateness):
    """The windows of a stream and of the batch, without order, and the stream's query."""
    replay.write_batches(rows, order, batches, f"{folder}/in")
    events = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    out = windows.sliding_stream(events, "s", "ts", sensors, width, step, lateness)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    telemetry.finish(query)
    names = ["s", "k", "window_start", "n_rows", *[f"{c}_{x}" for c in sensors for x in sliding.STATISTICS]]
    want = sliding.features(sliding.windowed(rows, "s", "ts", width, step), "s", sensors).select(names)
    clean = lambda df: {(r["s"], r["k"]): [round(x, 6) if isinstance(x, float) else x for x in r] for r in df.collect()}
    return clean(spark.read.parquet(f"{folder}/out").select(names)), clean(want), query


def test_a_row_that_comes_late_into_a_gap_has_its_windows(spark, tmp_path):
    """Windows up to the row behind a gap were given up before the watermark had passed them."""
    start = dt.datetime(2024, 1, 1)
    at = [0, 100, 101, 102, 45, 103, 300, 301, 302, 303]
    rows = spark.createDataFrame([("a", start + dt.timedelta(seconds=t), float(t), i) for i, t in enumerate(at)], "s string, ts timestamp, v double, place long")
    got, want, _ = slide(spark, rows, tmp_path, 5, ["place"], ["v"], 10, 5, "60 seconds")
    assert got == {k: v for k, v in want.items() if v[2] + 10 <= 303 - 60} and {("a", 8), ("a", 9)} <= got.keys()


def test_many_series_share_a_bounded_number_of_states(spark, tmp_path):
    """There was a state, and a call of Python in every batch, for each series."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.hash("id"), F.lit(200_000)) / 1000)
    v = F.when(F.col("id") % 7 > 0, F.col("id") % 13).cast("double")
    some = spark.range(4000).select((F.col("id") % 400).alias("s"), at.alias("ts"), v.alias("v"), F.when(F.col("id") % 5 > 0, v).otherwise(float("nan")).alias("u"))
    # one series with more rows in windows than are looked at at once
    long = spark.range(30_000).select(F.lit(-1).cast("long").alias("s"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") / 150).alias("ts"), v.alias("v"), v.alias("u"))
    odd = spark.createDataFrame([(None, dt.datetime(2023, 11, 14, 22, 15), 1.0, 1.0), (7, None, 1.0, 1.0)], some.schema)
    got, want, query = slide(spark, some.union(long), tmp_path / "a", 4, ["ts", "s"], ["v", "u"], 50, 1, "10 seconds")
    last = [p for p in query.recentProgress if p.stateOperators][-1]
    assert last.stateOperators[0].numRowsTotal <= 256
    began = {r["s"]: r["t"] for r in some.union(long).groupBy("s").agg(F.unix_micros(F.min("ts")).alias("t")).collect()}
    until = 1_700_000_000_000_000 + 199_993_000 - 10_000_000
    ended = {k: x for k, x in want.items() if began[k[0]] + (x[2] + 50) * 1_000_000 <= until - 1_000_000}
    assert ended.items() <= got.items() and got.items() <= want.items() and len(ended) > 20_000
    got, want, _ = slide(spark, some.where("s < 9").union(odd), tmp_path / "b", 2, ["ts", "s"], ["v", "u"], 50, 10, "10 seconds")
    assert got.items() <= want.items() and len(got) > 20
