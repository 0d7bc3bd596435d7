"""The telemetry streams: raw events as they come, and tumbling aggregates with a watermark."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from strata.sources.files import parsed_events
from strata.sources.scratch import scratch_path
from strata.streaming.replay import write_batches
from strata.streaming.windows import sliding_stream


@dataclass(frozen=True)
class Pace:
    """Lateness that windows wait for, and files a batch: the file source's rate cap."""

    watermark: str = "2 minutes"
    width: str = "1 minute"
    files_per_batch: int = 100
    events_per_batch: int = 40_000
    #: How often a batch begins; None: all there is, then the stream ends.
    every: str | None = None

    def trigger(self) -> dict:
        return {"processingTime": self.every} if self.every else {"availableNow": True}


def json_events(spark: SparkSession, path: str, schema: T.StructType, pace: Pace = Pace()) -> DataFrame:
    """A stream of JSON files of a known schema, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", pace.files_per_batch).json(path)


def kafka_events(spark: SparkSession, servers: str, topic: str, schema: T.StructType, pace: Pace = Pace()) -> DataFrame:
    """A stream of the JSON values of a topic, from its beginning and at most so many events a batch; needs Spark's Kafka connector.
    Offsets are in the checkpoint, so a restart goes on where the last batch ended."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": pace.events_per_batch, "failOnDataLoss": "false"}
    return parsed_events(spark.readStream.format("kafka").options(**options).load(), "value", schema)


def tumbling(events: DataFrame, width: str, sensors: Sequence[str]) -> DataFrame:
    """Per window and ``series``: rows; mean, least and greatest of each sensor; the greatest ``code``."""
    found = [f(s).alias(f"{n}_{s}") for s in sensors for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]
    out = events.groupBy(F.window("event_time", width), "series").agg(F.count(F.lit(1)).alias("n"), *found, F.max("code").alias("max_code"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def plain(rows: DataFrame) -> DataFrame:
    """Times without zone and rounded means, to compare."""
    out = rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
    return out.withColumns({c: F.round(c, 6) for c in rows.columns if c.startswith("avg_")})


def start_raw(events: DataFrame, out: str, checkpoint: str, name: str = "raw", pace: Pace = Pace()) -> StreamingQuery:
    """Every event, by day, however late."""
    rows = events.withColumn("event_date", F.to_date("event_time"))
    return rows.writeStream.queryName(name).format("parquet").outputMode("append").partitionBy("event_date").option("path", out).option("checkpointLocation", checkpoint).trigger(**pace.trigger()).start()


def start_tumbling(events: DataFrame, out: str, checkpoint: str, sensors: Sequence[str], pace: Pace = Pace(), name: str = "tumbling") -> StreamingQuery:
    """Windows once the watermark has passed them. Events behind it are left out of them, and counted."""
    rows = tumbling(events.withWatermark("event_time", pace.watermark), pace.width, sensors)
    return rows.writeStream.queryName(name).format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(**pace.trigger()).start()


def _counts(p) -> dict[str, int]:
    """Rows read, windows written and rows behind the watermark of one batch; what is unknown counts as 0."""
    dropped = sum(max(0, s.numRowsDroppedByWatermark or 0) for s in p.stateOperators)
    return {"rows_read": max(0, p.numInputRows), "rows_written": max(0, p.sink.numOutputRows or 0), "rows_dropped": dropped}


class Totals(StreamingQueryListener):
    """Adds up the batches of every query by its name (without one, its id), however many there are."""

    def __init__(self):
        self.by_query: dict[str, dict[str, int]] = {}
        self.failed: dict[str, str] = {}
        self._names: dict[str, str] = {}
        self._last: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        name = self._names[str(event.id)] = event.name or str(event.id)
        self.by_query.setdefault(name, {"batches": 0, "rows_read": 0, "rows_written": 0, "rows_dropped": 0})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        # a trigger without a batch reports the last one's number again
        sums = self.by_query.setdefault(self._names.get(str(p.id), p.name or str(p.id)), {"batches": 0, "rows_read": 0, "rows_written": 0, "rows_dropped": 0})
        if p.batchId > self._last.get(str(p.id), -1):
            self._last[str(p.id)] = p.batchId
            sums["batches"] += 1
        for k, v in _counts(p).items():
            sums[k] += v

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed[self._names.get(str(event.id), str(event.id))] = event.exception


@contextmanager
def watched(spark: SparkSession):
    """The totals of the queries that run meanwhile, complete when it ends: events are waited for."""
    totals = Totals()
    spark.streams.addListener(totals)
    try:
        yield totals
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        # events of streams pass through a bus of their own, after that one
        until = time.monotonic() + 10
        while time.monotonic() < until:
            before = json.dumps(totals.by_query)
            time.sleep(0.5)
            if json.dumps(totals.by_query) == before:
                break
    finally:
        spark.streams.removeListener(totals)


def start_publishing(rows: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, name: str = "publish", pace: Pace = Pace()) -> StreamingQuery:
    """Every batch by ``publish(rows, batch)``, which must give the same when a batch comes again after a restart; see ``replace_batch``."""
    return rows.writeStream.queryName(name).foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**pace.trigger()).start()


def replace_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch in the place of what was written for its number before: a batch that was written but not committed when the
    stream was killed is not there twice."""

    def publish(rows: DataFrame, batch: int) -> None:
        # a folder a batch, replaced whole, also where the batch is empty now
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return publish


def progress(query: StreamingQuery) -> dict[str, int]:
    """Rows read, windows written and rows behind the watermark over the query's recent batches (Spark keeps a hundred); ``watched``
    has all."""
    found = [_counts(p) for p in query.recentProgress]
    return {k: sum(f[k] for f in found) for k in ("rows_read", "rows_written", "rows_dropped")}


def run_for(queries: Sequence[StreamingQuery], seconds: float, beat: float = 5.0, report=print) -> dict[str, dict[str, int]]:
    """Lets the streams run for so long, or until one fails or all have ended, and reports the progress of each at every beat. Then all are stopped; a
    failure is raised after that. All batches are counted."""
    until, spark = time.monotonic() + seconds, SparkSession.active()
    with watched(spark) as totals:

        def found() -> dict[str, dict[str, int]]:
            # a first batch may be over before the listener is there; the query itself knows the last hundred
            all_batches = {q.name: totals.by_query.get(q.name) or totals.by_query.get(str(q.id)) or {} for q in queries}
            return {q.name: {k: max(v, all_batches[q.name].get(k, 0)) for k, v in progress(q).items()} for q in queries}

        try:
            while time.monotonic() < until and (active := [q for q in queries if q.isActive]) and not any(q.exception() for q in queries):
                active[0].awaitTermination(max(0.1, min(beat, until - time.monotonic())))
                report(found())
        finally:
            failed = [e for q in queries if (e := q.exception())]
            for q in queries:
                q.stop()
    if failed:
        raise failed[0]
    return found()


def finish(*queries: StreamingQuery) -> None:
    """Waits for all; the first failure is raised after the others have ended."""
    failed = None
    for q in queries:
        try:
            q.awaitTermination()
        except Exception as e:  # noqa: BLE001
            failed = failed or e
    if failed:
        raise failed


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # the file source takes folders: the one file of the table is picked by name
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)


def run_tumbling(spark: SparkSession, sf_dir: str, width: str, watermark: str) -> DataFrame:
    events = _events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("event_time"), F.col("event_type").alias("series"), "value", F.col("user_id").alias("code"))
    folder = scratch_path(spark, "stream")
    finish(start_tumbling(events, f"{folder}/out", f"{folder}/checkpoint", ["value"], Pace(watermark, width)))
    return spark.read.parquet(f"{folder}/out")


def run_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("event_time", F.col("ts").cast("timestamp"))
    folder = scratch_path(spark, "stream")
    finish(start_raw(events, f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/out").select("event_id", "ts", "user_id", "event_type", "value")


def _batches(spark: SparkSession, rows: DataFrame, order: Sequence[str], batches: int, folder: str, pace: Pace) -> DataFrame:
    """The rows as a stream of so many batches."""
    write_batches(rows, order, batches, f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", pace.files_per_batch).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def run_late(spark: SparkSession, sent: DataFrame, batches: int, width: str, watermark: str) -> DataFrame:
    """The tumbling windows of events in the order of ``emit_at``."""
    folder, pace = scratch_path(spark, "stream"), Pace(watermark, width, files_per_batch=1)
    events = _batches(spark, sent, ["emit_at", "event_id"], batches, folder, pace)
    events = events.select(F.col("ts").cast("timestamp").alias("event_time"), F.col("event_type").alias("series"), "value", F.col("user_id").alias("code"))
    finish(start_tumbling(events, f"{folder}/out", f"{folder}/checkpoint", ["value"], pace))
    return spark.read.parquet(f"{folder}/out")


def run_published(spark: SparkSession, sent: DataFrame, batches: int) -> DataFrame:
    """Alerts of a stream that dies once after it has written a batch and before this is committed, and is started again."""
    folder, pace = scratch_path(spark, "stream"), Pace(files_per_batch=1)
    events = _batches(spark, sent, ["emit_at", "event_id"], batches, folder, pace)
    alerts = events.where("value > 30").select("event_id", "user_id", F.when(F.col("value") > 60, "event").otherwise("transient").alias("predicted"))
    publish, died = replace_batch(f"{folder}/out"), []

    def once_dies(rows: DataFrame, batch: int) -> None:
        publish(rows, batch)
        if batch == batches // 2 and not died:
            died.append(batch)
            raise RuntimeError("killed between write and commit")

    for _ in range(2):
        try:
            finish(start_publishing(alerts, once_dies, f"{folder}/checkpoint", pace=pace))
        except StreamingQueryException:
            if len(died) != 1:
                raise
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "predicted")


def run_sliding(spark: SparkSession, rows: DataFrame, batches: int, width_s: int, step_s: int, lateness: str) -> DataFrame:
    """Sliding windows of the stream of ``user_id``, ``ts``, ``value``, which is stopped after a third of its batches and started again."""
    folder, pace = scratch_path(spark, "stream"), Pace(files_per_batch=1)
    events = _batches(spark, rows, ["ts", "event_id"], batches, folder, pace)
    out = sliding_stream(events, "user_id", "ts", ["value"], width_s, step_s, lateness)

    def start(trigger: dict) -> StreamingQuery:
        return out.writeStream.queryName("sliding").format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start()

    first = start({"processingTime": "0 seconds"})
    while first.isActive and (first.lastProgress is None or first.lastProgress["batchId"] < batches // 3):
        first.awaitTermination(0.2)
    first.stop()
    if first.exception():
        raise first.exception()
    finish(start(pace.trigger()))
    return spark.read.parquet(f"{folder}/out")
