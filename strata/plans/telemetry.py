"""Replay, tumbling and sliding windows, milestones and alarms, on the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import alarms, sliding
from strata.plans.registry import Registry, table
from strata.streaming import replay, telemetry

query = Registry()

DAY = 86_400


def code():
    """Events as class codes: a purchase is an event (2, or -1 for some users), a click the transient before it (100 or 107), a
    signup has no label, or NaN."""
    odd = F.col("user_id") % 2
    kinds = F.when(F.col("event_type") == "purchase", F.when(odd == 0, 2.0).otherwise(-1.0)).when(F.col("event_type") == "click", F.when(odd == 0, 100.0).otherwise(107.0))
    return kinds.when(F.col("event_type") != "signup", 0.0).when(odd == 0, F.lit(float("nan")))


CODE = "case event_type when 'purchase' then case user_id % 2 when 0 then 2 else -1 end when 'click' then case user_id % 2 when 0 then 100 else 107 end when 'signup' then null else 0 end"
SEVERITY = "case when c = 0 then 0 when c >= 100 then 1 when c is not null then 2 end"


@query("""select event_id, user_id, (epoch_us(ts) - min_us) / 1e6 as offset_s, row_number() over (order by epoch_us(ts) - min_us, user_id, event_id) as place from (select *, min(epoch_us(ts)) over (partition by user_id) as min_us from events)""")
def replay_order(spark, d):
    rows = replay.with_offset(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts")
    return replay.numbered(rows, ["offset_us", "user_id", "event_id"]).select("event_id", "user_id", (F.col("offset_us") / 1e6).alias("offset_s"), "place")


@query("""select event_id, late, delay_s, cast(timestamp '2030-01-01' + interval 1 second * (event_id * 2 + delay_s) as timestamp) as emit_at from (select event_id, (event_id * 7919 + 17) % 1000 < 50 as late,
    case when (event_id * 7919 + 17) % 1000 < 50 then 30 + (event_id * 104729 + 7) % 91 else 0 end as delay_s from events)""")
def late_plan(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") * 2).alias("offset_s"))
    return replay.late_plan(rows, "event_id", "offset_s", "2030-01-01").select("event_id", "late", "delay_s", "emit_at")


@query("""select event_id, ts as original, cast(timestamp '2030-01-01' + (ts - (select min(ts) from events)) as timestamp) as event_time from events""")
def event_time_rebase(spark, d):
    return replay.rebased(table(spark, d, "events"), "ts", "2030-01-01").select("event_id", F.col("original"), "event_time")


AGG = "count(*) as n, round(avg(value), 6) as avg_value, min(value) as min_value, max(value) as max_value, max(user_id) as max_code"


@query(f"select time_bucket(interval 1 hour, ts) as window_start, time_bucket(interval 1 hour, ts) + interval 1 hour as window_end, event_type as series, {AGG} from events group by 1, 2, 3")
def batch_tumbling(spark, d):
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("event_time"), F.col("event_type").alias("series"), "value", F.col("user_id").alias("code"))
    return telemetry.plain(telemetry.tumbling(rows, "1 hour", ["value"]))


@query(f"""select * from (select time_bucket(interval 1 hour, ts) as window_start, time_bucket(interval 1 hour, ts) + interval 1 hour as window_end, event_type as series, {AGG} from events group by 1, 2, 3)
    where window_end <= (select max(ts) from events) - interval 2 minute""")
def stream_tumbling(spark, d):
    """The tumbling windows that a stream over the events has closed in the end."""
    return telemetry.plain(telemetry.run_tumbling(spark, d, "1 hour", "2 minutes"))


@query("select event_id, ts, user_id, event_type, value from events")
def stream_raw(spark, d):
    """What the raw stream has stored: every event, late or not."""
    return telemetry.run_raw(spark, d)


@query("""with b as (select event_id, user_id, epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id) as o from events), l as (select *, max(o) over (partition by user_id) as last from b)
    select event_id, r as round, o + r * (last + 1000000) as offset_us from l, generate_series(0, 2) t(r)""")
def replay_looped(spark, d):
    """The series three times, one round after the other."""
    rows = replay.with_offset(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts")
    return replay.looped(rows, 3, "user_id").select("event_id", F.col("round").cast("long").alias("round"), "offset_us")


# events in the order in which they are sent, one in twenty held back for one to twelve days, in twelve batches
SENT = """(select *, (row_number() over (order by sent, event_id) - 1) * 12 // count(*) over () as batch from (select *, epoch(ts - (select min(ts) from events))::bigint
    + case when (event_id * 7919 + 17) % 1000 < 50 then 86400 + (event_id * 104729 + 7) % (11 * 86400 + 1) else 0 end as sent from events))"""


def sent(spark, d):
    events = table(spark, d, "events")
    first = events.agg(F.min("ts")).first()[0]
    offset = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit(first).cast("timestamp")) - F.when(F.date_format("ts", "SSSSSS") < F.date_format(F.lit(first), "SSSSSS"), 1).otherwise(0)
    return replay.late_plan(events.withColumn("offset_s", offset), "event_id", "offset_s", "2030-01-01", least_s=DAY, most_s=12 * DAY)


@query(f"""with e as (select *, time_bucket(interval 1 day, ts) + interval 1 day as window_end from {SENT}),
    b as (select batch, max(max(ts)) over (order by batch) as seen from e group by 1), w as (select batch, lag(seen, {{lag}}) over (order by batch) - interval 2 day as passed from b)
    select window_end - interval 1 day as window_start, window_end, event_type as series, count(*) as n, round(avg(value), 6) as avg_value, min(value) as min_value, max(value) as max_value, max(user_id) as max_code
    from e join w using (batch) where (passed is null or window_end > passed) and window_end <= (select max(ts) from events) - interval 2 day group by 1, 2, 3""".replace("{lag}", "2"))
def stream_late(spark, d):
    """Daily windows of events that come in twelve batches, late ones held back for days and the last of these flushed in the
    end; those of windows that the watermark of the batch before had passed are dropped."""
    return telemetry.plain(telemetry.run_late(spark, sent(spark, d), 12, "1 day", "2 days"))


@query(f"""select event_id, user_id, case when value > 60 then 'event' else 'transient' end as predicted from {SENT} where value > 30""")
def stream_published(spark, d):
    """Alerts by a rule from twelve batches, each in its own place; the stream is killed after a write that it doesn't commit, and started again."""
    return telemetry.run_published(spark, sent(spark, d), 12)


SLIDING = f"""with b as (select *, (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6 as dt from events), m as (select *, max(dt) over (partition by user_id) as last from b),
    w as (select *, unnest(generate_series(greatest(0, cast(floor((dt - 7 * {DAY}) / {DAY}) as bigint) + 1), cast(floor(dt / {DAY}) as bigint))) as k from m), f as (select * from w where k * {DAY} + 7 * {DAY} <= last)"""


@query(f"""{SLIDING} select user_id, k, count(*) as n_rows, round(case when count(*) >= 2 then avg(value) end, 6) as value_mean, round(case when count(*) >= 2 then stddev_pop(value) end, 6) as value_std, case when count(*) >= 2 then min(value) end as value_min,
    case when count(*) >= 2 then max(value) end as value_max, round(case when count(*) >= 2 and var_pop(dt) > 0 then regr_slope(value, dt) * {DAY} end, 6) as value_slope,
    round(case when count(*) >= 2 then arg_max(value, dt) - arg_min(value, dt) end, 6) as value_delta from f group by 1, 2""")
def sliding_features(spark, d):
    rows = sliding.windowed(table(spark, d, "events").select("user_id", "ts", "value"), "user_id", "ts", 7 * DAY, DAY)
    out = sliding.features(rows, "user_id", ["value"])
    return out.select("user_id", "k", "n_rows", *[F.round(F.col(f"value_{s}") * (DAY if s == "slope" else 1), 6).alias(f"value_{s}") for s in sliding.STATISTICS])


@query(f"""{SLIDING} select user_id, k, k * {DAY} as window_start, count(*) as n_rows, round(avg(value), 6) as value_mean, round(case when count(*) >= 2 and var_pop(dt) > 0 then regr_slope(value, dt) * {DAY} end, 6) as value_slope,
    round(case when count(*) >= 2 then arg_max(value, dt) - arg_min(value, dt) end, 6) as value_delta from f join (select user_id, min(ts) as began from events group by 1) using (user_id)
    where began + k * interval 1 day + interval 7 day <= (select max(ts) from events) - interval 1 day group by 1, 2 having count(*) >= 2""")
def stream_sliding(spark, d):
    """The sliding windows of a stream over twelve batches of events in order, restarted in between: those that the watermark has passed."""
    out = telemetry.run_sliding(spark, table(spark, d, "events").select("event_id", "user_id", "ts", "value"), 12, 7 * DAY, DAY, "1 day").where("value_mean is not null")
    return out.select("user_id", "k", "window_start", "n_rows", F.round("value_mean", 6).alias("value_mean"), F.round(F.col("value_slope") * DAY, 6).alias("value_slope"), F.round("value_delta", 6).alias("value_delta"))


@query(f"""{SLIDING} select user_id, k, case max({SEVERITY}) when 2 then 'event' when 1 then 'transient' when 0 then 'normal' end as label from (select *, {CODE} as c from f) group by 1, 2""")
def window_labels(spark, d):
    rows = sliding.windowed(table(spark, d, "events"), "user_id", "ts", 7 * DAY, DAY)
    return sliding.features(rows, "user_id", ["value"], label=code()).select("user_id", "k", "label")


@query(f"""{SLIDING} select user_id, k, count(*) as n_rows, case max({SEVERITY}) when 2 then 'event' when 1 then 'transient' else 'normal' end as label
    from (select *, {CODE} as c from f) group by 1, 2 having count(c) > 0""")
def windows_to_train(spark, d):
    """Windows with a label only, as training takes them."""
    rows = sliding.windowed(table(spark, d, "events"), "user_id", "ts", 7 * DAY, DAY)
    return sliding.features(rows, "user_id", ["value"], label=code(), trained=True).select("user_id", "k", "n_rows", "label")


@query("select user_id, cast(greatest(15, ceil(date_diff('second', min(ts), max(ts)) / 1500.0)) as bigint) as step_s from events group by 1")
def adaptive_step(spark, d):
    last, first = (F.unix_seconds(f("ts").cast("timestamp")) for f in (F.max, F.min))
    return table(spark, d, "events").groupBy("user_id").agg(sliding.adaptive_step(last - first, 15, 1500).alias("step_s"))


MARKS = f"(select user_id, min(case when {CODE} >= 100 then ts end) as transient_at, min(case when {CODE} in (2, -1) then ts end) as event_at from events group by 1)"


def marks(spark, d):
    return alarms.milestones(table(spark, d, "events"), "user_id", "ts", code())


@query(f"select * from {MARKS}")
def first_label_instant(spark, d):
    return marks(spark, d)


ALARMS = "(select user_id, min(ts) as alarm_at from events where event_type in ('error', 'view') and value > 45 group by 1)"
LEADS = f"""(select user_id, transient_at, event_at, alarm_at, case when alarm_at is null then 'none' when alarm_at < transient_at then 'early' when alarm_at > event_at then 'late' else 'on_time' end as moment from {MARKS} left join {ALARMS} using (user_id) where event_at is not null)"""
LEAD = f"(select *, case when moment = 'on_time' then date_diff('second', date_trunc('second', alarm_at), date_trunc('second', event_at)) end as lead_s from {LEADS})"


def leads(spark, d):
    windows = table(spark, d, "events").select("user_id", "ts", F.when(F.col("event_type").isin("error", "view") & (F.col("value") > 45), "event").otherwise("normal").alias("predicted"))
    return alarms.lead_times(marks(spark, d), alarms.first_alarms(windows, "user_id", "predicted", "ts"), "user_id")


@query(f"select * from {LEAD}")
def lead_time(spark, d):
    return leads(spark, d)


@query(f"""select user_id % 3 as class, count(*) filter (where moment = 'none') as n_none, count(*) filter (where moment = 'early') as n_early, count(*) filter (where moment = 'late') as n_late, count(*) filter (where moment = 'on_time') as n_on_time,
    round(coalesce(avg(lead_s), 0), 6) as mean_lead_s, round(quantile_cont(lead_s, 0.5), 6) as median_lead_s from {LEAD} group by 1""")
def lead_time_stats(spark, d):
    out = alarms.lead_statistics(leads(spark, d).withColumn("class", F.col("user_id") % 3), "class")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_lead_s", "median_lead_s")})
