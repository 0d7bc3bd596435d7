"""Contracts, quarantine, deduplication and the log of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators import checks, contracts, dedupe, monitor
from strata.plans.registry import Registry, table

query = Registry()

LINES = contracts.Contract(
    table="silver.lines", primary_key=("l_orderkey", "l_linenumber"), dedupe_by=("l_shipdate",), partition_by=("l_linestatus",),
    fields=(
        contracts.Field("l_orderkey", "bigint", False), contracts.Field("l_linenumber", "int", False, 1, 7), contracts.Field("l_quantity", "double", True, 2),
        contracts.Field("l_discount", "double", True, 0, 0.08), contracts.Field("l_returnflag", "string", False, allowed=("A", "N")), contracts.Field("l_linestatus", "string"),
        contracts.Field("l_open", "boolean"), contracts.Field("l_shipdate", "date"),
    ),
)


def raw_lines(spark, d):
    """Lines as text, with blanks, spaces and flags, one resource a ship year."""
    x = table(spark, d, "lineitem")
    return x.select(
        F.col("l_orderkey").cast("string"), F.concat(F.lit(" "), F.col("l_linenumber").cast("string")).alias("l_linenumber"),
        F.when(F.col("l_orderkey") % 50 == 0, " ").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("l_quantity"),
        F.format_string("%.2f", "l_discount").alias("l_discount"), "l_returnflag", "l_linestatus",
        F.when(F.col("l_linestatus") == "O", "T").when(F.col("l_linenumber") == 1, "x").otherwise(" f").alias("l_open"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"), F.year("l_shipdate").cast("string").alias("_resource_id"), F.lit("h").alias("_source_sha256"), F.lit("real").alias("data_origin"),
    )


#: Typed lines with their reason, in SQL.
TYPED = """select l_orderkey, l_linenumber, case when l_orderkey % 50 = 0 then null else cast(cast(l_quantity as integer) as double) end as l_quantity, round(l_discount, 2) as l_discount, l_returnflag, l_linestatus,
    case when l_linestatus = 'O' then true when l_linenumber = 1 then null else false end as l_open, cast(l_shipdate as date) as l_shipdate, cast(year(l_shipdate) as varchar) as _resource_id, 'h' as _source_sha256, 'real' as data_origin from lineitem"""
REASONED = f"""select *, concat_ws('; ', case when l_linenumber < 1 then 'l_linenumber < 1' end, case when l_linenumber > 7 then 'l_linenumber > 7' end, case when l_quantity < 2 then 'l_quantity < 2' end,
    case when l_discount < 0 then 'l_discount < 0' end, case when l_discount > 0.08 then 'l_discount > 0.08' end, case when l_returnflag not in ('A', 'N') then 'l_returnflag not in list' end) as reject_reason from ({TYPED})"""


@query(f"select * exclude (reject_reason) from ({REASONED}) where reject_reason = ''")
def contract_typed(spark, d):
    return contracts.accepted(contracts.flagged(raw_lines(spark, d), LINES), LINES)


@query(f"select reject_reason, l_orderkey, l_linenumber, _resource_id from ({REASONED}) where reject_reason <> ''")
def contract_rejects(spark, d):
    out = contracts.rejected(contracts.flagged(raw_lines(spark, d), LINES), LINES)
    return out.select("reject_reason", F.trim("l_orderkey").cast("long").alias("l_orderkey"), F.trim("l_linenumber").cast("int").alias("l_linenumber"), "_resource_id")


@query(f"select reject_reason, count(*) as n from ({REASONED}) where reject_reason <> '' group by 1")
def quarantine_summary(spark, d):
    return monitor.rejects_by_reason(contracts.rejected(contracts.flagged(raw_lines(spark, d), LINES), LINES))


@query("""select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey from lineitem
    qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) = 1""")
def dedupe_latest(spark, d):
    rows = dedupe.latest(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return rows.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")


@query("""select count(*) as rows, count(distinct (l_orderkey, l_linenumber)) as keys, count(*) - count(l_orderkey) as null_l_orderkey, count(*) - count(l_linenumber) as null_l_linenumber,
    count(*) - count(l_returnflag) as null_l_returnflag from lineitem""")
def contract_measures(spark, d):
    return table(spark, d, "lineitem").agg(*contracts.measure_columns(LINES))


def odd_lines(spark, d):
    """Lines with nulls in what must not be null (1995), blank keys (1996), many rejects (1997) and few (1998); keys repeat in all."""
    year, key = F.col("_resource_id").cast("int"), F.col("l_orderkey").cast("long")
    rows = raw_lines(spark, d)
    rows = rows.withColumn("l_returnflag", F.when((year == 1995) & (key % 7 == 0), " ").otherwise(F.col("l_returnflag")))
    rows = rows.withColumn("l_linenumber", F.when((year == 1996) & (key % 5 == 0), "").otherwise(F.col("l_linenumber")))
    big = ((year == 1997) & (key % 3 == 0)) | ((year == 1998) & (key % 1000 == 1))
    return rows.withColumn("l_quantity", F.when(big, "99").otherwise(F.col("l_quantity")))


ODD = contracts.Contract(
    table="silver.odd_lines", primary_key=("l_orderkey", "l_linenumber"), dedupe_by=("l_shipdate",),
    fields=(
        contracts.Field("l_orderkey", "bigint", False), contracts.Field("l_linenumber", "int", False, 1, 7),
        contracts.Field("l_quantity", "double", True, 0, 50), contracts.Field("l_returnflag", "string", False), contracts.Field("l_shipdate", "date"),
    ),
)

ODD_SQL = """with o as (select cast(year(l_shipdate) as varchar) as resource_id, l_orderkey as k,
        case when year(l_shipdate) = 1996 and l_orderkey % 5 = 0 then null else l_linenumber end as n,
        case when year(l_shipdate) = 1995 and l_orderkey % 7 = 0 then null else l_returnflag end as f,
        year(l_shipdate) = 1997 and l_orderkey % 3 = 0 or year(l_shipdate) = 1998 and l_orderkey % 1000 = 1 as bad,
        l_shipdate, row_number() over (partition by resource_id, bad, k, n order by l_shipdate desc) as place from lineitem),
    r as (select resource_id, count(*) as rows_in, count(*) filter (where bad) as rows_rejected,
        count(*) filter (where not bad and place = 1) as kept, count(*) filter (where not bad and place = 1 and n is not null) as keys,
        count(*) filter (where not bad and place = 1 and f is null) as no_flag from o group by 1),
    h as (select *, concat_ws('; ', case when kept > keys then (kept - keys) || ' nulls in l_linenumber' end, case when no_flag > 0 then no_flag || ' nulls in l_returnflag' end,
        case when kept > keys then (kept - keys) || ' rows repeat the key l_orderkey, l_linenumber' end,
        case when rows_rejected / rows_in > 0.01 then rows_rejected || ' of ' || rows_in || ' rows rejected' end) as hard_failures from r)"""


def odd_runs(spark, d):
    """What a load of each resource logs. Rows of one key and date differ in the flag, so of these the one with a flag stays."""
    flags = contracts.flagged(odd_lines(spark, d), ODD)
    silver = dedupe.latest(contracts.accepted(flags, ODD), ("_resource_id", *ODD.primary_key), ("l_shipdate",))
    return contracts.run_log(flags, silver, ODD)


@query(f"{ODD_SQL} select 'silver.odd_lines' as contract, resource_id, rows_in, case when hard_failures = '' then kept else 0 end as rows_out, rows_rejected, hard_failures, case when hard_failures = '' then 'ok' else 'failed' end as status from h")
def contract_run_log(spark, d):
    return odd_runs(spark, d)


RUN_SQL = f"""with f as ({REASONED}),
    s as (select _resource_id, count(distinct (l_orderkey, l_linenumber)) as rows_kept from f where reject_reason = '' group by 1)
    select f._resource_id as resource_id, count(*) as rows_in, count(*) filter (where reject_reason <> '') as rows_rejected, any_value(coalesce(rows_kept, 0)) as rows_kept,
        case when count(*) filter (where reject_reason <> '') / count(*) > 0.01 then count(*) filter (where reject_reason <> '') || ' of ' || count(*) || ' rows rejected' else '' end as hard_failures
    from f left join s using (_resource_id) group by 1"""


def run_rows(spark, d):
    """What a load of each resource logs, in one pass over all of them."""
    flags = contracts.flagged(raw_lines(spark, d), LINES)
    silver = dedupe.latest(contracts.accepted(flags, LINES), ("_resource_id", *LINES.primary_key), LINES.dedupe_by)
    return contracts.run_log(flags, silver, LINES)


@query(f"select resource_id, hard_failures from ({RUN_SQL}) where hard_failures <> ''")
def contract_hard_failures(spark, d):
    return run_rows(spark, d).where("hard_failures <> ''").select("resource_id", "hard_failures")


@query(f"""select 'silver.lines' as contract, resource_id, rows_in, case when hard_failures = '' then rows_kept else 0 end as rows_out, rows_rejected, hard_failures,
    case when hard_failures = '' then 'ok' else 'failed' end as status from ({RUN_SQL})""")
def dq_runs(spark, d):
    return run_rows(spark, d)


@query("""with r as (select cast(year(l_shipdate) as varchar) as resource_id, case when year(l_shipdate) % 2 = 0 then 'h' else 'old' end as was from lineitem where year(l_shipdate) <> 1995)
    select distinct cast(year(l_shipdate) as varchar) as resource_id, 'h' as sha256 from lineitem where cast(year(l_shipdate) as varchar) not in (select resource_id from r where was = 'h')""")
def pending_resources(spark, d):
    """Resources that are not loaded, or by another hash: odd years are loaded from an older file, 1995 isn't."""
    raw, year = raw_lines(spark, d), F.col("_resource_id").cast("int")
    loaded = raw.where(year != 1995).withColumn("_source_sha256", F.when(year % 2 == 0, "h").otherwise("old"))
    return contracts.pending_resources(raw, loaded)


@query("select o_custkey, count(*) as n from orders where o_custkey is not null group by 1 having count(*) > 1")
def check_unique(spark, d):
    return checks.unique(table(spark, d, "orders"), "o_custkey")


@query("select c_custkey, nullif(c_mktsegment, 'FURNITURE') as segment from customer where c_mktsegment = 'FURNITURE'")
def check_not_null(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("segment"))
    return checks.not_null(rows, "segment")


@query("select p_type, count(*) as n from part where p_type not in ('ECONOMY', 'PROMO', 'SMALL') group by 1")
def check_accepted(spark, d):
    return checks.accepted(table(spark, d, "part"), "p_type", ["ECONOMY", "PROMO", "SMALL"])


@query("select o_custkey, count(*) as n from orders o where o_custkey is not null and not exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_nationkey > 4) group by 1")
def check_relationships(spark, d):
    return checks.relationship(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").where("c_nationkey > 4"), "c_custkey")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def check_grain(spark, d):
    return checks.grain(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""select round(a.t, 2) as total_a, round(b.t, 2) as total_b from (select sum(o_totalprice) as t from orders) a cross join (select sum(l_extendedprice) as t from lineitem) b where abs(a.t - b.t) > 1""")
def check_reconciled(spark, d):
    out = checks.reconciled(table(spark, d, "orders"), table(spark, d, "lineitem"), F.sum("o_totalprice"), F.sum("l_extendedprice"))
    return out.select(F.round("total_a", 2).alias("total_a"), F.round("total_b", 2).alias("total_b"))


@query("""select max(ts) as last_loaded, cast(date_diff('day', cast(max(ts) as date), date '2024-03-10') as integer) as age_days,
    case when date_diff('day', cast(max(ts) as date), date '2024-03-10') > 45 then 'error' when date_diff('day', cast(max(ts) as date), date '2024-03-10') > 35 then 'warn' else 'pass' end as status from events""")
def check_freshness(spark, d):
    return checks.freshness(table(spark, d, "events"), "ts", F.lit("2024-03-10").cast("date"), 35, 45)


def runs_of_events(spark, d):
    status = F.when((F.col("event_type") == "error") & (F.col("value") > 30), "failed").otherwise("ok")
    return table(spark, d, "events").select(F.concat(F.lit("c"), F.pmod("user_id", F.lit(7)).cast("string")).alias("contract"), F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("run_at"), F.col("user_id").cast("string").alias("resource_id"), F.get_json_object("props", "$.k").cast("long").alias("rows_in"), F.when(F.col("event_type") == "view", 1).otherwise(0).cast("long").alias("rows_rejected"), F.lit(0).cast("long").alias("rows_out"), status.alias("status"))


RUNS = """select 'c' || user_id % 7 as contract, date_trunc('hour', ts) as run_at, cast(user_id as varchar) as resource_id, cast(json_extract(props, '$.k') as bigint) as rows_in, case when event_type = 'view' then 1 else 0 end as rows_rejected,
    case when event_type = 'error' and value > 30 then 'failed' else 'ok' end as status from events"""


@query(f"""select contract, cast(run_at as date) as day, count(*) as runs, cast(sum(rows_in) as bigint) as rows_in, cast(sum(rows_rejected) as bigint) as rows_rejected, round(sum(rows_rejected) / nullif(sum(rows_in), 0), 6) as reject_rate,
    count(distinct case when status = 'failed' then resource_id end) as failed_resources from ({RUNS}) group by 1, 2""")
def quality_daily(spark, d):
    return monitor.daily_quality(runs_of_events(spark, d))


@query(f"""select contract, max(run_at) as last_run, arg_max_null(state, run_at) as last_status from (select contract, run_at, case when max(case when status = 'failed' then 1 else 0 end) = 1 then 'failed' else 'ok' end as state from ({RUNS}) group by 1, 2) group by 1""")
def quality_last_status(spark, d):
    return monitor.last_quality(runs_of_events(spark, d))


@query(f"""select cast(sum(rows_in) as bigint) as rows_in, cast(0 as bigint) as rows_out, cast(sum(rows_rejected) as bigint) as rows_rejected, count(*) filter (where status = 'failed') as failed from ({RUNS})""")
def run_totals(spark, d):
    return monitor.run_totals(runs_of_events(spark, d))


def tables_of(spark, d):
    return [("orders", "c1", table(spark, d, "orders"), "o_orderdate"), ("lineitem", "c2", table(spark, d, "lineitem"), "l_shipdate"), ("events", "c3", table(spark, d, "events"), "ts"), ("customer", None, table(spark, d, "customer"), None), ("part", "none", table(spark, d, "part"), None)]


INVENTORY = """select 'orders' as table_name, 'c1' as contract, count(*) as n_rows, cast(max(o_orderdate) as date) as last_at from orders union all select 'lineitem', 'c2', count(*), cast(max(l_shipdate) as date) from lineitem
    union all select 'events', 'c3', count(*), cast(max(ts) as date) from events union all select 'customer', null, count(*), null from customer union all select 'part', 'none', count(*), null from part"""


@query(INVENTORY)
def health_inventory(spark, d):
    return monitor.inventory(tables_of(spark, d))


@query(f"""with q as (select contract, max(run_at) as last_run, arg_max_null(state, run_at) as last_status from (select contract, run_at, case when max(case when status = 'failed' then 1 else 0 end) = 1 then 'failed' else 'ok' end as state from ({RUNS}) group by 1, 2) group by 1),
    z as (select 'c1' as contract, count(*) as n_rejected from orders where o_totalprice < 10000)
    select i.*, q.last_run, q.last_status, z.n_rejected, cast(date_diff('day', last_at, date '2024-03-10') as integer) as age_days from ({INVENTORY}) i left join q using (contract) left join z using (contract)""")
def health(spark, d):
    rejects = monitor.inventory([("x", "c1", table(spark, d, "orders").where("o_totalprice < 10000"), None)])
    return monitor.health(monitor.inventory(tables_of(spark, d)), monitor.last_quality(runs_of_events(spark, d)), rejects, F.lit("2024-03-10").cast("date"))


@query("select o_orderstatus, count(*) as n_rows, cast(1 as bigint) as n_files from orders group by 1")
def partition_counts(spark, d):
    return monitor.partition_counts(table(spark, d, "orders"), "o_orderstatus")
