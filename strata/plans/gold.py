"""Dimensions, history, facts and the mart, on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.columns import capped, from_target, month_start, ratio, sum_of, to_target
from strata.operators import gold, history
from strata.plans.registry import Registry, table

query = Registry()


def observed(spark, d):
    """Orders as one observation a customer and month: that of the last order."""
    rows = table(spark, d, "orders").select("o_custkey", month_start(F.col("o_orderdate").cast("date")).alias("month"), "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice")
    last = F.struct("o_orderdate", "o_orderkey")
    return rows.groupBy("o_custkey", "month").agg(F.max_by("o_orderstatus", last).alias("status"), F.max_by("o_orderpriority", last).alias("priority"))


def customer_history(spark, d):
    return history.segments(observed(spark, d), "o_custkey", "month", ["status"], ["priority"])


#: The history in SQL.
HISTORY = """with o as (select o_custkey, cast(date_trunc('month', o_orderdate) as date) as month, arg_max_null(o_orderstatus, (o_orderdate, o_orderkey)) as status, arg_max_null(o_orderpriority, (o_orderdate, o_orderkey)) as priority from orders group by 1, 2),
    l as (select *, case when lag(status) over w is null or lag(status) over w <> status then 1 else 0 end as opens from o window w as (partition by o_custkey order by month)),
    s as (select *, sum(opens) over (partition by o_custkey order by month rows unbounded preceding) as segment from l),
    g as (select o_custkey, segment, min(month) as valid_from, max(month) as until, count(*) as months, any_value(status) as status, arg_max_null(priority, month) as priority from s group by 1, 2),
    h as (select o_custkey, cast(segment as bigint) as segment, valid_from, months, status, priority, segment = max(segment) over (partition by o_custkey) as is_current, until from g),
    hist as (select o_custkey, segment, valid_from, months, status, priority, is_current, case when not is_current then last_day(until) end as valid_to, md5(o_custkey || '|' || valid_from) as segment_key from h)"""


@query(f"{HISTORY} select * from hist")
def dim_history(spark, d):
    return customer_history(spark, d)


@query(f"""{HISTORY}, late as (select * replace (case when segment % 3 = 1 then valid_to + 400 else valid_to end as valid_to) from hist)
    select a.o_custkey, a.segment, b.segment as next_segment from late a join late b on a.o_custkey = b.o_custkey and a.segment < b.segment and b.valid_from <= coalesce(a.valid_to, date '9999-12-31')""")
def history_overlaps(spark, d):
    """A history of which every third segment ends 400 days too late, so it can overlap several."""
    late = F.when(F.col("segment") % 3 == 1, F.date_add("valid_to", 400)).otherwise(F.col("valid_to"))
    return history.overlaps(customer_history(spark, d).withColumn("valid_to", late), "o_custkey").select("o_custkey", "segment", "next_segment")


@query(f"""{HISTORY}, f as (select o_custkey, cast(date_trunc('month', o_orderdate) as date) as month, count(*) as n, round(sum(o_totalprice), 2) as spent from orders group by 1, 2)
    select f.*, h.segment_key, h.status from f left join hist h on f.o_custkey = h.o_custkey and f.month >= h.valid_from and (h.valid_to is null or f.month <= h.valid_to)""")
def fact_monthly_asof(spark, d):
    facts = table(spark, d, "orders").groupBy("o_custkey", month_start(F.col("o_orderdate").cast("date")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return history.as_of(facts, customer_history(spark, d), "o_custkey", "month", ["segment_key", "status"])


@query(f"""{HISTORY}, f as (select l_orderkey, l_linenumber, o_custkey, cast(l_shipdate as date) as day from lineitem join orders on l_orderkey = o_orderkey)
    select f.*, h.segment_key, h.priority from f left join hist h on f.o_custkey = h.o_custkey and f.day >= h.valid_from and (h.valid_to is null or f.day <= h.valid_to)""")
def fact_event_asof(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"))
    facts = lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return history.as_of(facts, customer_history(spark, d), "o_custkey", "day", ["segment_key", "priority"])


@query(f"""{HISTORY} select status, count(*) as n_orders, round(sum(o_totalprice), 2) as spent from orders o join hist h on o.o_custkey = h.o_custkey and date_trunc('month', o_orderdate) >= valid_from
    and (valid_to is null or date_trunc('month', o_orderdate) <= valid_to) group by 1""")
def spend_by_status(spark, d):
    """What customers spent while their status was such."""
    orders = table(spark, d, "orders").select("o_custkey", "o_totalprice", month_start(F.col("o_orderdate").cast("date")).alias("month"))
    rows = history.as_of(orders, customer_history(spark, d), "o_custkey", "month", ["status"]).where("status is not null")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))


@query("""select md5(name) as entity_key, name, starts_with(name, 'SUPPLIER') as in_group from (select distinct upper(trim(regexp_replace(n, '\\s+', ' ', 'g'))) as name from (select c_name as n from customer union all select '  ' || lower(c_name) || ' ' from customer union all select s_name from supplier))""")
def dim_entity(spark, d):
    customers, suppliers = table(spark, d, "customer").select("c_name"), table(spark, d, "supplier").select("s_name")
    return gold.entities([customers, customers.select(F.concat(F.lit("  "), F.lower("c_name"), F.lit(" ")).alias("n")), suppliers], "SUPPLIER")


@query("""select cast(year(m) * 100 + month(m) as integer) as date_key, cast(year(m) as integer) as year, cast(month(m) as integer) as month, cast(quarter(m) as integer) as quarter, strftime(m, '%Y-%m') as label, cast(m as date) as first_day, last_day(m) as last_day
    from generate_series(date '1995-01-01', date '2001-12-01', interval 1 month) t(m)""")
def dim_calendar(spark, d):
    return gold.calendar(spark, "1995-01-01", "2001-12-01")


@query("""select o_custkey, arg_max_null(case when o_orderpriority = '5-LOW' then null else o_orderpriority end, (o_orderdate, o_orderkey)) as priority, arg_max_null(o_orderstatus, (o_orderdate, o_orderkey)) as status from orders where o_custkey is not null group by 1""")
def dim_latest_attr(spark, d):
    rows = table(spark, d, "orders").withColumns({"priority": F.nullif("o_orderpriority", F.lit("5-LOW")), "status": F.col("o_orderstatus")})
    return gold.latest_attributes(rows, "o_custkey", F.struct("o_orderdate", "o_orderkey"), ["priority", "status"])


LINES = "(select l.*, o_orderdate, o_custkey, o_orderpriority from lineitem l join orders on l_orderkey = o_orderkey)"


def lines(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "orders").drop("o_orderstatus", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query(f"""select l_orderkey, l_linenumber, l_shipdate, cast(case when l_shipdate >= o_orderdate then date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) end as integer) as duration_days,
    coalesce(case when l_tax > 0 then l_tax end, 0) + coalesce(l_discount, 0) as charges from {LINES}""")
def fact_duration(spark, d):
    rows = gold.with_duration(lines(spark, d), "o_orderdate", "l_shipdate")
    return rows.select("l_orderkey", "l_linenumber", "l_shipdate", "duration_days", sum_of(F.when(F.col("l_tax") > 0, F.col("l_tax")), "l_discount").alias("charges"))


@query(f"""select l_returnflag, l_linestatus, o_orderpriority, count(distinct o_custkey) as n_distinct, round(sum(l_quantity), 2) as total from {LINES} group by 1, 2, 3""")
def fact_group_distinct(spark, d):
    out = gold.grouped_distinct(lines(spark, d), ["l_returnflag", "l_linestatus", "o_orderpriority"], "o_custkey", "l_quantity")
    return out.withColumn("total", F.round("total", 2))


AGED = """(select o.o_custkey, cast(date_trunc('month', o_orderdate) as date) as month, o_totalprice, cast(date_diff('month', f.first, date_trunc('month', o_orderdate)) as integer) as age_months from orders o left join
    (select o_custkey, cast(date_trunc('month', min(o_orderdate)) as date) + (case when o_custkey % 10 = 0 then interval 2 month else interval 0 month end) as first from orders where o_custkey % 13 <> 0 group by 1) f using (o_custkey))"""


def aged(spark, d):
    """Orders with the months since their customer's registered first one: some have none, some one that is too late."""
    orders = table(spark, d, "orders").select("o_custkey", month_start(F.col("o_orderdate").cast("date")).alias("month"), "o_totalprice")
    first = orders.where(F.col("o_custkey") % 13 != 0).groupBy("o_custkey").agg(F.min("month").alias("m"))
    first = first.select("o_custkey", F.add_months("m", F.when(F.col("o_custkey") % 10 == 0, 2).otherwise(0)).alias("first"))
    return gold.with_age(orders, "month", first, "o_custkey", "first")


@query(f"select age_months, count(*) as n, count(distinct o_custkey) as customers from {AGED} group by 1")
def cohort_age_months(spark, d):
    return aged(spark, d).groupBy("age_months").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


FIRST = f"""select o_custkey, round(sum(case when age_months < 3 then o_totalprice end), 2) as o_totalprice_3m, round(sum(case when age_months < 6 then o_totalprice end), 2) as o_totalprice_6m,
    round(sum(case when age_months < 12 then o_totalprice end), 2) as o_totalprice_12m, count(*) as months_observed from {AGED} where age_months between 0 and 11 group by 1"""


@query(FIRST)
def mart_first_months(spark, d):
    out = gold.first_months(aged(spark, d), "o_custkey", "age_months", ["o_totalprice"])
    return out.select("o_custkey", *[F.round(f"o_totalprice_{h}m", 2).alias(f"o_totalprice_{h}m") for h in (3, 6, 12)], "months_observed")


TOP = "select o_custkey, o_orderkey, o_orderdate, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1"


@query(TOP)
def mart_top_latest(spark, d):
    return gold.last_of(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query(f"""{HISTORY} select t.o_custkey, t.o_orderkey, c.c_mktsegment, n.n_name, h.status, f.o_totalprice_3m, f.o_totalprice_12m, f.months_observed from ({TOP}) t left join (select * from hist where is_current) h using (o_custkey)
    left join customer c on c.c_custkey = t.o_custkey left join nation n on n.n_nationkey = c.c_nationkey left join ({FIRST}) f using (o_custkey)""")
def mart(spark, d):
    """The last order of each customer with its current segment, attributes and first months."""
    current = customer_history(spark, d).where("is_current").select("o_custkey", "status")
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    out = mart_top_latest(spark, d).join(current, "o_custkey", "left").join(who, "o_custkey", "left")
    out = out.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(mart_first_months(spark, d), "o_custkey", "left")
    return out.select("o_custkey", "o_orderkey", "c_mktsegment", "n_name", "status", "o_totalprice_3m", "o_totalprice_12m", "months_observed")


@query("""select l_orderkey, l_linenumber, case when l_extendedprice > 20000 then 20000.0 else l_extendedprice end as price, round(l_extendedprice / nullif(l_discount, 0), 6) as per_discount, round(l_quantity / nullif(l_tax, 0), 6) as per_tax, cast(year(l_shipdate) as integer) as year, coalesce(nullif(l_returnflag, 'R'), '(none)') as flag from lineitem""")
def features_intensity(spark, d):
    x = table(spark, d, "lineitem")
    return x.select(
        "l_orderkey", "l_linenumber", capped("l_extendedprice", 20000).alias("price"), F.round(ratio("l_extendedprice", "l_discount"), 6).alias("per_discount"), F.round(ratio("l_quantity", "l_tax"), 6).alias("per_tax"),
        F.year("l_shipdate").alias("year"), F.coalesce(F.nullif("l_returnflag", F.lit("R")), F.lit("(none)")).alias("flag"),
    )


@query("""select o_orderkey, round(ln(1 + o_totalprice), 6) as target, round(case when ln(1 + o_totalprice) > ln(1 + 300000.0) then 300000.0 else o_totalprice end, 2) as back from orders""")
def log_target_roundtrip(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(to_target("o_totalprice"), 6).alias("target"), F.round(from_target(to_target("o_totalprice"), 300000), 2).alias("back"))


@query("""with c as (select n_name, c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as balance from customer join nation on c_nationkey = n_nationkey group by 1, 2) select n_name, c_mktsegment as segment, 'n' as kind, cast(n as double) as value from c union all select n_name, c_mktsegment, 'balance', balance from c""")
def crosstab_unpivot(spark, d):
    """A crosstab of nations by segments and kinds, and out of it one row for each cell that has a value."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = rows.groupBy("n_name").pivot("c_mktsegment", segments).agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    long = wide.unpivot(["n_name"], [c for c in wide.columns if c != "n_name"], "cell", "value").where("value is not null")
    return long.select("n_name", F.regexp_extract("cell", "^(.*)_(n|balance)$", 1).alias("segment"), F.regexp_extract("cell", "^(.*)_(n|balance)$", 2).alias("kind"), "value")
