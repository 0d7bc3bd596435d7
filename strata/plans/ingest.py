"""Ingestion: lineage, manifest, selection and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import safe_key
from strata.plans.registry import Registry, table
from strata.sources import catalog, derby, files, jdbc, listing, manifest
from strata.sources.scratch import scratch_path, stored

query = Registry()


def attempts(spark, d):
    """Events as attempts at the resource of their user."""
    status = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "click", "unchanged").otherwise("failed")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("resource_id"), status.alias("status"), F.col("ts").alias("finished_at"), F.col("props").alias("sha256"), F.get_json_object("props", "$.k").cast("long").alias("size"), F.lit("2024").alias("last_modified"), F.get_json_object("props", "$.k").cast("long").alias("bytes"))


ATTEMPTS = """select event_id as id, cast(user_id as varchar) as resource_id, ts as finished_at, props as sha256,
    case event_type when 'purchase' then 'ok' when 'click' then 'unchanged' else 'failed' end as status,
    cast(json_extract(props, '$.k') as bigint) as size, cast(json_extract(props, '$.k') as bigint) as bytes from events"""


@query("""select cast(l_orderkey as varchar) as l_orderkey, cast(l_linenumber as varchar) as l_linenumber, l_returnflag, 'res-1' as _resource_id, 'lineitem' as _resource_name,
    'landing/lineitem' as _landing_key, 'abc' as _source_sha256, date '2024-01-31' as _ingest_date, 'real' as data_origin from lineitem""")
def raw_lineage(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_returnflag")
    return files.with_lineage(rows, "res-1", "lineitem", "landing/lineitem", "abc", "2024-01-31")


@query(f"""select id, resource_id, finished_at from ({ATTEMPTS}) where status = 'ok' qualify row_number() over (partition by resource_id order by finished_at desc, id desc) = 1""")
def manifest_latest_ok(spark, d):
    return manifest.latest_attempts(attempts(spark, d)).select("id", "resource_id", "finished_at")


@query(f"""select id, resource_id, status from ({ATTEMPTS}) where status in ('ok', 'unchanged') qualify row_number() over (partition by resource_id order by finished_at desc, id desc) = 1""")
def landing_latest(spark, d):
    return manifest.latest_attempts(attempts(spark, d), (manifest.OK, manifest.UNCHANGED)).select("id", "resource_id", "status")


@query("""with found as (select cast(c_custkey as varchar) as resource_id, md5(concat_ws('|', c_custkey, c_mktsegment)) as sha256 from customer),
    loaded as (select cast(c_custkey as varchar) as resource_id, case when c_custkey % 5 = 0 then 'old' else md5(concat_ws('|', c_custkey, c_mktsegment)) end as sha256 from customer where c_custkey % 3 <> 0)
    select f.resource_id, f.sha256 from found f left join loaded l using (resource_id) where l.resource_id is null or f.sha256 is distinct from l.sha256""")
def manifest_pending(spark, d):
    sha = F.md5(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_mktsegment"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("resource_id"), sha.alias("sha256"))
    loaded = rows.where(F.col("c_custkey") % 3 != 0).select("resource_id", F.when(F.col("c_custkey") % 5 == 0, "old").otherwise(F.col("sha256")).alias("sha256"))
    return manifest.pending(rows.select("resource_id", "sha256"), loaded)


@query(f"""with last as (select resource_id, size from ({ATTEMPTS}) where status in ('ok', 'unchanged') qualify row_number() over (partition by resource_id order by finished_at desc, id desc) = 1),
    res as (select cast(c_custkey as varchar) as resource_id, case when c_custkey % 4 = 0 then null else c_custkey % 100 end as size from customer)
    select r.resource_id, r.size, case when r.size = l.size then 'unchanged' else 'download' end as decision from res r left join last l using (resource_id)""")
def manifest_decisions(spark, d):
    found = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("resource_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 100).alias("size"), F.lit("2024").alias("last_modified"))
    return manifest.decisions(found, attempts(spark, d)).select("resource_id", "size", "decision")


@query(f"""select status, count(*) as n, cast(sum(bytes) as bigint) as bytes from ({ATTEMPTS}) group by status""")
def manifest_run_summary(spark, d):
    return manifest.run_summary(attempts(spark, d))


@query(f"""select id, resource_id, status from ({ATTEMPTS}) order by finished_at desc, id desc limit 25""")
def manifest_newest(spark, d):
    return manifest.newest(attempts(spark, d), 25).select("id", "resource_id", "status")


RULES = [("^small.*ring", "bronze.small_rings"), ("ring$", "bronze.rings"), ("RED|BLUE", "bronze.primary"), ("widget", "bronze.widgets")]


@query("""select p_partkey, p_name, case when regexp_matches(p_name, '^small.*ring', 'i') then 'bronze.small_rings' when regexp_matches(p_name, 'ring$', 'i') then 'bronze.rings'
    when regexp_matches(p_name, 'RED|BLUE', 'i') then 'bronze.primary' when regexp_matches(p_name, 'widget', 'i') then 'bronze.widgets' end as target from part""")
def resource_routing(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", catalog.route(F.col("p_name"), RULES).alias("target"))


@query("""select p_brand as resource_id, p_name as name, p_partkey as place, p_type as format from part where p_type in ('ECONOMY', 'SMALL', 'PROMO')
    and regexp_matches(p_name, '(?:RED)|(?:^hot)', 'i') and not regexp_matches(p_name, 'gear', 'i') qualify row_number() over (partition by p_brand order by p_partkey) = 1""")
def resource_selection(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("resource_id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("place"), F.col("p_type").alias("format"))
    return catalog.selected(rows, include=["RED", "^hot"], exclude=["GEAR"], formats=["economy", "small", "promo"])


@query("""select substr(sha256('https://example.org/data-' || y || '.csv'), 1, 16) as resource_id, 'orders ' || y as name, 'https://example.org/data-' || y || '.csv' as url, cast(y as integer) as year
    from generate_series(1995, 2001) t(y)""")
def yearly_resources(spark, d):
    return catalog.yearly_resources(spark, "orders", "https://example.org/data-%d.csv", range(1995, 2002))


@query("""select p_partkey, coalesce(nullif(lower(regexp_replace(regexp_replace(strip_accents(p_name || ' ñÁ/' || p_brand), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'resource') as key from part""")
def landing_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", safe_key(F.concat("p_name", F.lit(" ñÁ/"), "p_brand")).alias("key"))


@query("""with u as (select distinct user_id from events), n as (select user_id, row_number() over (order by user_id) - 1 as i from u),
    s as (select s_suppkey, row_number() over (order by s_suppkey) - 1 as j, count(*) over () as m from supplier)
    select user_id, s_suppkey from n join s on i % m = j""")
def round_robin_map(spark, d):
    return catalog.dealt(table(spark, d, "events"), "user_id", table(spark, d, "supplier"), "s_suppkey")


@query("""select p_brand, p_partkey, cast(turn as integer) as turn from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as turn from part) order by turn, p_brand limit 60""")
def quota_pick(spark, d):
    return catalog.picked(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 60)


@query("""select p_type, p_partkey from (select p_type, p_partkey, row_number() over (partition by p_type order by p_partkey) as place from part)
    where place <= case p_type when 'ECONOMY' then 10 when 'SMALL' then 22 when 'PROMO' then 7 else 0 end""")
def class_quotas(spark, d):
    return catalog.within_quotas(table(spark, d, "part").select("p_type", "p_partkey"), "p_type", "p_partkey", {"ECONOMY": 10, "SMALL": 22, "PROMO": 7}).select("p_type", "p_partkey")


@query("""select distinct c_custkey from customer where c_custkey not in (select distinct o_custkey from orders where o_totalprice > 250000)""")
def unmapped_keys(spark, d):
    large = table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").distinct().join(large, "c_custkey", "left_anti")


@query("""select cast(c_custkey as varchar) as c_custkey, case when c_custkey % 7 = 0 then null else c_name end as c_name, cast(c_nationkey as varchar) as c_nationkey from customer""")
def delimited_text(spark, d):
    """A header with a byte order mark and spaces, all columns as text, blanks as nulls."""
    path = scratch_path(spark, "delimited")
    name = F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_name"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("\ufeffc_custkey"), name.alias(" c_name"), F.col("c_nationkey").alias("c_nationkey "))
    rows.write.option("header", True).option("sep", ";").csv(path)
    return files.read_delimited(spark, path, ";")


@query("""select row_number() over (partition by n_regionkey order by n_nationkey) - 1 as place, 'r' || n_nationkey as resource_id, n_name as name, 'https://example.org/' || n_nationkey as url, 'CSV' as format,
    case when n_nationkey % 3 = 0 then null else n_nationkey * 1000 end as size, case when n_nationkey % 2 = 0 then '2024-01-01' else '2023-01-01' end as last_modified from nation""")
def package_resources(spark, d):
    """Catalog packages, one a region: sizes as texts that may be no numbers, and times that may be blank."""
    n = F.col("n_nationkey")
    fields = {
        "id": F.concat(F.lit("r"), n.cast("string")), "name": F.col("n_name"), "url": F.concat(F.lit("https://example.org/"), n.cast("string")), "format": F.lit("csv"),
        "size": F.when(n % 3 == 0, "?").otherwise(F.concat(F.lit(" "), (n * 1000).cast("string"))), "last_modified": F.when(n % 2 == 0, "2024-01-01").otherwise(""), "created": F.lit("2023-01-01"),
    }
    one = F.struct(n.alias("n"), F.struct(*[v.alias(k) for k, v in fields.items()]).alias("r"))
    packages = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(one)).alias("x"))
    body = F.to_json(F.struct(F.struct(F.col("x.r").alias("resources")).alias("result")))
    path = scratch_path(spark, "packages")
    packages.select(body.alias("value")).repartition(5, "value").write.text(path)
    out = catalog.package_resources_by_line(spark, path)
    return out.withColumn("place", F.col("place").cast("long"))


@query("""select event_id, case when event_type = 'click' then 'unchanged' else 'ok' end as status from events where event_type in ('click', 'view')""")
def download_status(spark, d):
    """A download with the hash of the last good attempt is unchanged."""
    rows = table(spark, d, "events").where("event_type in ('click', 'view')")
    return manifest.after_download(rows.select("event_id", F.col("event_type").alias("sha256"), F.lit("click").alias("last_sha256"))).select("event_id", "status")


@query("""with a as (select event_id % 1000 as id, ts as finished_at, event_type as status, event_id from events) select id, finished_at, status from a qualify row_number() over (partition by id order by finished_at desc) = 1""")
def attempts_resolved(spark, d):
    """One row an attempt: the last of those written for it."""
    rows = table(spark, d, "events").select((F.col("event_id") % 1000).alias("id"), F.col("ts").alias("finished_at"), F.col("event_type").alias("status"), F.lit("x").alias("error"))
    return manifest.resolved(rows).select("id", "finished_at", "status")


@query("""select event_id, cast(json_extract(props, '$.k') as bigint) as k from events""")
def events_parsed(spark, d):
    """JSON events by their schema; those cut short give nulls."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.LongType())])
    body = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(','), F.substring("props", 2, 1000))
    return files.parsed_events(table(spark, d, "events").select(body.alias("value")), "value", schema)


@query("""select c_custkey, c_mktsegment from customer where c_nationkey = 3 and c_acctbal > 1000""")
def projected_scan(spark, d):
    return table(spark, d, "customer").where("c_nationkey = 3 and c_acctbal > 1000").select("c_custkey", "c_mktsegment")


@query("""select distinct o_custkey from orders where o_totalprice > 200000 order by o_custkey limit 20""")
def first_ids(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 200000").select("o_custkey").distinct().orderBy("o_custkey").limit(20)


@query("""select event_id, ts, user_id from events where ts >= (select max(ts) from events) - interval 24 hour""")
def event_lookback(spark, d):
    return files.lookback(table(spark, d, "events").select("event_id", "ts", "user_id"), "ts", 24)


@query("""select event_id, cast(json_extract(props, '$.k') as bigint) as k from events""")
def json_decode(spark, d):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.LongType())])
    rows = table(spark, d, "events").select("event_id", F.from_json("props", schema).alias("e"))
    return rows.select("event_id", "e.k")


@query("""select event_id, '{"event_id":' || event_id || case when value > 50 then '' else ',"user_id":' || user_id end || ',"type":"' || event_type || '"}' as body from events""")
def sparse_events(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(~(F.col("value") > 50), F.col("user_id")).alias("user_id"), F.col("event_type").alias("type"))
    return rows.select("event_id", files.sparse_json([F.col("event_id"), F.col("user_id"), F.col("type")]).alias("body"))


@query(f"""select id, resource_id, finished_at from ({ATTEMPTS}) where status = 'ok' qualify row_number() over (partition by resource_id order by finished_at desc, id desc) = 1""")
def jdbc_latest(spark, d):
    """The attempts written to databases, each with a part of the resources and a million attempts at most as a rule, and the latest good ones
    read back by a task a database."""
    rows = attempts(spark, d).select("id", "resource_id", "status", "finished_at")
    types = "id bigint, resource_id varchar(40), status varchar(20), finished_at timestamp"
    urls = derby.packed(rows, "resource_id", "attempts", types, "resource_id, status, finished_at, id", max(8, -(-rows.count() // 1_000_000)))
    found = [jdbc.latest_attempts(spark, {"url": u, "driver": derby.DRIVER, "preferTimestampNTZ": "true"}, "attempts", fields=("id", "resource_id", "finished_at"), tasks=1) for u in urls]
    # names that aren't quoted are upper case in this database
    found = reduce(DataFrame.union, found) if found else rows.select([F.col(c).alias(c.upper()) for c in rows.columns])
    return found.select(F.col("ID").alias("id"), F.col("RESOURCE_ID").alias("resource_id"), F.col("FINISHED_AT").cast("timestamp_ntz").alias("finished_at"))


@query("""with f as (select p_type as class, p_brand as owner, p_size % 2 as part, string_agg(p_partkey || ',' || p_name || chr(10), '' order by p_partkey) as content from part group by 1, 2, 3),
    n as (select class, owner, class || '/' || owner || '/' || part as resource_id, strlen(content) as size, sha1('blob ' || strlen(content) || chr(0) || content) as sha, cast(split_part(owner, '#', 2) as integer) as b from f where owner like 'Brand#%'),
    t as (select *, row_number() over (partition by class, owner order by resource_id) as turn from n), q as (select *, row_number() over (partition by class order by turn, owner) as place from t)
    select resource_id, size, sha, case when b % 3 = 0 then 'unchanged' else 'download' end as decision from q where place <= case class when 'ECONOMY' then 30 when 'SMALL' then 7 when 'MEDIUM' then 12 else 0 end""")
def fetch_listing(spark, d):
    """The parts as files by type, brand and kind of size: those listed by hash and chosen by quota, and whether they are landed. Of the brands,
    a third are landed as they are, a third in another size, and the rest not."""
    root = f"{scratch_path(spark, 'remote')}/files"
    rows = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("class"), F.col("p_brand").alias("owner"), (F.col("p_size") % 2).alias("part"), F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name").alias("value"))
    dealt = rows.repartition("class", "owner", "part").sortWithinPartitions("class", "owner", "part", "p_partkey")
    dealt.drop("p_partkey").write.partitionBy("class", "owner", "part").text(root)
    at = lambda c: F.url_decode(F.regexp_extract("path", f"/{c}=([^/]*)/", 1))
    files = listing.listed(spark, root, "part-*").select("size", "sha", *[at(c).alias(c) for c in ("class", "owner", "part")])
    files = files.withColumn("resource_id", F.concat_ws("/", "class", "owner", "part"))
    files = stored(listing.chosen(files, "class", "owner", "resource_id", {"ECONOMY": 30, "SMALL": 7, "MEDIUM": 12}), "listing")
    kind = F.split_part("owner", F.lit("#"), F.lit(2)).cast("int") % 3
    before = files.where(kind < 2).withColumn("landing_key", F.concat(F.lit("3/"), "resource_id"))
    log = before.select(
        F.lit(1).cast("long").alias("id"), "resource_id", F.lit(manifest.OK).alias("status"), F.col("sha").alias("last_modified"), "landing_key", F.col("size").alias("bytes"),
        F.lit("2024-01-01").cast("timestamp").alias("finished_at"),
    )
    landed = before.select("landing_key", (F.col("size") - F.when(kind == 1, 1).otherwise(0)).alias("size"))
    return listing.fetch_decisions(files, log, landed).select("resource_id", "size", "sha", "decision")
