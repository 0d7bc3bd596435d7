"""Boosted trees, their attributions and the exact baselines, on the orders; the SQL grows the same trees table by table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strata.ml import baselines, boosting, folds
from strata.operators import metrics
from strata.plans.registry import Registry, table
from strata.sources.scratch import stored

query = Registry()

LABELS = ["F", "O", "P"]
HOW = boosting.Boosting(rounds=2, depth=2, bins=8, least_rows=5, smooth=10.0)
NUMBERS, CATEGORIES = ["price", "month"], ["o_orderpriority"]


def orders(spark, d):
    """Orders with a price that is missing for a fifth of the customers, and the month."""
    price = F.when(F.col("o_custkey") % 5 > 0, F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", price.alias("price"), F.month("o_orderdate").cast("double").alias("month"))


_ROWS = "select o_orderkey as id, o_orderstatus as label, o_orderpriority as c, case when o_custkey % 5 > 0 then o_totalprice end as price, month(o_orderdate)::double as month from orders"
_PART = "({g} / 1048576::double) * ({g} / 1048576::double) / ({h} / 1048576::double + 0)"


def _round(r: int) -> str:
    """The tables of a round: g{r} (derivatives), then by level n (nodes of rows), s (sums), b (splits), and x{r + 1} with the new scores."""
    exps = [f"exp(s{k} - greatest(s0, s1, s2))" for k in range(3)]
    p = [f"{e} / (0.0::double + {exps[0]} + {exps[1]} + {exps[2]})" for e in exps]
    each = " union all ".join(
        f"select id, {k} as k, round((p{k} - case when y = {k} then 1::double else 0::double end) * 1048576)::bigint as g, round(p{k} * (1 - p{k}) * 1048576)::bigint as h from p{r}" for k in range(3)
    )
    out = [f"p{r} as (select *, {', '.join(f'{e} as p{k}' for k, e in enumerate(p))} from x{r})", f"g{r} as ({each})", f"n{r}_0 as (select id, k, g, h, 0 as node, true as open from g{r})"]
    for level in (0, 1):
        t = f"{r}_{level}"
        gain = f"{_PART.format(g='lg', h='lh')} + {_PART.format(g='(tg - lg)', h='(th - lh)')} - {_PART.format(g='tg', h='th')}"
        w = "(partition by k, node, f order by mean, bin rows unbounded preceding)"
        goes = f"case when bin < 0 then ml when b{t}.f = 2 then list_contains(lefts, bin) else bin <= cut end"
        out += [
            f"s{t} as (select k, node, f, bin, sum(g)::bigint as g, sum(h)::bigint as h, count(*) as n from n{t} join bins using (id) where open group by 1, 2, 3, 4)",
            f"w{t} as (select k, node, sum(g)::bigint as tg, sum(h)::bigint as th, sum(n)::bigint as tn from s{t} where f = 0 group by 1, 2)",
            f"m{t} as (select *, case when f = 2 then g / (h + 10 * 1048576::double) else 0 end as mean from s{t} where bin >= 0)",
            f"u{t} as (select *, sum(g) over {w} as cg, sum(h) over {w} as ch, sum(n) over {w} as cn, row_number() over (partition by k, node, f order by mean, bin) as place, list(bin) over {w} as lefts from m{t})",
            f"v{t} as (select u.*, coalesce(z.g, 0) as mg, coalesce(z.h, 0) as mh, coalesce(z.n, 0) as mn, tg, th, tn from u{t} u left join s{t} z on z.k = u.k and z.node = u.node and z.f = u.f and z.bin < 0 join w{t} w on w.k = u.k and w.node = u.node)",
            f"c{t} as (select *, cg + case when side then mg else 0 end as lg, ch + case when side then mh else 0 end as lh, cn + case when side then mn else 0 end as ln from v{t}, (select unnest([true, false]) as side) where mn > 0 or not side)",
            f"d{t} as (select *, {gain} as gain, case when mn > 0 then side else ln >= tn - ln end as ml from c{t} where least(ln, tn - ln) >= 5 and least(lh, th - lh) >= 0.001 * 1048576::double)",
            f"b{t} as (select k, node, f, bin as cut, lefts, ml, ln, tn from d{t} where gain > 0 qualify row_number() over (partition by k, node order by gain desc, f, place, ml desc) = 1)",
            f"n{r}_{level + 1} as (select n.id, n.k, n.g, n.h, case when b{t}.f is null then n.node when {goes} then 2 * n.node + 1 else 2 * n.node + 2 end as node, b{t}.f is not null as open "
            f"from n{t} n left join b{t} on b{t}.k = n.k and b{t}.node = n.node and n.open left join bins on bins.id = n.id and bins.f = b{t}.f)",
        ]
    value = "(-0.1::double * sum(g)) / sum(h)"
    out.append(f"l{r} as (select k, node, {value} as value, count(*) as n from n{r}_2 group by 1, 2)")
    out.append(f"a{r} as (select id, max(value) filter (where k = 0) as a0, max(value) filter (where k = 1) as a1, max(value) filter (where k = 2) as a2 from n{r}_2 join l{r} using (k, node) group by 1)")
    out.append(f"x{r + 1} as (select id, y, {', '.join(f's{k} + a{k} as s{k}' for k in range(3))} from x{r} join a{r} using (id))")
    return ",\n".join(out)


_BIN = "(select count(*) from e where e.f = {f} and e.e < {v})"
TREES = f"""with d as ({_ROWS}),
q as (select 0 as f, unnest(quantile_disc(price, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1])) as e from d union select 1, unnest(quantile_disc(month, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1])) from d),
e as (select distinct q.f, q.e from q join (select f, max(e) as top from q group by 1) t on t.f = q.f and q.e < top),
cats as (select c, row_number() over (order by c) - 1 as bin from (select distinct c from d)),
bins as (select id, 0 as f, case when price is null then -1 else {_BIN.format(f=0, v='price')} end as bin from d union all select id, 1, case when month is null then -1 else {_BIN.format(f=1, v='month')} end from d
    union all select id, 2, coalesce(bin, -1) from d left join cats using (c)),
x0 as (select id, list_position({LABELS}, label) - 1 as y, {', '.join(f"ln((select count(*) filter (where label = '{x}') from d)::double / (select count(*) from d))::double as s{k}" for k, x in enumerate(LABELS))} from d),
{_round(0)},
{_round(1)}"""


def _model(spark, d):
    rows = orders(spark, d)
    return rows, boosting.fit(rows, "o_orderstatus", NUMBERS, CATEGORIES, LABELS, how=HOW)


@query(f"""{TREES} select id as o_orderkey, {LABELS}[list_position([s0, s1, s2], greatest(s0, s1, s2))] as predicted, {', '.join(f"round(s{k}, 6) as s{k}" for k in range(3))} from x2""")
def boosted_classes(spark, d):
    """Two rounds of trees of depth two for the status of orders: missing prices learn their side, priorities are a category."""
    rows, model = _model(spark, d)
    scores = model.scores(F.col("bins"))
    out = model.transform(rows).withColumn("bins", model.binned()).withColumn("s", scores)
    return out.select("o_orderkey", F.col("prediction").alias("predicted"), *[F.round(F.get("s", F.lit(k)), 6).alias(f"s{k}") for k in range(3)])


def _worth() -> str:
    """val: by row, score and set of known features (a bit each), what the trees say if the others go both ways."""
    parts = []
    for r in (0, 1):
        have = f"(select d.id, kk.k, sets.known, 0 as node, 1::double as share, true as open from d, (select unnest([0, 1, 2]) as k) kk, (select unnest(range(8)) as known) sets)"
        for level in (0, 1):
            t = f"{r}_{level}"
            goes = f"case when bin < 0 then ml when b.f = 2 then list_contains(lefts, bin) else bin <= cut end"
            way = f"case when known & (1 << b.f) > 0 then case when ({goes}) = l then 1 else 0 end when l then ln / tn else (tn - ln) / tn end"
            have = (
                f"(select h.id, h.k, known, case when b.f is null then h.node when l then 2 * h.node + 1 else 2 * h.node + 2 end as node, share * case when b.f is null then 1 else {way} end as share, b.f is not null as open "
                f"from {have} h left join b{t} b on b.k = h.k and b.node = h.node and h.open left join bins on bins.id = h.id and bins.f = b.f, (select unnest([true, false]) as l) s where l or b.f is not null)"
            )
        parts.append(f"select h.id, h.k, known, sum(share * value) as v from {have} h join l{r} on l{r}.k = h.k and l{r}.node = h.node group by 1, 2, 3")
    return "val as (select id, k, known, sum(v) as v from (" + " union all ".join(parts) + ") group by 1, 2, 3)"


@query(f"""{TREES}, {_worth()},
    phi as (select a.id, a.k, f, sum((b.v - a.v) * case bit_count(a.known) when 1 then 1 / 6::double else 1 / 3::double end) as phi from val a, (select unnest([0, 1, 2]) as f) fs
        join val b on b.id = a.id and b.k = a.k and b.known = a.known | (1 << f) where a.known & (1 << f) = 0 group by 1, 2, 3)
    select ['price', 'month', 'o_orderpriority'][f + 1] as feature, {LABELS}[k + 1] as label, round(avg(abs(phi)), 6) as mean_abs, round(max(phi), 6) as most, round(min(phi), 6) as least from phi group by 1, 2""")
def tree_attributions(spark, d):
    """How much each feature moves the scores of the boosted trees; the SQL goes through all sets of known features."""
    rows, model = _model(spark, d)
    names = F.array(*map(F.lit, model.features))
    # stored, as Spark takes a function of grouping columns to the rows before they are grouped
    kinds = stored(rows.groupBy(model.binned().alias("bins")).agg(F.count(F.lit(1)).alias("n")), "kinds")
    each = model.attributions(kinds, bins=F.col("bins")).select("n", F.posexplode("attributions").alias("k", "by_feature")).select("n", "k", F.posexplode("by_feature").alias("f", "phi"))
    phi = each.groupBy("k", "f").agg(F.round(F.sum(F.abs("phi") * F.col("n")) / F.sum("n"), 6).alias("mean_abs"), F.round(F.max("phi"), 6).alias("most"), F.round(F.min("phi"), 6).alias("least"))
    return phi.select(F.get(names, F.col("f")).alias("feature"), F.get(F.array(*map(F.lit, LABELS)), F.col("k")).alias("label"), "mean_abs", "most", "least")


_FOLDS = "(select *, cast(o_custkey % 4 as integer) as fold from orders)"


@query(f"""with r as (select o_orderkey, fold, o_orderstatus as label, case when o_custkey % 5 > 0 then o_totalprice end as v from {_FOLDS}),
    h as (select unnest([0, 1, 2, 3]) as held), f as (select held, quantile_cont(v, 0.5) as fill from h join r on fold <> held group by 1),
    x as (select held, label, coalesce(v, fill) as x from f join r on fold <> held), t as (select held, label, count(*) as n from x group by 1, 2),
    c as (select held, x, count(*) filter (where label = 'F') as c0, count(*) filter (where label = 'O') as c1, count(*) filter (where label = 'P') as c2 from x group by 1, 2),
    u as (select *, [{', '.join(f"sum(c{i}) over w / sum(c{i}) over (partition by held)" for i in range(3))}] as l, [{', '.join(f"(sum(c{i}) over (partition by held) - sum(c{i}) over w) / sum(c{i}) over (partition by held)" for i in range(3))}] as r,
        lead(x) over (partition by held order by x) as nx from c window w as (partition by held order by x rows unbounded preceding)),
    b as (select held, arg_max((x + nx) / 2, (round((list_sum(list_transform(l, lambda a: a * a)) / list_sum(l) + list_sum(list_transform(r, lambda a: a * a)) / list_sum(r)), 12), -x)) as threshold,
        arg_max((list_position(l, list_max(l)), list_position(r, list_max(r))), (round((list_sum(list_transform(l, lambda a: a * a)) / list_sum(l) + list_sum(list_transform(r, lambda a: a * a)) / list_sum(r)), 12), -x)) as sides from u where nx is not null group by 1)
    select o_orderkey, fold, {LABELS}[case when coalesce(v, fill) > threshold then sides[2] else sides[1] end] as predicted from r join b on b.held = fold join f on f.held = fold""")
def threshold_baseline(spark, d):
    """For each fold, the best single threshold on the price that the other folds give."""
    rows = orders(spark, d).join(table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).cast("int").alias("fold")), "o_orderkey")
    return baselines.out_of_fold_stump(rows, "price", "o_orderstatus", 4).select("o_orderkey", "fold", "predicted")


_SUMS = "select held, count(*)::double as n, sum(x) as x, sum(z) as z, sum(y) as y, sum(x * x) as xx, sum(x * z) as xz, sum(z * z) as zz, sum(x * y) as xy, sum(z * y) as zy from filled group by 1"


@query(f"""with r as (select p_partkey, p_partkey % 3 as fold, case when p_partkey % 10 > 0 then p_size end::double as x, (p_partkey % 100)::double as z, p_retailprice as y from part), h as (select unnest([0, 1, 2]) as held),
    f as (select held, quantile_cont(x, 0.5) as fill from h join r on fold <> held group by 1), filled as (select held, coalesce(r.x, fill) as x, z, y from f join r on fold <> held), s as ({_SUMS}),
    c as (select held, xx - x * x / n as a, xz - x * z / n as b, zz - z * z / n as d, xy - x * y / n as e, zy - z * y / n as g, x / n as mx, z / n as mz, y / n as my from s),
    w as (select held, (e * d - b * g) / (a * d - b * b) as wx, (a * g - b * e) / (a * d - b * b) as wz, mx, mz, my from c)
    select p_partkey, cast(fold as integer) as fold, round(my + wx * (coalesce(x, fill) - mx) + wz * (z - mz), 4) as predicted from r join f on f.held = fold join w on w.held = fold""")
def linear_baseline(spark, d):
    """For each fold, the linear model of the other folds, a tenth of the sizes missing."""
    size = F.when(F.col("p_partkey") % 10 > 0, F.col("p_size").cast("double")).alias("size")
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 3).cast("int").alias("fold"), size, (F.col("p_partkey") % 100).cast("double").alias("serial"), "p_retailprice")
    return baselines.out_of_fold_linear(rows, ["size", "serial"], "p_retailprice", 3).select("p_partkey", "fold", F.round("prediction", 4).alias("predicted"))


#: The early stop ends it, or else so many rounds as the reference's classifier has; bins for every size, serial and type.
LEARNED = boosting.Boosting(rounds=300, depth=5, bins=255, least_rows=50, patience=20)


def ml_boosted_oof(spark, d):
    """Out-of-fold metrics of boosted trees with missing values and an early stop for the price of parts. No SQL: it trains many trees."""
    size = F.when(F.col("p_partkey") % 10 > 0, F.col("p_size").cast("double")).alias("size")
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", size, (F.col("p_partkey") % 100).cast("double").alias("serial"), "p_retailprice")
    # rows that look alike are held out together, or the stop would be judged by copies of what was learned
    alike = F.xxhash64("size", "serial", "p_type").alias("alike")
    rows = stored(folds.with_folds(part.select("*", alike), "p_brand", 3), "folds")
    models = boosting.fit_folds(rows, 3, "p_retailprice", ["size", "serial"], ["p_type"], key="alike", how=LEARNED)
    held = [model.transform(rows.where(F.col("fold") == k)) for k, model in enumerate(models)]
    return reduce(lambda a, b: a.unionByName(b), held).groupBy("fold").agg(*metrics.regression(F.col("p_retailprice"), F.col("prediction")))


query.queries["ml_boosted_oof"] = ml_boosted_oof
