"""Folds, metrics, models and alerts, on the parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.columns import from_target, to_target
from strata.ml import folds, models
from strata.operators import alarms, metrics, running
from strata.plans.registry import Registry, table
from strata.sources.scratch import stored

query = Registry()

# a recursion over the brands from the largest down: each goes to the lightest of five folds, whose rows are in s0 to s4
FOLDS = """(with recursive g as (select p_brand, n, row_number() over (order by n desc, p_brand) as i from (select p_brand, count(*) as n from part group by 1)),
    f as (select 0::bigint as i, [0, 0, 0, 0, 0]::bigint[] as s, -1 as fold union all
        select g.i, list_transform(s, lambda x, j: x + case when j = list_position(s, list_min(s)) then n else 0 end), list_position(s, list_min(s)) - 1 from f join g on g.i = f.i + 1)
    select p_brand, n, cast(fold as integer) as fold from g join f using (i))"""


@query(f"select * from {FOLDS}")
def group_folds(spark, d):
    return folds.group_folds(table(spark, d, "part"), "p_brand", 5)


@query(f"""with r as (select p_partkey, p_retailprice, fold from part join {FOLDS} using (p_brand)), m as (select a.fold, quantile_cont(b.p_retailprice, 0.5) as predicted from (select distinct fold from r) a join r b on a.fold <> b.fold group by 1)
    select p_partkey, fold, round(predicted, 6) as predicted from r join m using (fold)""")
def oof_median(spark, d):
    rows = folds.out_of_fold_median(folds.with_folds(table(spark, d, "part"), "p_brand", 5), "p_retailprice", 5)
    return rows.select("p_partkey", "fold", F.round("predicted", 6).alias("predicted"))


@query("""select event_type, probability, round(quantile, 6) as quantile from (select event_type, unnest([0.1, 0.25, 0.5, 0.9, 1.0])::double as probability, unnest(q) as quantile
    from (select event_type, quantile_cont(value, [0.1, 0.25, 0.5, 0.9, 1.0]) as q from events group by 1))""")
def exact_quantiles(spark, d):
    out = running.exact_quantiles(table(spark, d, "events"), ["event_type"], "value", [0.1, 0.25, 0.5, 0.9, 1.0])
    return out.select("event_type", "probability", F.round("quantile", 6).alias("quantile"))


TRUTH = "(select event_id, user_id, case event_type when 'purchase' then 'event' when 'click' then 'transient' else 'normal' end as truth, case when value > 40 then 'event' when value > 20 then 'transient' else 'normal' end as predicted from events)"
LABELS = ["normal", "transient", "event"]


def judged(spark, d):
    """Events by type as the truth, and a rule on the value as the prediction."""
    truth = F.when(F.col("event_type") == "purchase", "event").when(F.col("event_type") == "click", "transient").otherwise("normal")
    rule = F.when(F.col("value") > 40, "event").when(F.col("value") > 20, "transient").otherwise("normal")
    return table(spark, d, "events").select("event_id", "user_id", truth.alias("truth"), rule.alias("predicted"))


@query(f"select truth, count(*) filter (where predicted = 'normal') as as_normal, count(*) filter (where predicted = 'transient') as as_transient, count(*) filter (where predicted = 'event') as as_event from {TRUTH} group by 1")
def confusion_matrix(spark, d):
    return metrics.confusion(judged(spark, d), "truth", "predicted", LABELS)


METRICS = f"""(with l as (select unnest(['normal', 'transient', 'event', 'absent']) as label), c as (select label, count(*) filter (where truth = label and predicted = label) as hit, count(*) filter (where truth = label) as support, count(*) filter (where predicted = label) as found from l cross join {TRUTH} group by 1),
    p as (select *, case when found > 0 then hit / found else 0 end as precision, case when support > 0 then hit / support else 0 end as recall from c) select label, precision, recall, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1, support from p)"""


@query(f"select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from {METRICS}")
def class_metrics(spark, d):
    out = metrics.class_metrics(judged(spark, d), "truth", "predicted", [*LABELS, "absent"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"select round(avg(f1), 6) as macro_f1 from {METRICS}")
def macro_f1(spark, d):
    return metrics.macro_f1(judged(spark, d), "truth", "predicted", [*LABELS, "absent"]).select(F.round("macro_f1", 6).alias("macro_f1"))


@query("""select p_size, round(avg(abs(p_retailprice - (900 + p_partkey % 1000))), 6) as mae, round(sqrt(avg(pow(p_retailprice - (900 + p_partkey % 1000), 2))), 6) as rmse,
    round(1 - sum(pow(p_retailprice - (900 + p_partkey % 1000), 2)) / nullif(var_pop(p_retailprice) * count(*), 0), 4) as r2 from part group by 1""")
def regression_metrics(spark, d):
    mae, rmse, r2 = metrics.regression(F.col("p_retailprice"), (900 + F.col("p_partkey") % 1000).cast("double"))
    out = table(spark, d, "part").groupBy("p_size").agg(mae, rmse, r2)
    return out.select("p_size", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round("r2", 4).alias("r2"))


@query("""with v as (select p_type, row_number() over (order by p_type) - 1 as i from (select distinct p_type from part where p_partkey % 2 = 0 and p_type <> 'SMALL')) select p_partkey, coalesce(i, -1) as code from part left join v using (p_type)""")
def ordinal_codes(spark, d):
    part = table(spark, d, "part")
    return models.ordinal(part.select("p_partkey", "p_type"), part.where("p_partkey % 2 = 0 and p_type <> 'SMALL'"), "p_type").select("p_partkey", "code")


@query("""with v as (select p_retailprice, row_number() over (order by md5('3|' || p_partkey), p_partkey) as i from part),
    k as (select p_partkey, row_number() over (order by p_partkey) as i from part) select p_partkey, p_retailprice from k join v using (i)""")
def permuted_column(spark, d):
    """The values of a column dealt anew, as permutation importance does it."""
    return folds.permuted(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", 3)


@query("select p_type as predicted, count(*) as n from part group by 1 order by n desc, 1 limit 1")
def majority_label(spark, d):
    part = table(spark, d, "part")
    return models.majority(part, "p_type").join(part.groupBy(F.col("p_type").alias("predicted")).agg(F.count(F.lit(1)).alias("n")), "predicted")


@query("select p_partkey, round(count(*) over () / ((select count(distinct p_type) from part) * count(*) over (partition by p_type)), 6) as weight from part")
def class_weights(spark, d):
    return folds.with_weights(table(spark, d, "part"), "p_type").select("p_partkey", F.round("weight", 6).alias("weight"))


@query("""with r as (select p_size % 5 as fold, ln(1 + p_retailprice) as t, ln(1 + 900 + p_partkey % 1000) as p from part), s as (select 'log' as scale, fold, t, p from r union all select 'plain', fold, exp(t) - 1, exp(p) - 1 from r),
    m as (select scale, fold, avg(abs(t - p)) as mae, sqrt(avg(pow(t - p, 2))) as rmse, 1 - sum(pow(t - p, 2)) / nullif(var_pop(t) * count(*), 0) as r2 from s group by 1, 2)
    select scale, fold, round(mae, 6) as mae, round(rmse, 6) as rmse, round(r2, 3) as r2 from m union all select scale, null, round(avg(mae), 6), round(avg(rmse), 6), round(avg(r2), 3) from m group by 1""")
def fold_metrics(spark, d):
    rows = table(spark, d, "part").select((F.col("p_size") % 5).alias("fold"), to_target("p_retailprice").alias("t"), to_target((900 + F.col("p_partkey") % 1000).cast("double")).alias("p"))
    out = metrics.log_and_plain(rows, "t", "p", "fold", from_target)
    return out.select("scale", "fold", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"), F.round("r2", 3).alias("r2"))


@query("""select event_id, user_id, predicted, greatest(1.0 - value / 60, value / 60) as probability, 'v1' as model_version from (select *, case when value > 40 then 'event' when value > 20 then 'transient' else 'normal' end as predicted from events) where predicted <> 'normal'""")
def alert_assembly(spark, d):
    rows = judged(spark, d).drop("truth").join(table(spark, d, "events").select("event_id", "value"), "event_id")
    share = F.col("value") / 60
    return alarms.alerts(rows, "predicted", F.array(1 - share, share), "v1", F.lit("2024-02-01").cast("timestamp")).select("event_id", "user_id", "predicted", "probability", "model_version")


def ml_gbt_oof(spark, d):
    """Out-of-fold metrics of boosted trees, a linear model and the median for the price of parts. No SQL: it trains."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("double").alias("p_size"), (F.col("p_partkey") % 100).cast("double").alias("serial"), "p_retailprice")
    # each fit reads its rows many times
    part = stored(folds.with_folds(part, "p_brand", 3), "folds")
    features = models.Features(("p_size", "serial"), ("p_type",))
    name, estimator = next(iter(models.regressors("p_retailprice", {"maxDepth": (4,), "maxIter": (5,)}).items()))
    out = None
    for label, rows in ((name, models.out_of_fold(part, features, estimator, 3)), ("linear", models.out_of_fold(part, features, models.linear("p_retailprice"), 3)), ("median", folds.out_of_fold_median(part, "p_retailprice", 3).withColumnRenamed("predicted", "prediction"))):
        one = rows.agg(*metrics.regression(F.col("p_retailprice"), F.col("prediction"))).withColumn("model", F.lit(label))
        out = one if out is None else out.union(one)
    return out


query.queries["ml_gbt_oof"] = ml_gbt_oof
