import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata.functions import columns
from strata.ml import folds, models
from strata.operators import alarms, checks, gold, history, metrics, sliding

D = dt.date


def test_history_of_values_that_return_and_months_without(spark):
    rows = [(1, D(2020, 1, 1), "A", "x"), (1, D(2020, 2, 1), "B", None), (1, D(2020, 5, 1), "A", "y"), (1, D(2020, 6, 1), "A", None), (2, D(2020, 1, 1), None, "p"), (2, D(2020, 3, 1), None, "q"), (3, D(2020, 1, 1), None, "z"), (3, D(2020, 2, 1), "C", "z")]
    h = history.segments(spark.createDataFrame(rows, "id int, month date, state string, note string"), "id", "month", ["state"], ["note"])
    got = sorted((r["id"], r["segment"], r["valid_from"], r["valid_to"], r["state"], r["note"], r["months"]) for r in h.collect())
    assert got[:3] == [(1, 1, D(2020, 1, 1), D(2020, 1, 31), "A", "x", 1), (1, 2, D(2020, 2, 1), D(2020, 2, 29), "B", None, 1), (1, 3, D(2020, 5, 1), None, "A", None, 2)]
    assert [g[1:5] for g in got[3:]] == [(1, D(2020, 1, 1), None, None), (1, D(2020, 1, 1), D(2020, 1, 31), None), (2, D(2020, 2, 1), None, "C")]
    assert history.overlaps(h, "id").count() == 0
    facts = spark.createDataFrame([(1, D(2020, 1, 31)), (1, D(2020, 3, 9)), (1, D(2031, 1, 1)), (9, D(2020, 1, 1)), (1, D(2019, 12, 31))], "id int, day date")
    found = {(r["id"], r["day"]): r["state"] for r in history.as_of(facts, h, "id", "day", ["state"]).collect()}
    assert found == {(1, D(2020, 1, 31)): "A", (1, D(2020, 3, 9)): None, (1, D(2031, 1, 1)): "A", (9, D(2020, 1, 1)): None, (1, D(2019, 12, 31)): None}


def test_overlaps_are_found(spark):
    h = spark.createDataFrame([(1, 1, D(2020, 1, 1), D(2020, 3, 31)), (1, 2, D(2020, 3, 1), None)], "id int, segment int, valid_from date, valid_to date")
    assert history.overlaps(h, "id").count() == 1


def test_caps_and_ratios_keep_nulls(spark):
    row = spark.createDataFrame([(float("nan"), None, 5.0, 0.0)], "a double, b double, c double, z double").select(
        columns.capped("a", 3).alias("a"), columns.capped("b", 3).alias("b"), columns.capped("c", 3).alias("c"), columns.ratio("c", "z").alias("r"), columns.sum_of("b", "c").alias("s"), columns.from_target(F.lit(None).cast("double")).alias("t"), columns.from_target(F.lit(99.0), 10).alias("top"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["r"], row["s"], row["t"]) == (None, None, 3.0, None, 5.0, None)
    assert row["top"] == pytest.approx(10)


def test_names_and_keys(spark):
    row = spark.createDataFrame([(" Compañía   Ñandú\t", "t ", "", "2020-05-02", "2020-05-02")], "n string, f string, e string, a string, b string").select(columns.fold("n"), columns.flag("f"), columns.safe_key("n"), columns.safe_key("e"), columns.days_between(F.col("a").cast("date"), F.col("b").cast("date")), columns.days_between(F.lit("2020-01-02").cast("date"), F.lit("2020-01-01").cast("date")), columns.blank_to_null("e")).first()
    assert tuple(row) == ("COMPANIA NANDU", True, "compania-nandu", "resource", 0, None, None)


def test_entities_and_calendar(spark):
    a, b = spark.createDataFrame([("Acme  Co",), (None,)], "n string"), spark.createDataFrame([(" acme co ",), ("Group X",)], "m string")
    assert sorted((r["name"], r["in_group"]) for r in gold.entities([a, b], "GROUP").collect()) == [("ACME CO", False), ("GROUP X", True)]
    months = gold.calendar(spark, "2023-11-01", "2024-02-01").orderBy("date_key").collect()
    assert [r["date_key"] for r in months] == [202311, 202312, 202401, 202402] and months[-1]["last_day"] == D(2024, 2, 29) and months[0]["label"] == "2023-11"


def test_checks_pass_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (1, None), (None, "z"), (None, "a")], "id int, kind string")
    assert checks.unique(rows, "id").count() == 1
    assert checks.accepted(rows, "kind", ["a"]).collect()[0]["kind"] == "z"
    assert checks.relationship(rows, "id", spark.createDataFrame([(2,)], "k int"), "k").count() == 1
    assert checks.freshness(rows.limit(0).withColumn("t", F.lit(None).cast("timestamp")), "t", F.lit("2024-01-01").cast("date"), 1, 2).first()["status"] == "error"
    assert checks.reconciled(rows, rows, F.sum("id"), F.sum("id")).count() == 0


def series(spark, n=900):
    start = dt.datetime(2024, 1, 1)
    rows = [("w", start + dt.timedelta(seconds=i), 100 + 0.5 * i, 7.0, float("nan"), 0 if i < 400 else 102 if i < 700 else 2) for i in range(n)]
    return spark.createDataFrame(rows, "well string, ts timestamp, p double, flat double, gone double, code int")


def test_sliding_windows_of_a_ramp(spark):
    rows = sliding.windowed(series(spark), "well", "ts", 180, 15)
    out = sliding.features(rows, "well", ["p", "flat", "gone"], label=F.col("code"), trained=True).orderBy("k").collect()
    assert [r["k"] for r in out] == list(range((899 - 180) // 15 + 1)) and all(r["n_rows"] == 180 for r in out)
    assert all(r["p_slope"] == pytest.approx(0.5) and r["p_delta"] == pytest.approx(89.5) and r["flat_slope"] == 0 and r["flat_std"] == 0 and r["gone_mean"] is None for r in out)
    assert out[0]["label"] == "normal" and out[20]["label"] == "transient" and out[-1]["label"] == "event"
    assert sliding.windowed(series(spark, 100), "well", "ts", 180, 15).count() == 0
    one = sliding.features(sliding.windowed(series(spark).withColumn("p", F.when(F.col("p") < 101, F.col("p"))), "well", "ts", 180, 15).where("k = 0"), "well", ["p"]).first()
    assert one["p_mean"] == pytest.approx(100.25)
    assert spark.range(1).select(sliding.adaptive_step(F.lit(1500 * 40 + 1), 15, 1500), sliding.adaptive_step(F.lit(10), 15, 1500)).first() == (41, 15)


def test_lead_times(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    marks = spark.createDataFrame([("none", t(5), t(20)), ("early", t(5), t(20)), ("on", t(5), t(20)), ("late", t(5), t(20)), ("quiet", t(5), None), ("sudden", None, t(20))], "s string, transient_at timestamp, event_at timestamp")
    seen = spark.createDataFrame([("early", t(2)), ("on", t(10)), ("late", t(30)), ("quiet", t(1)), ("sudden", t(1))], "s string, alarm_at timestamp")
    found = {r["s"]: (r["moment"], r["lead_s"]) for r in alarms.lead_times(marks, seen, "s").collect()}
    assert found == {"none": ("none", None), "early": ("early", None), "on": ("on_time", 600), "late": ("late", None), "sudden": ("on_time", 1140)}


def test_folds_never_split_groups_and_are_balanced(spark):
    rows = spark.range(600).selectExpr("id", "cast(pow(id, 0.6) as int) as g", "cast(id as double) as y")
    out = folds.with_folds(rows, "g", 5)
    assert out.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 60
    again = folds.permuted(rows, "id", "y", 1)
    assert sorted(r["y"] for r in again.collect()) == [float(i) for i in range(600)] and again.where("y = id").count() < 30


def test_folds_are_joined_without_sending_the_rows_to_the_driver(spark, tmp_path):
    spark.range(2000).selectExpr("id", "id % 7 as g").coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")

    def plan(out):
        out.collect()
        return out._jdf.queryExecution().executedPlan().toString()

    found = plan(folds.with_folds(rows, "g", 3))
    assert "BuildRight" in found and "BuildLeft" not in found
    beyond = folds.with_folds(rows, "g", 3, broadcast_groups=6)
    assert "BroadcastHashJoin [coalesce(g" not in plan(beyond) and beyond.count() == 2000


def test_weights_and_classifiers(spark):
    rows = spark.range(300).selectExpr("id", "cast(id as double) as x", "case when id < 250 then 0.0 when id < 280 then 1.0 else 2.0 end as label")
    out = folds.with_weights(rows, "label")
    sums = {r["label"]: r["w"] for r in out.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert all(w == pytest.approx(100) for w in sums.values())
    assert models.majority(rows, "label").first()["predicted"] == 0.0
    from pyspark.ml import Pipeline

    features = models.Features(("x",))
    for estimator, least in ((models.forest("label"), 0.95), (models.stump("label"), 0.6)):
        found = Pipeline(stages=[*features.stages(), estimator]).fit(out).transform(out)
        assert found.where("prediction = label").count() >= least * 300
        assert found.select(models.class_probabilities().alias("p")).select(F.array_max("p")).first()[0] <= 1


def test_promotion_and_registry(spark, tmp_path):
    rows = folds.with_folds(spark.range(300).selectExpr("id", "id % 10 as g", "case when id % 7 = 0 then null else cast(id % 50 as double) end as x", "cast(id % 3 as string) as c", "cast(id % 50 as double) as y"), "g", 2)
    features = models.Features(("x",), ("c",))
    name, score = models.best(rows, features, models.regressors("y", {"maxDepth": (2, 4), "maxIter": (4,)}), 2, "y")
    assert "maxDepth=4" in name and score > 0.7
    from pyspark.ml import Pipeline

    model = Pipeline(stages=[*features.stages(), models.linear("y")]).fit(rows)
    store = models.Models(spark, str(tmp_path))
    assert store.champion("m") is None
    assert store.register("m", model, {"score": score}, {"median": 0.0}) == (1, True)
    assert store.register("m", model, {"score": -1.0}, {"median": 0.0}) == (2, False)
    version, champion = store.champion("m")
    assert version == 1
    out = models.predictions(champion, rows, ["id"], "y", F.col("id") < 10, version)
    assert out.where("actual is not null").count() == 10
    fall = models.permutation_importance(champion, rows, "id", ["x"], lambda d: d.agg(metrics.regression(F.col("y"), F.col("prediction"))[2]).first()[0], repeats=1)
    assert fall["x"] > 0.3


def test_slope_at_one_instant_and_codes(spark):
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", at, 1.0, 0.0), ("a", at, 3.0, 1.0), ("a", at + dt.timedelta(seconds=20), None, 2.0)], "s string, ts timestamp, v double, u double")
    out = sliding.features(sliding.windowed(rows, "s", "ts", 10, 10), "s", ["v", "u"]).where("k = 0").first()
    assert out["v_slope"] is None and out["v_mean"] == 2.0 and out["v_delta"] is not None
    codes = spark.createDataFrame([(0.0,), (100.0,), (107.0,), (-1.0,), (5.0,), (float("nan"),), (None,)], "c double")
    assert [r[0] for r in codes.select(sliding.severity_label(sliding.label_severity(F.col("c")))).collect()] == ["normal", "transient", "transient", "event", "event", None, None]


def test_letters_with_marks_and_sensor_names(spark):
    df = spark.createDataFrame([("Ångström ñandú Žižka Ǖ ḗ e\u0301 Ω\u0301 ø",)], "n string")
    assert df.select(columns.fold("n")).first()[0] == "ANGSTROM NANDU ZIZKA U E E Ω Ø"
    assert columns.with_plain_names(spark.createDataFrame([(1, 2)], "`P-PDG` int, ` ABER-CKP` int")).columns == ["p_pdg", "aber_ckp"]
    with pytest.raises(ValueError):
        columns.with_plain_names(spark.createDataFrame([(1, 2)], "`P-PDG` int, p_pdg int"))
