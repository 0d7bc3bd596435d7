import pytest
from pyspark.sql import functions as F

from strata.ml import boosting, folds, jobs, models
from strata.operators import alarms


@pytest.fixture(scope="module")
def readings(spark):
    """12 series of 1,800 seconds in 4 sites; pressure moves in the transient and in the event."""
    rows = spark.range(12 * 180).selectExpr(
        "concat('s', id div 180) as series", "concat('w', (id div 180) % 4) as site",
        "timestamp_seconds(1700000000 + (id % 180) * 10) as ts", "id % 180 as i",
    )
    code = F.when(F.col("i") < 90, 0).when(F.col("i") < 140, 105).otherwise(5)
    noise = F.sin(F.col("i") * 0.7)
    size = F.when(F.col("i") < 90, 1).when(F.col("i") < 140, 20).otherwise(60)
    return rows.withColumns({"code": code, "pressure": noise * size, "flow": F.cos(F.col("i").cast("double"))}).drop("i")


def test_train_and_detect(spark, readings, tmp_path):
    windows = jobs.Windows("series", "ts", ("pressure", "flow"))
    sites = readings.select("series", "site").distinct()
    cut = windows.cut(readings, F.col("code")).join(sites, "series")
    # 1,790 seconds in steps of 60 hold 27 whole windows of 180
    assert cut.count() == 12 * 27
    assert cut.selectExpr("max(unix_timestamp(window_end) - unix_timestamp(window_start))").first()[0] == 180
    store = models.Models(spark, str(tmp_path / "models"))
    assert jobs.detect(readings, windows, 1, store, "events", F.current_timestamp()) is None
    splits = [jobs.Split("series", "series", 3), jobs.Split("site", "site", 9)]
    done = jobs.train_classifier(cut, windows.features, splits, "pressure_std", store, "events")
    assert set(done.scores) == {"majority", "threshold", "forest by series", "forest by site"}
    assert done.version == 1 and done.promoted and done.scores["forest by series"] > 0.8 > done.scores["majority"]
    assert done.rows.count() == 12 * 27
    lead = jobs.leads(done.rows, readings, windows, F.col("code"))
    assert lead.count() == 12
    assert alarms.lead_statistics(lead.withColumn("all", F.lit(1)), "all").first()["n_none"] == 0
    found = jobs.detect(readings.drop("code"), windows, 24, store, "events", F.lit("2024-01-01").cast("timestamp"))
    assert found.columns == ["series", "window_start", "window_end", "predicted", "probability", "model_version", "detected_at"]
    rows = found.collect()
    assert {r["predicted"] for r in rows} == {"transient", "event"} and len({r["series"] for r in rows}) == 12
    assert {r["model_version"] for r in rows} == {"v1"} and all(0.3 < r["probability"] <= 1 for r in rows)


def test_majority_out_of_fold(spark):
    rows = spark.createDataFrame([(0, "a"), (0, "a"), (0, "a"), (1, "b"), (1, "c"), (2, "b"), (2, "c")], "fold int, label string")
    out = {(r["fold"], r["predicted"]) for r in folds.out_of_fold_majority(rows, "label", 3).collect()}
    # of b and c, twice each outside of fold 0, the least
    assert out == {(0, "b"), (1, "a"), (2, "a")}


def test_regressor_and_predictions(spark, tmp_path):
    rows = spark.range(400).selectExpr("id", "id % 20 as site", "cast(id % 40 as double) as x", "if(id % 10 = 0, null, pow((id % 40) - 20, 2)) as y")
    store = models.Models(spark, str(tmp_path))
    features, at = models.Features(("x",)), F.lit("2024-01-01").cast("timestamp")
    assert jobs.predict(rows, ["id"], "y", F.lit(True), store, "m", at) is None
    tries = models.regressors("y", {"maxDepth": (1, 4), "maxIter": (6,)})
    done = jobs.train_regressor(rows, features, "y", jobs.Split("site", "site", 3), store, "m", tries)
    assert done.promoted and max(done.scores, key=done.scores.get) == "gbt maxDepth=4 maxIter=6"
    assert done.rows.count() == 360
    out = jobs.predict(rows, ["id"], "y", F.col("id") < 200, store, "m", at)
    assert out.count() == 400 and out.where("actual is not null").count() == 180
    assert out.where("id < 200 and abs(predicted - actual) < 60").count() > 150
    assert out.first()["model_version"] == "v1"


def test_boosted_windows_detect_without_the_cap(spark, readings, tmp_path):
    windows = jobs.Windows("series", "ts", ("pressure", "flow"), most=9)
    # a sensor that some series lack
    rows = readings.withColumn("flow", F.when(F.col("site") != "w1", F.col("flow")))
    cut = windows.cut(rows, F.col("code")).join(rows.select("series", "site").distinct(), "series")
    assert cut.count() < 12 * 10
    store = models.Models(spark, str(tmp_path / "models"))
    how = boosting.Boosting(rounds=2, rate=0.5, depth=2, bins=16, least_rows=3)
    done = jobs.train_classifier(cut, windows.features, [jobs.Split("series", "series", 2)], "pressure_std", store, "events", how)
    assert done.promoted and done.scores["boosted by series"] > 0.8
    found = jobs.detect(rows.drop("code"), windows, 24, store, "events", F.lit("2024-01-01").cast("timestamp")).where("series = 's1'")
    # 27 windows at every step, of which some are normal
    assert found.count() > 9 and {r["predicted"] for r in found.collect()} == {"transient", "event"}
    assert windows.cut(rows, capped=False).count() == 12 * 27
