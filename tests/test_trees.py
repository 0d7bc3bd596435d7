"""Boosted trees, their attributions, and the exact baselines, against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.ml import baselines, boosting, folds
from strata.operators.running import exact_quantiles
from strata.plans import trees


@pytest.fixture(scope="module")
def rows(spark):
    """Missing x means a high target, category q a low one, unseen ones and a constant feature say nothing."""
    out = []
    for i in range(600):
        x = None if i % 6 == 0 else float("nan") if i % 6 == 1 else (i * 37 % 100) / 10
        c = ["p", "q", "r", None][i % 4]
        y = (5.0 if i % 6 < 2 else (x > 5) * 2.0) - (3.0 if c == "q" else 0.0)
        out.append((i, x, c, 1.0, y, "high" if y > 1.5 else "mid" if y > -0.5 else "low"))
    return spark.createDataFrame(out, "id long, x double, c string, one double, y double, label string").repartition(3)


@pytest.fixture(scope="module")
def regression(rows):
    how = boosting.Boosting(rounds=4, rate=0.7, depth=3, bins=128, least_rows=5, write_every=2, smooth=0.0)
    return boosting.fit(rows, "y", ["x", "one"], ["c"], how=how)


def test_missing_values_take_their_own_side(rows, regression):
    out = regression.transform(rows).select("x", "c", "y", "prediction").collect()
    assert max(abs(r["y"] - r["prediction"]) for r in out) < 0.3
    first = regression.trees[0][0]
    assert any(n["feature"] == 0 and n["missing_left"] is False for n in first)
    again = boosting.Boosted.from_json(regression.to_json())
    assert again.transform(rows).select("id", "prediction").exceptAll(regression.transform(rows).select("id", "prediction")).count() == 0


def test_attributions_are_shapley_values(spark, rows, regression):
    few = rows.where("id < 12")
    got = regression.attributions(few).withColumn("bins", regression.binned()).collect()
    prediction = {r["id"]: r["prediction"] for r in regression.transform(few).collect()}
    expected = regression.expected()[0]

    def worth(bins, known, tree, i=0):
        node = tree[i]
        if node["feature"] is None:
            return node["value"]
        b = bins[node["feature"]]
        left = node["missing_left"] if b < 0 else b in node["categories"] if node["categories"] is not None else b <= node["bin"]
        if node["feature"] in known:
            return worth(bins, known, tree, 2 * i + 1 if left else 2 * i + 2)
        return sum(worth(bins, known, tree, j) * tree[j]["rows"] / node["rows"] for j in (2 * i + 1, 2 * i + 2))

    for r in got:
        want = [0.0] * 3
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            for n in range(3):
                for s in itertools.combinations(rest, n):
                    gain = sum(worth(r["bins"], {*s, f}, t[0]) - worth(r["bins"], set(s), t[0]) for t in regression.trees)
                    want[f] += gain * math.factorial(n) * math.factorial(2 - n) / 6
        assert np.allclose(r["attributions"][0], want)
        assert math.isclose(sum(want), prediction[r["id"]] - expected, abs_tol=1e-9)


def test_classes_weights_and_early_stop(rows):
    how = boosting.Boosting(rounds=4, rate=0.6, depth=2, bins=8, least_rows=2, patience=2, held_percent=30)
    weighted = folds.with_weights(rows, "label")
    model = boosting.fit(weighted, "label", ["x"], ["c"], ["low", "mid", "high"], weight="weight", key="id", how=how)
    assert 2 < len(model.losses) == len(model.trees) + 1 and model.losses[-1] < model.losses[0] / 2
    out = model.transform(rows)
    assert out.where("label = prediction").count() > 0.9 * 600
    assert out.where("abs(aggregate(probability, 0D, (a, x) -> a + x) - 1) > 1e-9").count() == 0
    assert boosting._stalled([3.0, 2.0, 2.0, 2.5], boosting.Boosting(patience=2)) and not boosting._stalled([3.0, 2.0, 2.0, 1.9], boosting.Boosting(patience=2))


def test_nothing_to_learn(spark, rows):
    flat = boosting.fit(rows.limit(0), "y", ["x"], ["c"])
    assert flat.trees == [] and flat.transform(rows.limit(2)).select("prediction").distinct().collect()[0][0] == 0.0
    assert boosting.fit(rows.where("label = 'high'"), "label", ["one"], labels=["high", "low"]).trees == []


def greedy(sizes, k):
    sums, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = sums.index(min(sums))
        out[g], sums[f] = f, sums[f] + n
    return out


@pytest.mark.parametrize("sizes", [
    {0: 500, **{i: 1 + i % 3 for i in range(1, 400)}}, {i: 1 for i in range(17)}, {0: 7, 1: 7, 2: 7, 3: 3, 4: 3, 5: 2, 6: 2, 7: 2, 8: 1}, {5: 4}, {i: (i * 7) % 11 + 1 for i in range(60)},
])
def test_folds_go_to_the_lightest(spark, sizes):
    rows = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g int")
    for k in (2, 5):
        assert {r["g"]: r["fold"] for r in folds.group_folds(rows, "g", k).collect()} == greedy(sizes, k)


def test_rows_without_a_group_are_one(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "g int, v int")
    assert folds.with_folds(rows, "g", 2).count() == 3
    assert folds.group_folds(rows.limit(0), "g", 2).count() == 0


def test_threshold_by_trying_all(spark):
    rng = np.random.default_rng(3)
    data = [(int(i % 3), None if i % 9 == 0 else float(rng.integers(0, 12)), ["a", "b", "c"][int(rng.integers(0, 3))]) for i in range(150)]
    rows = spark.createDataFrame(data, "fold int, x double, label string")
    got = {(r["fold"], r["x"]): r["predicted"] for r in baselines.out_of_fold_stump(rows, "x", "label", 3).collect()}
    for held in range(3):
        train = [(x, y) for f, x, y in data if f != held]
        fill = float(np.median([x for x, _ in train if x is not None]))
        xs, ys = np.array([fill if x is None else x for x, _ in train]), [y for _, y in train]
        weight = np.array([1 / ys.count(y) for y in ys])
        best = None
        for cut in sorted(set(xs))[:-1]:
            score, sides = 0, []
            for side in (xs <= cut, xs > cut):
                w = [sum(weight[i] for i in range(len(ys)) if side[i] and ys[i] == c) for c in "abc"]
                score += sum(v * v for v in w) / sum(w)
                sides.append("abc"[w.index(max(w))])
            if best is None or score > best[0] + 1e-12:
                best = (score, (cut + min(x for x in xs if x > cut)) / 2, sides)
        for f, x, _ in data:
            if f == held:
                assert got[f, x] == best[2][int((fill if x is None else x) > best[1])]


def test_a_feature_that_does_not_vary_has_no_threshold(spark):
    rows = spark.createDataFrame([(f, 1.0, y) for f in (0, 1) for y in "aab"], "fold int, x double, label string")
    assert {r["predicted"] for r in baselines.out_of_fold_stump(rows, "x", "label", 2).collect()} == {"a"}


def test_linear_by_least_squares(spark):
    rng = np.random.default_rng(5)
    data = [(int(i % 3), None if i % 7 == 0 else float(rng.normal()) * 1e4, float(rng.normal()), float(rng.normal())) for i in range(90)]
    rows = spark.createDataFrame(data, "fold int, x double, z double, y double").withColumn("twice", F.col("z") * 2)
    got = {(r["fold"], r["z"]): r["prediction"] for r in baselines.out_of_fold_linear(rows, ["x", "z", "twice"], "y", 3).collect()}
    for held in range(3):
        fill = np.median([x for f, x, _, _ in data if f != held and x is not None])
        full = lambda of: np.array([[1, fill if x is None else x, z] for _, x, z, _ in of])
        train, test = ([r for r in data if (r[0] == held) == t] for t in (False, True))
        b = np.linalg.lstsq(full(train), np.array([r[3] for r in train]), rcond=None)[0]
        for r, p in zip(test, full(test) @ b):
            assert abs(got[r[0], r[2]] - p) < 1e-6


def test_quantiles_with_weights_ties_and_null_groups(spark):
    data = [("a", float(v), n) for v, n in ((1, 5), (2, 1), (9, 3), (4, 2))] + [(None, 3.0, 1), (None, None, 4), ("b", float("nan"), 2), ("a", 2.0, 1)]
    rows = spark.createDataFrame(data, "g string, v double, n int").repartition(3)
    probabilities = [0.0, 0.3, 0.5, 0.77, 1.0]
    for between in (True, False):
        got = {(r["g"], r["probability"]): r["quantile"] for r in exact_quantiles(rows, ["g"], "v", probabilities, weight="n", between=between).collect()}
        values = np.repeat([1, 2, 4, 9], [5, 2, 2, 3])
        want = np.quantile(values, probabilities, method="linear" if between else "inverted_cdf")
        assert [got["a", p] for p in probabilities] == pytest.approx(list(want)) and [got[None, p] for p in probabilities] == [3.0] * 5
        assert len(got) == 10


def test_equal_rows_are_one_row_with_a_count(spark, rows, monkeypatch):
    how = boosting.Boosting(rounds=2, depth=2, bins=16, least_rows=1, patience=2, write_every=1)
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn("id", F.col("id") % 50)
    sizes, store = [], boosting.stored

    def counted(df, label):
        out = store(df, label)
        if label == "binned":
            sizes.append((out.count(), out.agg(F.sum("n")).first()[0]))
        return out

    monkeypatch.setattr(boosting, "stored", counted)
    model = boosting.fit(many, "y", ["x", "one"], ["c"], key="id", how=how)
    assert sizes and all(n < 600 and every == 5400 for n, every in sizes)
    # a whole weight does what copies do: the same trees, in other numbers of rows
    weighted = boosting.fit(rows.withColumn("id", F.col("id") % 50).withColumn("w", F.lit(9.0)), "y", ["x", "one"], ["c"], weight="w", key="id", how=how)
    shape = lambda m: [[(n["feature"], n["bin"], n["missing_left"], n["categories"], n["value"] and round(n["value"], 4)) for n in tree] for trees in m.trees for tree in trees]
    assert shape(model) == shape(weighted) and model.losses == pytest.approx(weighted.losses)


def test_the_boosted_query_learns_until_it_stalls(spark, monkeypatch):
    models, transform = [], boosting.Boosted.transform
    monkeypatch.setattr(boosting.Boosted, "transform", lambda self, rows: models.append(self) or transform(self, rows))
    assert len(trees.ml_boosted_oof(spark, "/root/testdata/sf0.001").collect()) == 3 == len(models)
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").toPandas()
    for m in models:
        # the reference's patience, by losses that no later round made better
        assert len(m.losses) > 20 and min(m.losses[-20:]) >= m.losses[-21] - 1e-7
        # each size and serial has a bin of its own, and each type
        assert [len(e) for e in m.edges] > [32, 32, 0] and set(m.edges[2]) == set(part["p_type"])


def test_models_of_all_folds_are_those_of_one_by_one(rows):
    how = boosting.Boosting(rounds=2, rate=0.6, depth=2, bins=16, least_rows=2, patience=1, held_percent=30, write_every=1)
    dealt = folds.with_weights(rows, "label").withColumn("fold", F.when(F.col("id") > 3, (F.col("id") % 3).cast("int")))
    for args in (("y", ["x", "one"], ["c"]), ("label", ["x"], ["c"], ["low", "mid", "high"])):
        together = boosting.fit_folds(dealt, 3, *args, weight="weight", key="id", how=how)
        for k, model in enumerate(together):
            alone = boosting.fit(dealt.where(F.col("fold") != k), *args, weight="weight", key="id", how=how)
            assert model.trees == alone.trees and len(model.trees) > 0 and model.edges == alone.edges and model.losses == pytest.approx(alone.losses)


def test_nodes_by_parts_are_the_same(rows, regression, monkeypatch):
    monkeypatch.setattr(boosting, "CELLS", 1)
    how = boosting.Boosting(rounds=1, rate=0.7, depth=3, bins=128, least_rows=5, smooth=0.0)
    assert boosting.fit(rows, "y", ["x", "one"], ["c"], how=how).trees == regression.trees[:1]


def test_gradients_that_are_too_large(rows):
    with pytest.raises(Exception, match="too large"):
        boosting.fit(rows.withColumn("y", F.col("y") * 1e13), "y", ["x"], how=boosting.Boosting(rounds=1))
