"""Training, baselines, choice and promotion of models, and inference with the promoted one.

Boosted trees on histograms (``boosting``) take missing values as they are. For Spark's own estimators numbers are imputed by the
median and an indicator tells where, and categories are numbered with -1 for those not seen.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.ml import boosting
from strata.ml.folds import permuted
from strata.operators import metrics
from strata.streaming.replay import numbered


@dataclass(frozen=True)
class Features:
    numbers: tuple[str, ...]
    categories: tuple[str, ...] = ()

    def stages(self) -> list:
        """Imputed numbers, an indicator for each, ordinal categories (-1: not seen in training), one vector."""
        indexed = [f"{c}__i" for c in self.categories]
        stages: list = []
        if self.categories:
            stages.append(StringIndexer(inputCols=list(self.categories), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"))
        # an unseen category has the index after the last; the number of them is known only from the fitted indexer, so all
        # null and unseen ones are one kind of their own
        missing = ", ".join(f"cast(`{c}` is null or isnan(`{c}`) as double) as `{c}__m`" for c in self.numbers)
        stages += [SQLTransformer(statement=f"select *, {missing} from __THIS__"), Imputer(inputCols=list(self.numbers), outputCols=[f"{c}__n" for c in self.numbers], strategy="median")]
        stages.append(VectorAssembler(inputCols=[f"{c}__n" for c in self.numbers] + [f"{c}__m" for c in self.numbers] + indexed, outputCol="features"))
        return stages


def ordinal(rows: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """``rows`` and ``code``: the place of the value among the sorted values of ``train``; -1 if it isn't there."""
    values = numbered(train.select(F.col(column).alias("_value")).where("_value is not null").distinct(), ["_value"])
    return rows.join(values, F.col(column) == F.col("_value"), "left").withColumn("code", F.coalesce(F.col("place") - 1, F.lit(-1))).drop("_value", "place")


def regressors(target: str, grid: dict[str, Sequence] | None = None) -> dict[str, Estimator]:
    """Boosted trees for each point of the grid, by name."""
    grid = grid or {"maxDepth": (3, 5), "maxIter": (20,)}
    points = [dict(zip(grid, p)) for p in itertools.product(*grid.values())]
    return {"gbt " + " ".join(f"{k}={v}" for k, v in p.items()): GBTRegressor(labelCol=target, maxBins=64, seed=7, **p) for p in points}


def linear(target: str) -> Estimator:
    return LinearRegression(labelCol=target)


def forest(label: str, weight: str = "weight", impurity: str = "gini") -> Estimator:
    return RandomForestClassifier(labelCol=label, weightCol=weight, numTrees=20, maxDepth=6, seed=7, impurity=impurity)


def classifiers(label: str) -> dict[str, Estimator]:
    """A forest for each way to judge a node's split, by name."""
    return {f"forest {i}": forest(label, impurity=i) for i in ("gini", "entropy")}


def stump(label: str, weight: str = "weight") -> Estimator:
    return DecisionTreeClassifier(labelCol=label, weightCol=weight, maxDepth=1, seed=7)


def majority(train: DataFrame, label: str) -> DataFrame:
    """One row: the label found most often, the least of equals."""
    return train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), label).limit(1).select(F.col(label).alias("predicted"))


Model = PipelineModel | boosting.Boosted


@dataclass(frozen=True)
class Learner:
    """What fits a model: an estimator of Spark, or boosted trees, which need the target (with ``labels``, its classes) and, to hold
    out rows, a key."""

    estimator: Estimator | boosting.Boosting
    target: str = ""
    labels: tuple[str, ...] | None = None
    weight: str | None = None
    key: str | None = None

    def fit(self, rows: DataFrame, features: Features) -> Model:
        if isinstance(self.estimator, boosting.Boosting):
            return boosting.fit(rows, self.target, features.numbers, features.categories, self.labels, self.weight, self.key, self.estimator)
        return Pipeline(stages=[*features.stages(), self.estimator]).fit(rows)


def out_of_fold(rows: DataFrame, features: Features, estimator: Estimator | Learner, folds: int) -> DataFrame:
    """``rows`` (with ``fold``) and ``prediction``, each by a model of the other folds."""
    out, learner = None, estimator if isinstance(estimator, Learner) else Learner(estimator)
    for k in range(folds):
        model = learner.fit(rows.where(F.col("fold") != k), features)
        part = model.transform(rows.where(F.col("fold") == k)).select(*rows.columns, "prediction")
        out = part if out is None else out.union(part)
    return out


def best(rows: DataFrame, features: Features, candidates: dict[str, Estimator], folds: int, target: str) -> tuple[str, float]:
    """(name, R2) of the candidate with the best out-of-fold R2; the first of equals."""
    name, score = "", float("-inf")
    for n, estimator in candidates.items():
        r2 = out_of_fold(rows, features, estimator, folds).agg(metrics.regression(F.col(target), F.col("prediction"))[2]).first()[0]
        if r2 is not None and r2 > score:
            name, score = n, r2
    return name, score


def permutation_importance(model: Model, rows: DataFrame, key: str, columns: Sequence[str], score: Callable[[DataFrame], float], repeats: int = 5) -> dict[str, float]:
    """By how much the score falls when a column's values are dealt anew, on average."""
    base = score(model.transform(rows))
    return {c: sum(base - score(model.transform(permuted(rows, key, c, seed))) for seed in range(repeats)) / repeats for c in columns}


class Models:
    """Versions of named models below a folder, and which of them is the champion, in JSON files beside them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _entries(self, name: str) -> list[dict]:
        try:
            return [json.loads(r[0]) for r in self.spark.read.text(f"{self.root}/{name}/versions").collect()]
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def register(self, name: str, model: Model, scores: dict[str, float], baselines: dict[str, float]) -> tuple[int, bool]:
        """(version, promoted): always kept as a version; champion only if it is better than every baseline."""
        version = 1 + max((e["version"] for e in self._entries(name)), default=0)
        promoted = promotes(scores["score"], baselines)
        boosted = isinstance(model, boosting.Boosted)
        if boosted:
            self.spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.text(f"{self.root}/{name}/v{version}")
        else:
            model.write().save(f"{self.root}/{name}/v{version}")
        entry = json.dumps({"version": version, "champion": promoted, "boosted": boosted, **scores, "baselines": baselines}, sort_keys=True)
        self.spark.createDataFrame([(entry,)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/{name}/versions")
        return version, promoted

    def champion(self, name: str) -> tuple[int, Model] | None:
        """The last promoted version."""
        found = max((e for e in self._entries(name) if e["champion"]), key=lambda e: e["version"], default=None)
        if found is None:
            return None
        path = f"{self.root}/{name}/v{found['version']}"
        if found.get("boosted"):
            return found["version"], boosting.Boosted.from_json(self.spark.read.text(path).first()[0])
        return found["version"], PipelineModel.load(path)


def promotes(score: float, baselines: dict[str, float]) -> bool:
    return all(score > b for b in baselines.values())


def predictions(model: Model, rows: DataFrame, keys: Sequence[str], actual: str, complete: Column, version: int) -> DataFrame:
    """``predicted`` and, where the observation is complete, ``actual``."""
    return model.transform(rows).select(*keys, F.col("prediction").alias("predicted"), F.when(complete, F.col(actual)).alias("actual"), F.lit(version).alias("model_version"))


def class_probabilities(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))
