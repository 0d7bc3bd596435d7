"""Whole jobs: training a classifier of windows and a regressor, and the use of the promoted ones.

Every score that decides is out of fold. Models are fitted by Spark; between the steps only scores (a few numbers)
reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import from_target, to_target
from strata.ml import baselines as exact
from strata.ml import boosting, folds, models
from strata.operators import alarms, metrics, sliding
from strata.sources.files import lookback
from strata.sources.scratch import stored

LABELS = ("normal", "transient", "event")


@dataclass(frozen=True)
class Windows:
    """Which columns the readings have, and how windows are cut: ``most`` is about how many a series has at most."""

    series: str
    ts: str
    sensors: tuple[str, ...]
    width_s: int = 180
    step_s: int = 60
    most: int = 200

    @property
    def features(self) -> models.Features:
        return models.Features(tuple(f"{s}_{x}" for s in self.sensors for x in sliding.STATISTICS))

    def cut(self, readings: DataFrame, label: Column | None = None, capped: bool = True) -> DataFrame:
        """A row a window: its statistics, ``window_start`` and ``window_end`` (times) and ``label`` (null without one;
        with ``label``, windows that have none are left out). Not ``capped``, long series have windows at every step too."""
        at = F.unix_micros(F.col(self.ts).cast("timestamp"))
        spans = readings.groupBy(F.col(self.series).alias("_id")).agg(F.min(at).alias("_begin"), F.max(at).alias("_end"))
        rows = readings.join(spans, F.col(self.series) == F.col("_id"))
        step = sliding.adaptive_step((F.col("_end") - F.col("_begin")) / 1_000_000, self.step_s, self.most) if capped else F.lit(self.step_s)
        rows = sliding.windowed(rows, self.series, self.ts, self.width_s, step=step).drop("_id", "_begin", "_end")
        out = sliding.features(rows, self.series, self.sensors, label, trained=label is not None)
        begin = F.col("_begin") + (F.col("window_start") * 1_000_000).cast("long")
        out = out.join(spans.drop("_end"), F.col(self.series) == F.col("_id"))
        out = out.withColumn("window_end", F.timestamp_micros(begin + self.width_s * 1_000_000))
        return out.withColumn("window_start", F.timestamp_micros(begin)).drop("_id", "_begin")


@dataclass(frozen=True)
class Split:
    """A criterion of validation: rows that agree in ``column`` are never on both sides."""

    name: str
    column: str
    folds: int

    def dealt(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """``rows`` with ``fold``, and the number of folds: no more than there are groups."""
        n = min(self.folds, rows.agg(F.count_distinct(self.column)).first()[0])
        return folds.with_folds(rows.drop("fold"), self.column, n), n


@dataclass(frozen=True)
class Trained:
    version: int
    promoted: bool
    #: Score by name: baselines, the model by each split (classifier) or each candidate (regressor).
    scores: dict[str, float]
    #: Rows with ``predicted``, out of fold.
    rows: DataFrame


def label_number(label: str = "label") -> Column:
    return (F.array_position(F.array(*map(F.lit, LABELS)), F.col(label)) - 1).cast("double")


def label_name(number: str = "prediction") -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), F.col(number).cast("int") + 1)


def labelled(rows: DataFrame) -> DataFrame:
    """``predicted``: the label that the ``prediction`` is (of boosted trees), or numbers (of Spark's models)."""
    return rows.withColumn("predicted", F.col("prediction") if dict(rows.dtypes)["prediction"] == "string" else label_name())


def _classifier(how: boosting.Boosting | None, key: str) -> models.Learner:
    return models.Learner(how, "label", LABELS, "weight", key) if how else models.Learner(models.forest("y"))


def classified(rows: DataFrame, features: models.Features, learner: models.Learner, split: Split) -> DataFrame:
    """``rows`` and ``predicted``: the label given by a model of the other folds."""
    dealt, n = split.dealt(rows)
    weighted = folds.with_weights(dealt.withColumn("y", label_number()), "y")
    out = labelled(models.out_of_fold(stored(weighted, "folds"), features, learner, n))
    return stored(out.drop("prediction", "y", "weight"), "classified")


def train_classifier(
    windows: DataFrame, features: models.Features, splits: Sequence[Split], single: str, store: models.Models, name: str,
    how: boosting.Boosting | None = None,
) -> Trained:
    """Boosted trees (``how``), or else a forest, over labelled windows, held against the most frequent label and the best threshold on
    the feature ``single``. Where trees stop early, the groups of the split are held out whole.

    The macro F1 by the first split decides on promotion; the other splits are reported beside it, as ``boosted by <split>`` or
    ``forest by <split>``. The registered model is fitted on all windows.
    """
    first, labels = splits[0], list(LABELS)

    def f1(rows: DataFrame) -> float:
        return metrics.macro_f1(rows, "label", "predicted", labels).first()[0]

    kind = "boosted" if how else "forest"
    by_split = {s.name: classified(windows, features, _classifier(how, s.column), s) for s in splits}
    dealt, n = first.dealt(windows)
    baselines = {
        "majority": f1(folds.out_of_fold_majority(dealt, "label", n)),
        "threshold": f1(exact.out_of_fold_stump(dealt, single, "label", n)),
    }
    scores = baselines | {f"{kind} by {s}": f1(rows) for s, rows in by_split.items()}
    rows = folds.with_weights(windows.withColumn("y", label_number()), "y")
    model = _classifier(how, first.column).fit(rows, features)
    version, promoted = store.register(name, model, {"score": scores[f"{kind} by {first.name}"], **scores}, baselines)
    return Trained(version, promoted, scores, by_split[first.name])


def leads(found: DataFrame, readings: DataFrame, windows: Windows, code: Column) -> DataFrame:
    """How early the first window predicted not to be normal ended, for each series with an event."""
    marks = alarms.milestones(readings, windows.series, windows.ts, code)
    return alarms.lead_times(marks, alarms.first_alarms(found, windows.series, "predicted", "window_end"), windows.series)


def detect(
    readings: DataFrame, windows: Windows, hours: int, store: models.Models, name: str, at: Column
) -> DataFrame | None:
    """Alerts in the last hours of the data's own time by the promoted model, from all windows at the step; none without one."""
    champion = store.champion(name)
    if champion is None:
        return None
    version, model = champion
    rows = windows.cut(lookback(readings, windows.ts, hours), capped=False)
    found = labelled(model.transform(rows))
    probabilities = F.col("probability") if isinstance(model, boosting.Boosted) else models.class_probabilities()
    out = alarms.alerts(found, "predicted", probabilities, f"v{version}", at)
    return out.select(windows.series, "window_start", "window_end", "predicted", "probability", "model_version", "detected_at")


def train_regressor(
    rows: DataFrame, features: models.Features, target: str, split: Split, store: models.Models, name: str,
    candidates: dict[str, Estimator | boosting.Boosting] | None = None,
) -> Trained:
    """The best of the candidates (Spark's boosted trees, or ours with missing values as they are) on the logarithm of the target; promoted if its out-of-fold R2 is better
    than those of the median and of a linear model. Rows without a target are left out."""
    known = rows.where(F.col(target).isNotNull()).withColumn("y", to_target(target))
    dealt, n = split.dealt(known)
    dealt = stored(dealt, "folds")

    def r2(df: DataFrame) -> float:
        found = df.agg(metrics.regression(F.col("y"), F.col("prediction"))[2]).first()[0]
        return float("-inf") if found is None else found

    median = folds.out_of_fold_median(dealt, "y", n).withColumnRenamed("predicted", "prediction")
    # categories need Spark's encoding; numbers alone are fitted in one pass
    linear = models.out_of_fold(dealt, features, models.linear("y"), n) if features.categories else exact.out_of_fold_linear(dealt, features.numbers, "y", n)
    baselines = {"median": r2(median), "linear": r2(linear)}
    fits = {}
    for label, candidate in (candidates or models.regressors("y")).items():
        estimator = models.Learner(candidate, "y", key=split.column)
        fits[label] = (estimator, stored(models.out_of_fold(dealt, features, estimator, n), "out-of-fold"))
    tried = {label: r2(found) for label, (_, found) in fits.items()}
    best = max(tried, key=tried.get)
    model = fits[best][0].fit(dealt, features)
    version, promoted = store.register(name, model, {"score": tried[best]}, baselines)
    return Trained(version, promoted, baselines | tried, fits[best][1].withColumnRenamed("prediction", "predicted"))


def predict(
    rows: DataFrame, keys: Sequence[str], target: str, complete: Column, store: models.Models, name: str, at: Column
) -> DataFrame | None:
    """``predicted`` on the target's own scale by the promoted model, and ``actual`` where it is complete; none without one."""
    champion = store.champion(name)
    if champion is None:
        return None
    version, model = champion
    out = models.predictions(model, rows, keys, target, complete, version)
    return out.withColumns({"predicted": from_target("predicted"), "model_version": F.format_string("v%d", "model_version"), "predicted_at": at})
