"""Boosted trees on histograms: missing values learn their side, classes by softmax, categories as sets, a held-out stop.

Rows are binned once, and counted by their bins, target and weight. A level of a round's trees, of all folds' models, is one shuffle: tasks
sum gradients by class, node, feature and bin, and these sums go to one task a node, which chooses its split; what comes to the driver
is the model. Gradients are whole numbers of 2**-20, so sums and trees don't depend on the order of rows.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.running import exact_quantiles
from strata.sources.scratch import stored

UNIT = 2.0**20
#: Of a node, k being the model's number times its scores, and the score's.
SUMS = "k int, node int, f int, bin int, g long, h long, n long"
SPLITS = "k int, node int, g long, h long, n long, b struct<feature: int, bin: int, missing_left: boolean, categories: array<int>, g: long, h: long, n: long>"
#: Sums that a task holds at once; nodes beyond that are taken by another pass.
CELLS = 4_000_000


@dataclass(frozen=True)
class Boosting:
    rounds: int = 100
    rate: float = 0.1
    depth: int = 5
    bins: int = 64
    #: Rows that each side of a split has at least, and their sum of second derivatives.
    least_rows: int = 20
    least_hessian: float = 1e-3
    l2: float = 0.0
    #: Second derivatives that are added where categories are put in order.
    smooth: float = 10.0
    #: Stop if none of so many rounds has a loss on held-out rows that is lower by ``tolerance``; None: never.
    patience: int | None = None
    held_percent: int = 10
    tolerance: float = 1e-7
    #: Scores are written once in so many rounds; between them they are computed from the trees since then.
    write_every: int = 5


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _place(value: Column, edges: list[float]) -> Column:
    """How many of the edges are less than the value."""
    return F.size(F.filter(_literal(edges, "array<double>"), lambda e: e < value))


class Tree(NamedTuple):
    """A tree as arrays by node: its feature (-1: none), which of that one's bins go left (the missing one first), and its value."""

    feature: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def places(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The nodes that rows come to: node i has i * 2 + 1 and i * 2 + 2 below it."""
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[at]
            at = np.where(f < 0, at, 2 * at + 2 - self.left[at, bins[row, f] + 1])
        return at


def _goes(node: dict, n: int) -> np.ndarray:
    """Which of a split's first n bins go left, the missing one first."""
    bins = np.arange(-1, n - 1)
    goes = np.isin(bins, node["categories"]) if node["categories"] is not None else bins <= node["bin"]
    goes[0] = node["missing_left"]
    return goes


def _tree(nodes: Sequence[dict | None], width: int) -> Tree:
    feature, left, value = np.full(len(nodes), -1), np.zeros((len(nodes), width), bool), np.zeros(len(nodes))
    for i, node in enumerate(nodes):
        if node:
            value[i] = node["value"]
            if node["feature"] is not None:
                feature[i], left[i] = node["feature"], _goes(node, width)
    return Tree(feature, left, value)


def _add(scores: np.ndarray, bins: np.ndarray, trees: list[list[Tree]], depth: int) -> None:
    """Adds the trees of some rounds, one after the other."""
    for of_round in trees:
        for k, tree in enumerate(of_round):
            scores[:, k] += tree.value[tree.places(bins, depth)]


def _grid(lists: pa.Array, columns: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), columns)


def _lists(grid: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(grid) + 1) * grid.shape[1], pa.int32()), pa.array(grid.reshape(-1)))


@dataclass
class Boosted:
    """A fitted model. ``edges``: of a number, the upper bounds of its bins but the last; of a category, its values in order."""

    numbers: list[str]
    categories: list[str]
    edges: list[list]
    #: None for a regression, which has one score.
    labels: list | None
    start: list[float]
    depth: int
    #: By round and score: nodes in an array, see ``_at``.
    trees: list[list[list[dict]]] = field(default_factory=list)
    #: Loss on held-out rows, before the first round and after each.
    losses: list[float] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return [*self.numbers, *self.categories]

    def binned(self) -> Column:
        """The bins of a row's features; -1 for a missing value and for a category that wasn't seen."""
        found = []
        for c, edges in zip(self.numbers, self.edges):
            v = F.col(f"`{c}`").cast("double")
            found.append(F.when(v.isNull() | F.isnan(v), -1).otherwise(_place(v, edges)))
        for c, values in zip(self.categories, self.edges[len(self.numbers) :]):
            place = F.array_position(_literal(values, "array<string>"), F.col(f"`{c}`").cast("string")).cast("int")
            found.append(F.coalesce(place - 1, F.lit(-1)))
        return F.array(*found)

    @property
    def width(self) -> int:
        """How many bins a feature has at most, the missing one too."""
        return max(map(len, self.edges), default=0) + 2

    def arrays(self, since: int = 0, width: int | None = None) -> list[list[Tree]]:
        return [[_tree(tree, width or self.width) for tree in trees] for trees in self.trees[since:]]

    def scores(self, bins: Column) -> Column:
        """The scores of a row, an array: a task adds the trees for whole Arrow batches of bins."""
        trees, start, depth, n = self.arrays(), self.start, self.depth, len(self.features)

        def run(bins: pa.Array) -> pa.Array:
            scores = np.tile(start, (len(bins), 1))
            _add(scores, _grid(bins, n), trees, depth)
            return _lists(scores)

        return F.arrow_udf(run, "array<double>")(bins)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` and ``prediction``; with classes it is the label, and ``probability`` has an array by label."""
        out = rows.withColumn("_bins", self.binned()).withColumn("_scores", self.scores(F.col("_bins")))
        if self.labels is None:
            out = out.withColumn("prediction", F.get("_scores", F.lit(0)))
        else:
            most = F.array_max("_scores")
            powers = F.transform("_scores", lambda s: F.exp(s - most))
            out = out.withColumn("probability", F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)))
            best = F.array_position("_scores", F.array_max("_scores")).cast("int")
            out = out.withColumn("prediction", F.element_at(F.array(*map(F.lit, self.labels)), best))
        return out.drop("_bins", "_scores")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Boosted:
        return Boosted(**json.loads(text))

    def leaves(self) -> Iterator[tuple[int, float, list[tuple]]]:
        """(score, value, conditions) of every leaf; a condition is (feature, allowed bins with the missing one first, share of the rows
        of the nodes that split on the feature which go this way)."""
        for trees in self.trees:
            for k, tree in enumerate(trees):
                stack: list[tuple[int, dict]] = [(0, {})]
                while stack:
                    i, held = stack.pop()
                    node = tree[i]
                    if node["feature"] is None:
                        yield k, node["value"], [(f, allowed, z) for f, (allowed, z) in held.items()]
                        continue
                    f, n = node["feature"], len(self.edges[node["feature"]]) + 2
                    goes = _goes(node, n)
                    allowed, z = held.get(f, (np.ones(n, bool), 1.0))
                    for child, way in ((2 * i + 1, goes), (2 * i + 2, ~goes)):
                        stack.append((child, held | {f: (allowed & way, z * tree[child]["rows"] / node["rows"])}))

    def expected(self) -> list[float]:
        """The mean scores over the rows that the trees were fitted on, as their nodes' sizes tell."""
        out = list(self.start)
        for k, value, conditions in self.leaves():
            out[k] += value * math.prod(z for _, _, z in conditions)
        return out

    def attributions(self, rows: DataFrame, to: str = "attributions", bins: Column | None = None) -> DataFrame:
        """``rows`` and an array by score of arrays by feature: by how much each feature moves the score from the expected one. It is
        the Shapley value of the game in which unknown features go both ways in the shares of the nodes' rows, and sums to the score
        less the expected one.

        Leaves are taken one by one for whole Arrow batches of bins. They are all that counts of a row, so it is enough to explain a row of
        each; ``bins`` is where ``rows`` has them, else they follow from the features.
        """
        leaves, n_scores, n_features = list(self.leaves()), len(self.start), len(self.features)

        def explain(bins: pd.Series) -> pd.Series:
            grid = np.stack(bins.to_numpy()) if len(bins) else np.zeros((0, n_features), int)
            out = np.zeros((len(grid), n_scores, n_features))
            for k, value, conditions in leaves:
                on = [allowed[grid[:, f] + 1].astype(float) for f, allowed, _ in conditions]
                for j, (f, _, z) in enumerate(conditions):
                    rest = [(on[i], c[2]) for i, c in enumerate(conditions) if i != j]
                    out[:, k, f] += value * (on[j] - z) * _mean_over_subsets(rest, len(grid))
            return pd.Series(list(out.tolist()))

        udf = F.pandas_udf(explain, "array<array<double>>")
        return rows.withColumn(to, udf(self.binned() if bins is None else bins))


def _mean_over_subsets(rest: list[tuple[np.ndarray, float]], n: int) -> np.ndarray:
    """Over all orders of the other conditions and one more: the mean product of ``on`` before it and of the share behind it."""
    m = len(rest)
    # by[c]: sum of the products over subsets of c conditions that are known
    by = [np.ones(n)] + [np.zeros(n) for _ in range(m)]
    for done, (on, z) in enumerate(rest):
        for c in range(done + 1, 0, -1):
            by[c] = by[c] * z + by[c - 1] * on
        by[0] = by[0] * z
    return sum(math.factorial(c) * math.factorial(m - c) / math.factorial(m + 1) * by[c] for c in range(m + 1))


def softmax(scores: Column) -> Column:
    most = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - most))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def _bins(rows: DataFrame, models: int, numbers: Sequence[str], categories: Sequence[str], bins: int) -> list[list[list]]:
    """By model (``_m``): of each number, the distinct quantiles but the greatest value; of each category, the most frequent values in their order."""
    edges: list[list[list]] = [[[] for _ in (*numbers, *categories)] for _ in range(models)]
    if numbers:
        values = F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(numbers)]))
        found = exact_quantiles(rows.select("_m", values), ["_m", "f"], "v", [i / bins for i in range(1, bins + 1)], between=False)
        for r in found.groupBy("_m", "f").agg(F.sort_array(F.collect_set("quantile")).alias("q"), F.max("quantile").alias("top")).collect():
            edges[r["_m"]][r["f"]] = [float(x) for x in r["q"] if x < r["top"]]
    if categories:
        values = F.inline(F.array(*[F.struct(F.lit(len(numbers) + i).alias("f"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(categories)]))
        counts = rows.select("_m", values).where("v is not null").groupBy("_m", "f", "v").agg(F.count(F.lit(1)).alias("n"))
        place = F.row_number().over(Window.partitionBy("_m", "f").orderBy(F.col("n").desc(), "v"))
        for r in counts.withColumn("place", place).where(F.col("place") <= bins).groupBy("_m", "f").agg(F.sort_array(F.collect_list("v")).alias("vs")).collect():
            edges[r["_m"]][r["f"]] = list(r["vs"])
    return edges


class Scored(NamedTuple):
    """Rows of one model, as arrays; a row stands for ``n``."""

    model: int
    y: np.ndarray
    w: np.ndarray
    held: np.ndarray
    n: np.ndarray
    bins: np.ndarray
    scores: np.ndarray


@dataclass(frozen=True)
class _Scoring:
    """What tasks need to score the rows of some models: by model, the trees since scores were written."""

    trees: dict[int, list[list[Tree]]]
    classes: bool
    n_scores: int
    n_features: int
    depth: int

    def scored(self, batches: Iterable[pa.RecordBatch]) -> Iterator[Scored]:
        for batch in batches:
            m, y, w, held, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "y", "w", "held", "n"))
            bins, have = _grid(batch.column("bins"), self.n_features), _grid(batch.column("have"), self.n_scores)
            for i in np.unique(m):
                on = m == i
                out = Scored(int(i), y[on], w[on], held[on], n[on], bins[on], have[on].copy())
                _add(out.scores, out.bins, self.trees[out.model], self.depth)
                yield out

    def write(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in self.scored(batches):
            arrays = [pa.array(np.full(len(r.y), r.model, np.int32)), *map(pa.array, (r.y, r.w, r.held, r.n)), _lists(r.bins), _lists(r.scores)]
            yield pa.RecordBatch.from_arrays(arrays, ["m", "y", "w", "held", "n", "bins", "have"])

    def loss(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {m: np.zeros(2) for m in self.trees}
        for r in self.scored(batches):
            if self.classes:
                each = -np.log(np.maximum(softmax(r.scores)[np.arange(len(r.y)), r.y.astype(int)], 1e-300))
            else:
                each = (r.scores[:, 0] - r.y) ** 2 / 2
            sums[r.model] += (r.n * r.w * each).sum(), (r.n * r.w).sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array([float(s[i]) for s in sums.values()], pa.float64()) for i in (0, 1))], ["m", "loss", "weight"])

    def derivatives(self, r: Scored) -> tuple[np.ndarray, np.ndarray]:
        """The first and the second by score, in whole units."""
        if not self.classes:
            return _whole(r.w * (r.scores[:, 0] - r.y))[:, None], _whole(r.w)[:, None]
        p, w = softmax(r.scores), r.w[:, None]
        return _whole(w * (p - (r.y[:, None] == np.arange(self.n_scores)))), _whole(w * p * (1 - p))

    def sums(self, trees: dict[int, list[Tree]], level: int, nodes: list[tuple[int, int]], width: int):
        """For mapInArrow: the sums over a task's rows for the nodes (k, node) of a level; ``trees`` are those so far."""
        first, n_features = 2**level - 1, self.n_features
        slots = {m: np.full((self.n_scores, first + 1), -1) for m in self.trees}
        for slot, (k, node) in enumerate(nodes):
            slots[k // self.n_scores][k % self.n_scores, node - first] = slot

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, most = np.zeros((3, len(nodes) * n_features * width), np.int64), 0.0
            for r in self.scored(batches):
                g, h = self.derivatives(r)
                most += max(float((np.abs(x).astype(float) * r.n[:, None]).sum()) for x in (g, h))
                _small(most)
                for k, tree in enumerate(trees[r.model]):
                    place = tree.places(r.bins, level)
                    slot = np.where(place >= first, slots[r.model][k, np.maximum(place - first, 0)], -1)
                    on = slot >= 0
                    parts = [x[on] * r.n[on] for x in (g[:, k], h[:, k])] + [r.n[on]]
                    for f in range(n_features):
                        cell = (slot[on] * n_features + f) * width + r.bins[on, f] + 1
                        for into, part in zip(sums, parts):
                            np.add.at(into, cell, part)
            cell = np.flatnonzero(sums[2])
            slot, f, b = np.unravel_index(cell, (len(nodes), n_features, width))
            k, node = np.array(nodes)[slot].T
            arrays = [pa.array(x, pa.int32()) for x in (k, node, f, b - 1)] + [pa.array(x[cell]) for x in sums]
            yield pa.RecordBatch.from_arrays(arrays, ["k", "node", "f", "bin", "g", "h", "n"])

        return run


def _small(total: float) -> None:
    """numpy says nothing when a whole number gets too large."""
    if not total < 2.0**62:
        raise OverflowError("gradients are too large to be summed in units of 2**-20")


def _whole(x: np.ndarray) -> np.ndarray:
    """In units, halves away from zero."""
    x = x * UNIT
    _small(np.abs(x).max(initial=0.0))
    down = np.trunc(x)
    return (down + np.sign(x) * (np.abs(x - down) >= 0.5)).astype(np.int64)


def softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=1, keepdims=True))
    # summed from the first on, as SQL does
    return powers / np.add.accumulate(powers, axis=1)[:, -1:]


def best_split(how: Boosting, n_numbers: int):
    """For applyInArrow, over the sums of one node: its ``g``, ``h``, ``n``, and ``b``, its best split (null without one): by gain, of equals the
    first feature, then the first place.

    Bins of a number are tried in their order, those of a category by their mean gradient. Missing values go to either side; where a
    node has none of a feature, rows that come without it later go to the larger side.
    """

    def part(g, h):
        return (g / UNIT) * (g / UNIT) / (h / UNIT + how.l2)

    def run(sums: pa.Table) -> pa.Table:
        k, node, f, b = (sums.column(c).to_numpy() for c in ("k", "node", "f", "bin"))
        keys, at = np.unique(np.stack([f, b]), axis=1, return_inverse=True)
        all_sums = np.zeros((3, keys.shape[1]), np.int64)
        for into, c in zip(all_sums, "ghn"):
            x = sums.column(c).to_numpy()
            _small(np.bincount(f, np.abs(x)).max())
            np.add.at(into, at.reshape(-1), x)
        # every feature's bins hold all rows of the node
        total, best, split = all_sums[:, keys[0] == keys[0, 0]].sum(axis=1), 0.0, None
        for feature in np.unique(keys[0]):
            mine = keys[0] == feature
            bins, part_sums = keys[1, mine], all_sums[:, mine]
            missing, bins, seen = part_sums[:, bins < 0].sum(axis=1), bins[bins >= 0], part_sums[:, bins >= 0]
            if feature >= n_numbers:
                weight = seen[1] + how.smooth * UNIT
                order = np.lexsort((bins, np.where(weight > 0, seen[0] / np.where(weight > 0, weight, 1.0), 0.0)))
                bins, seen = bins[order], seen[:, order]
            # by place, and with missing values on the left before it is tried without
            left = np.stack([seen.cumsum(axis=1) + x[:, None] for x in ((missing, 0 * missing) if missing[2] else (0 * missing,))], axis=2)
            right = total[:, None, None] - left
            enough = (np.minimum(left[2], right[2]) >= how.least_rows) & (np.minimum(left[1], right[1]) >= how.least_hessian * UNIT)
            if not enough.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(enough, part(left[0], left[1]) + part(right[0], right[1]) - part(total[0], total[1]), 0.0)
            place, way = np.unravel_index(gain.argmax(), gain.shape)
            if gain[place, way] > best:
                one, rest = left[:, place, way], right[:, place, way]
                side = way == 0 if missing[2] else one[2] >= rest[2]
                lefts = sorted(map(int, bins[: place + 1])) if feature >= n_numbers else None
                best = gain[place, way]
                split = {"feature": int(feature), "bin": int(bins[place]), "missing_left": bool(side), "categories": lefts, **dict(zip("ghn", map(int, one)))}
        row = {"k": [int(k[0])], "node": [int(node[0])], **{c: [int(x)] for c, x in zip("ghn", total)}, "b": [split]}
        kinds = pa.struct([("feature", pa.int32()), ("bin", pa.int32()), ("missing_left", pa.bool_()), ("categories", pa.list_(pa.int32())), *((c, pa.int64()) for c in "ghn")])
        return pa.table(row, pa.schema([("k", pa.int32()), ("node", pa.int32()), *((c, pa.int64()) for c in "ghn"), ("b", kinds)]))

    return run


def _grown(rows: DataFrame, scoring: _Scoring, width: int, n_numbers: int, how: Boosting) -> dict[int, list[list[dict]]]:
    """By model the trees of one round, a tree a score, level by level."""
    n_scores = scoring.n_scores
    leaf = lambda g, h, n: {"feature": None, "bin": None, "missing_left": None, "categories": None, "value": -how.rate * g / (h + how.l2 * UNIT) if h + how.l2 * UNIT > 0 else 0.0, "rows": n}
    trees: dict[int, list[list[dict | None]]] = {m: [[None] * (2 ** (how.depth + 1) - 1) for _ in range(n_scores)] for m in scoring.trees}
    nodes = [(m * n_scores + k, 0) for m in trees for k in range(n_scores)]
    tasks, best = rows.sparkSession.sparkContext.defaultParallelism, best_split(how, n_numbers)
    at_once = max(1, CELLS // (scoring.n_features * width))
    for level in range(how.depth):
        so_far, found = {m: [_tree(tree, width) for tree in of_model] for m, of_model in trees.items()}, []
        for i in range(0, len(nodes), at_once):
            some = nodes[i : i + at_once]
            sums = rows.mapInArrow(scoring.sums(so_far, level, some, width), SUMS).repartition(min(-(-len(some) // 8), tasks), "k", "node")
            found += sums.groupBy("k", "node").applyInArrow(best, SPLITS).collect()
        nodes = []
        for r in found:
            tree, i, b = trees[r["k"] // n_scores][r["k"] % n_scores], r["node"], r["b"]
            tree[i] = leaf(r["g"], r["h"], r["n"])
            if b is None:
                continue
            tree[i] |= {c: b[c] for c in ("feature", "bin", "missing_left", "categories")}
            tree[2 * i + 1] = leaf(b["g"], b["h"], b["n"])
            tree[2 * i + 2] = leaf(r["g"] - b["g"], r["h"] - b["h"], r["n"] - b["n"])
            nodes += [(r["k"], 2 * i + 1), (r["k"], 2 * i + 2)]
        if not nodes:
            break
        nodes.sort()
    empty = leaf(0, 0, 0)
    return {m: [[node or empty for node in tree] for tree in of_model] for m, of_model in trees.items()}


def fit(
    rows: DataFrame, target: str, numbers: Sequence[str], categories: Sequence[str] = (), labels: Sequence | None = None,
    weight: str | None = None, key: str | None = None, how: Boosting = Boosting(),
) -> Boosted:
    """A model of ``target``: squared error, or with ``labels`` (all classes, in order) softmax. Rows without a target are left out.

    ``weight`` multiplies a row's gradients. With ``how.patience``, rows are held out by a hash of ``key``: rows that agree in it are on one side.
    NaN counts as missing. Of categories beyond ``how.bins`` values, the rarest count as missing.
    """
    return _fit(rows.withColumn("_m", F.lit(0)), 1, target, numbers, categories, labels, weight, key, how)[0]


def fit_folds(
    rows: DataFrame, folds: int, target: str, numbers: Sequence[str], categories: Sequence[str] = (), labels: Sequence | None = None,
    weight: str | None = None, key: str | None = None, how: Boosting = Boosting(),
) -> list[Boosted]:
    """For each fold the model that ``fit`` gives for the rows of the other folds (``fold``). They grow together, so that jobs don't multiply."""
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda m: m != F.col("fold")))
    return _fit(rows.withColumn("_m", others), folds, target, numbers, categories, labels, weight, key, how)


def _fit(
    rows: DataFrame, n_models: int, target: str, numbers: Sequence[str], categories: Sequence[str], labels: Sequence | None,
    weight: str | None, key: str | None, how: Boosting,
) -> list[Boosted]:
    """A model for each number ``_m`` that rows have."""
    value = F.col(f"`{target}`")
    if labels is None:
        known = rows.where(value.isNotNull() & ~F.isnan(value.cast("double"))).withColumn("_y", value.cast("double"))
    else:
        known = rows.withColumn("_y", (F.array_position(F.array(*map(F.lit, labels)), value) - 1).cast("double")).where("_y >= 0")
    known = known.withColumn("_w", F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0))
    if how.patience and not key:
        raise ValueError("rows are held out by a key")
    held = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(100)) < how.held_percent if how.patience else F.lit(False)
    known = known.withColumn("_held", held)
    learned = known.where("not _held")
    starts = _starts(learned, n_models, labels)
    edges = _bins(learned, n_models, numbers, categories, how.bins)
    models = [Boosted(list(numbers), list(categories), e, None if labels is None else list(labels), s, how.depth) for e, s in zip(edges, starts)]
    of_model = lambda found: F.coalesce(*[F.when(F.col("_m") == m, x) for m, x in enumerate(found)])
    binned = known.select(F.col("_m").alias("m"), F.col("_y").alias("y"), F.col("_w").alias("w"), F.col("_held").alias("held"), of_model([x.binned() for x in models]).alias("bins"), "_m")
    # rows of a model that agree in all of these have one score in every round: a row stands for them
    binned = binned.groupBy("_m", "m", "y", "w", "held", "bins").agg(F.count(F.lit(1)).alias("n"))
    binned = binned.select("m", "y", "w", "held", "n", "bins", of_model([_literal(s, "array<double>") for s in starts]).alias("have"))
    binned, since, active, width = stored(binned, "binned"), 0, list(range(n_models)), max(x.width for x in models)
    for done in itertools.count():
        mine = F.col("m").isin(active)
        scoring = lambda: _Scoring({m: models[m].arrays(since, width) for m in active}, labels is not None, len(starts[0]), len(edges[0]), how.depth)
        if done and done % how.write_every == 0:
            binned, since = stored(binned.where(mine).mapInArrow(scoring().write, binned.schema), "binned"), done
        if how.patience:
            for m, loss in _losses(binned.where(mine & F.col("held")), scoring()).items():
                models[m].losses.append(loss)
            active = [m for m in active if not _stalled(models[m].losses, how)]
        if done == how.rounds or not active:
            return models
        grown = _grown(binned.where(F.col("m").isin(active) & ~F.col("held")), scoring(), width, len(numbers), how)
        active = [m for m in active if any(tree[0]["feature"] is not None for tree in grown[m])]
        for m in active:
            models[m].trees.append(grown[m])
        if not active:
            return models


def _starts(learned: DataFrame, n_models: int, labels: Sequence | None) -> list[list[float]]:
    """By model the scores before the first tree: the mean, or the logarithms of the classes' shares."""
    if labels is None:
        # a mean in whole units, as gradients are
        sums = learned.groupBy("_m").agg(F.sum("_w"), F.sum(F.round(F.col("_w") * F.col("_y") * UNIT).cast("decimal(38,0)")))
        found = {m: float(s) / UNIT / n for m, n, s in sums.collect() if n}
        return [[found.get(m, 0.0)] for m in range(n_models)]
    shares = {(m, int(y)): w for m, y, w in learned.groupBy("_m", "_y").agg(F.sum("_w")).collect()}
    every = [sum(w for (i, _), w in shares.items() if i == m) for m in range(n_models)]
    return [[math.log(max(shares.get((m, k), 0.0) / n, 1e-9)) if n else 0.0 for k in range(len(labels))] for m, n in enumerate(every)]


def _losses(held: DataFrame, scoring: _Scoring) -> dict[int, float]:
    """By model the mean loss on held-out rows, of a sum a task."""
    found = held.mapInArrow(scoring.loss, "m int, loss double, weight double").collect()
    sums = {m: [math.fsum(r[c] for r in found if r["m"] == m) for c in ("loss", "weight")] for m in scoring.trees}
    return {m: loss / n if n else math.inf for m, (loss, n) in sums.items()}


def _stalled(losses: list[float], how: Boosting) -> bool:
    """None of the last ``patience`` losses is lower than the one before them."""
    if len(losses) <= how.patience:
        return False
    *_, before = losses[: -how.patience]
    return not any(x < before - how.tolerance for x in losses[-how.patience :])
