"""Boosted trees as plain data: growth with patience, monotone projection, and exact Shapley values.

MLlib fits the trees; its nodes are read once (a model has a bounded number) and compiled into column
expressions, so scoring and explaining stay inside Spark's projections.
"""
from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FEATURE_COLUMNS, MONOTONE_SIGNS, TARGET_LOG
from ..session import materialize, scratch_path

#: Cells of one table of Shapley values are 2 to the power of this at most.
TABLE_BITS = 8


@dataclass(frozen=True)
class Node:
    """A leaf (``left`` is None) or a split: rows with ``feature <= threshold`` go left, others and NaN right.

    ``cover`` is the number of training rows that reached the node.
    """
    cover: float
    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None

    def leaves(self):
        if self.left is None:
            yield self
        else:
            yield from self.left.leaves()
            yield from self.right.leaves()

    def mean(self) -> float:
        return sum(x.cover * x.value for x in self.leaves()) / sum(x.cover for x in self.leaves())


def _number(x: float) -> str:
    """``x`` as a SQL literal of the same double."""
    x = float(x)
    return f"{x!r}D" if math.isfinite(x) else f"cast('{x}' as double)"


@dataclass(frozen=True)
class Ensemble:
    """``sum(weight * tree(x))`` over ``features``, as ``trees`` of (weight, root)."""
    trees: tuple[tuple[float, Node], ...]
    features: tuple[str, ...] = field(default_factory=lambda: tuple(FEATURE_COLUMNS))

    def prefix(self, n: int) -> "Ensemble":
        return replace(self, trees=self.trees[:n])

    def expected(self) -> float:
        """Mean prediction over the training rows of each tree: the base of the Shapley values."""
        return sum(w * t.mean() for w, t in self.trees)

    def _meets(self, feature: int, threshold: float) -> str:
        return f"coalesce(cast(`{self.features[feature]}` as double), cast('NaN' as double)) <= {_number(threshold)}"

    def terms(self) -> list[Column]:
        """The weighted prediction of each tree, one SQL text per tree: a column call per node takes the driver longer
        than a batch of trees takes to score a million rows."""
        def expr(node: Node, weight: float) -> str:
            if node.left is None:
                return _number(weight * node.value)
            return (f"CASE WHEN {self._meets(node.feature, node.threshold)} THEN {expr(node.left, weight)} "
                    f"ELSE {expr(node.right, weight)} END")
        return [F.expr(expr(t, w)) for w, t in self.trees]

    def score(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, sum(self.terms(), F.lit(0.0)))


def from_mllib(model, features=FEATURE_COLUMNS) -> Ensemble:
    """The trees of a fitted ``GBTRegressionModel`` or ``DecisionTreeRegressionModel``.

    Read from the saved model: one small table of nodes, whose size the model's parameters bound.
    """
    from pyspark.sql import SparkSession
    spark = SparkSession.active()
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    model.write().save(path)
    table = spark.read.parquet(f"{path}/data")
    rows = table.collect()
    weights = list(getattr(model, "treeWeights", [1.0]))
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    nodes: dict = {}
    for r in rows:
        tree, n = (r["treeID"], r["nodeData"]) if "treeID" in table.columns else (0, r)
        nodes[tree, n["id"]] = n

    def build(tree: int, at: int) -> Node:
        n = nodes[tree, at]
        if n["leftChild"] < 0:
            return Node(float(n["rawCount"]), n["prediction"])
        return Node(float(n["rawCount"]), n["prediction"], n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0],
                    build(tree, n["leftChild"]), build(tree, n["rightChild"]))

    return Ensemble(tuple((float(w), build(i, 0)) for i, w in enumerate(weights)), tuple(features))


# ---- MOD5: monotone projection ----------------------------------------------------------------

def _clip(node: Node, low: float, high: float) -> Node:
    if node.left is None:
        return replace(node, value=min(max(node.value, low), high))
    return replace(node, left=_clip(node.left, low, high), right=_clip(node.right, low, high))


def pooled_level(lower: list[Node], upper: list[Node]) -> float:
    """The level m that costs least in squared error when ``lower`` is cut to at most m and ``upper`` to at least m.

    The cost is convex; its slope is zero where m is the weighted mean of the leaves beyond m (adjacent
    violators are pooled).
    """
    cuts = sorted({x.value for x in lower} | {x.value for x in upper})

    def beyond(m):
        return [x for x in lower if x.value > m] + [x for x in upper if x.value < m]

    def slope(m):
        return sum(x.cover * (m - x.value) for x in beyond(m))

    for a, b in zip(cuts, cuts[1:]):
        if slope(a) <= 0 <= slope(b):
            pool = beyond((a + b) / 2)
            return sum(x.cover * x.value for x in pool) / sum(x.cover for x in pool) if pool else (a + b) / 2
    return cuts[-1] if slope(cuts[-1]) < 0 else cuts[0]


def monotone(node: Node, signs) -> Node:
    """``node`` with leaf values changed so that it obeys ``signs[feature]`` (1 rising, -1 falling, 0 free).

    From the leaves up: at a split on a constrained feature whose sides overlap, the lower side is cut to at
    most, and the upper side to at least, the pooled level.  Cutting keeps what holds inside a side, and two
    rows that differ in one feature part at a split on it, so the tree as a whole is monotone.
    """
    if node.left is None:
        return node
    left, right = monotone(node.left, signs), monotone(node.right, signs)
    sign = signs[node.feature]
    if sign:
        low, high = (left, right) if sign > 0 else (right, left)
        if max(x.value for x in low.leaves()) > min(x.value for x in high.leaves()):
            m = pooled_level(list(low.leaves()), list(high.leaves()))
            low, high = _clip(low, -math.inf, m), _clip(high, m, math.inf)
        left, right = (low, high) if sign > 0 else (high, low)
    return replace(node, left=left, right=right)


def project_monotone(model: Ensemble, signs=MONOTONE_SIGNS) -> Ensemble:
    """MOD5: every tree made monotone; with weights that are not negative the sum is monotone too."""
    return replace(model, trees=tuple((w, monotone(t, signs)) for w, t in model.trees))


# ---- MOD4: growth with patience -----------------------------------------------------------------

def staged_errors(df: DataFrame, model: Ensemble, label: str, base: str | None = None) -> list[float]:
    """Mean absolute error of every prefix of the ensemble (first: no tree), in one pass over ``df``.

    Every row keeps a running sum over its trees in an array, to which ``base`` is added if given.
    """
    start = F.col(base) if base else F.lit(0.0)
    running = F.aggregate(F.array(*model.terms()) if model.trees else F.array().cast("array<double>"), F.array(start),
                          lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    rows = df.select(F.col(label).alias("_label"), running.alias("_sums"))
    each = rows.select(F.posexplode(F.transform("_sums", lambda s: F.abs(F.col("_label") - s))).alias("_n", "_error"))
    return [r["_mae"] for r in each.groupBy("_n").agg(F.avg("_error").alias("_mae")).orderBy("_n").collect()]


def best_prefix(errors: list[float], patience: int) -> tuple[int, bool]:
    """(best prefix, whether to stop): growth stops once ``patience`` trees brought nothing better."""
    best = 0
    for n, e in enumerate(errors):
        if e < errors[best]:
            best = n
        elif n - best >= patience:
            return best, True
    return best, False


def boost(train: DataFrame, key: str, params: dict | None = None, rounds: int = 2000, patience: int = 50, signs=None,
          label: str = TARGET_LOG, features=FEATURE_COLUMNS, seed: int = 42) -> tuple[Ensemble, list[float]]:
    """MOD4: boosted trees grown until ``patience`` trees bring no better validation error, cut at the best prefix.

    The validation slice is the 10 % of rows with the largest keyed draws.  MLlib fits ``patience`` trees at a
    time on what is left of the label; with ``signs`` each batch is made monotone before the next one, which
    thus corrects what the projection costs.  Returns the ensemble and the validation error of every prefix.
    """
    from pyspark.ml.regression import GBTRegressor
    from ..functions.expr import keyed_uniform
    from .features import feature_matrix
    rows = train.select(*features, F.col(label).cast("double").alias("_y"), F.lit(0.0).alias("_p"),
                        (keyed_uniform(key, "validation", seed) >= 0.9).alias("_val"))
    model, errors, at = Ensemble((), tuple(features)), [], 0
    while len(model.trees) < rounds:
        rows = materialize(rows, "boost-rows")
        data = feature_matrix(rows.where(~F.col("_val")), features).select("features", (F.col("_y") - F.col("_p")).alias("label"))
        gbt = GBTRegressor(featuresCol="features", labelCol="label", seed=seed + len(model.trees),
                           maxIter=min(patience, rounds - len(model.trees)), **(params or {}))
        data = data.persist()  # a fit reads its rows three times before it has them binned
        try:
            grown = from_mllib(gbt.fit(data), features)
        finally:
            data.unpersist()
        if signs is not None:
            grown = project_monotone(grown, signs)
        later = staged_errors(rows.where("_val"), grown, "_y", "_p")
        errors += later if not errors else later[1:]
        model = replace(model, trees=model.trees + grown.trees)
        at, stop = best_prefix(errors, patience)
        if stop or not later:  # without validation rows there is nothing to wait for
            break
        rows = rows.withColumn("_p", F.col("_p") + sum(grown.terms(), F.lit(0.0)))
    return model.prefix(at if errors else len(model.trees)), errors


# ---- SCO8-SCO9: Shapley values of trees ---------------------------------------------------------

def _leaf_paths(node: Node, path=()):
    """(conditions (feature, threshold, goes left, share of rows), leaf) of every leaf below ``node``."""
    if node.left is None:
        yield path, node
        return
    for child, left in ((node.left, True), (node.right, False)):
        yield from _leaf_paths(child, (*path, (node.feature, node.threshold, left, child.cover / node.cover)))


def _leaf_shares(path, value: float, met: np.ndarray) -> dict[int, np.ndarray]:
    """Shapley value of each feature on one path, for rows given by which of its conditions they meet.

    A feature in the coalition counts as 1 if all its conditions are met and else 0; one outside counts as
    the share of training rows that follow the path at its splits.
    """
    names = sorted({f for f, *_ in path})
    own = {f: [i for i, c in enumerate(path) if c[0] == f] for f in names}
    inside = {f: met[:, own[f]].all(axis=1).astype(float) for f in names}
    outside = {f: math.prod(path[i][3] for i in own[f]) for f in names}
    n, out = len(names), {}
    for f in names:
        rest, total = [g for g in names if g != f], np.zeros(len(met))
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for chosen in combinations(rest, size):
                part = np.full(len(met), weight)
                for g in rest:
                    part = part * (inside[g] if g in chosen else outside[g])
                total += part
        out[f] = value * total * (inside[f] - outside[f])
    return out


def _tables(node: Node, weight: float, path=()):
    """(conditions (feature, threshold), feature -> value per cell) that together give a tree's Shapley values.

    The cell of a row has bit i set if it meets condition i.  Subtrees with more than ``TABLE_BITS`` conditions,
    those on the way to them included, are split at their root.
    """
    below = list(_leaf_paths(node, path))
    conditions = sorted({(f, t) for p, _ in below for f, t, *_ in p})
    if len(conditions) > TABLE_BITS and node.left is not None:
        for child, left in ((node.left, True), (node.right, False)):
            yield from _tables(child, weight, (*path, (node.feature, node.threshold, left, child.cover / node.cover)))
        return
    if not conditions:
        return
    at = {c: i for i, c in enumerate(conditions)}
    cells = np.arange(1 << len(conditions))[:, None] >> np.arange(len(conditions)) & 1 == 1
    total: dict[int, np.ndarray] = {}
    for p, leaf in below:
        met = np.stack([cells[:, at[f, t]] == left for f, t, left, _ in p], axis=1)
        for f, v in _leaf_shares(p, weight * leaf.value, met).items():
            total[f] = total.get(f, 0.0) + v
    yield conditions, total


def with_shapley(df: DataFrame, model: Ensemble, prefix: str = "_phi_") -> DataFrame:
    """SCO8: path-dependent Shapley values of the ensemble as one column per feature (``prefix`` + its name).

    They add up to the prediction minus ``model.expected()``.  A tree becomes a few tables with a cell per
    outcome of its conditions; a row looks up its cells, so nothing is shuffled and no Python runs.
    """
    cells, parts = {}, {f: [] for f in model.features}
    for w, t in model.trees:
        for conditions, values in _tables(t, w):
            name = f"_cell_{len(cells)}"
            cells[name] = F.expr(" + ".join(f"cast({model._meets(f, x)} as int) * {1 << i}" for i, (f, x) in enumerate(conditions)))
            for f, v in values.items():
                table = ",".join(map(repr, v.tolist()))
                parts[model.features[f]].append(F.expr(f"get(cast(split('{table}', ',') as array<double>), {name})"))
    out = df.withColumns(cells) if cells else df
    out = out.withColumns({prefix + f: sum(p, F.lit(0.0)) for f, p in parts.items()})
    return out.drop(*cells)
