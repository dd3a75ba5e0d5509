"""MOD3: hyper-parameter search with Parzen estimators and rungs.

Trials are proposed in batches.  A batch is drawn from the density of good trials and ordered by the ratio of
good to bad density; its fits run as concurrent Spark jobs.  On a rung every trial has the same number of trees
and folds, and only the better part goes on to the next rung, with more of both.
"""
from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dimension:
    """A parameter between ``low`` and ``high``; ``log`` scales it, ``whole`` rounds it."""
    name: str
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inner(self, value: float) -> float:
        low, high, v = (math.log(x) if self.log else x for x in (self.low, self.high, value))
        return (v - low) / (high - low)

    def outer(self, u: float):
        low, high = (math.log(x) if self.log else x for x in (self.low, self.high))
        v = low + min(max(u, 0.0), 1.0) * (high - low)
        v = math.exp(v) if self.log else v
        return int(round(v)) if self.whole else v


#: The six of the reference's nine parameters that MLlib's boosted trees have.  It has none for L1 and L2 penalties
#: on leaf values nor for columns drawn per tree (``featureSubsetStrategy`` draws them per split).
SPACE = (
    Dimension("maxDepth", 3, 8, whole=True),
    Dimension("stepSize", 0.01, 0.35, log=True),
    Dimension("subsamplingRate", 0.6, 1.0),
    Dimension("featureSubsetStrategy", 0.5, 1.0),
    Dimension("minInstancesPerNode", 1, 15, whole=True),
    Dimension("minInfoGain", 1e-6, 1e-2, log=True),
)


def _log_density(u: float, centres: list[float], width: float) -> float:
    """Log of a Parzen density on [0, 1]: Gaussians at the centres, cut at the borders, and one flat part."""
    total = 1.0
    for c in centres:
        mass = 0.5 * (math.erf((1 - c) / width / math.sqrt(2)) - math.erf(-c / width / math.sqrt(2)))
        total += math.exp(-0.5 * ((u - c) / width) ** 2) / (width * math.sqrt(2 * math.pi) * mass)
    return math.log(total / (len(centres) + 1))


@dataclass
class ParzenSampler:
    """Proposes points of a space from earlier (point, loss) pairs.

    The ``share`` best pairs make the good density and the rest the bad one, per dimension; of ``draws`` points
    from the good density the one with the largest ratio of the two is proposed.  The first ``warm`` points are
    drawn evenly.
    """
    space: tuple[Dimension, ...] = SPACE
    share: float = 0.25
    warm: int = 10
    draws: int = 24
    seed: int = 42
    seen: list[tuple[dict, float]] = field(default_factory=list)

    def __post_init__(self):
        self._random = random.Random(self.seed)

    def tell(self, point: dict, loss: float) -> None:
        self.seen.append((point, loss))

    def ask(self, n: int) -> list[dict]:
        out: list[dict] = []
        ranked = sorted(self.seen, key=lambda x: x[1])
        if len(ranked) < self.warm:
            return [{d.name: d.outer(self._random.random()) for d in self.space} for _ in range(n)]
        cut = max(2, math.ceil(self.share * len(ranked)))
        good, bad = [p for p, _ in ranked[:cut]], [p for p, _ in ranked[cut:]]
        for _ in range(n):
            # points of this batch count as bad, so that it spreads
            out.append({d.name: self._propose(d, [p[d.name] for p in good], [p[d.name] for p in bad + out]) for d in self.space})
        return out

    def _propose(self, d: Dimension, good: list, bad: list):
        good, bad = [d.inner(x) for x in good], [d.inner(x) for x in bad]
        wide = [max(0.05, len(x) ** -0.2 * 0.3) if x else 1.0 for x in (good, bad)]
        best, most = 0.5, -math.inf
        for _ in range(self.draws):
            k = self._random.randrange(len(good) + 1)
            u = self._random.random() if k == len(good) else self._random.gauss(good[k], wide[0])
            u = min(max(u, 0.0), 1.0)
            gain = _log_density(u, good, wide[0]) - _log_density(u, bad, wide[1])
            if gain > most:
                best, most = u, gain
        return d.outer(best)


def rung_plan(rounds: int, folds: int, keep: float) -> list[tuple[int, int]]:
    """(trees, folds) per rung: a first look on one fold, a second on two, then everything."""
    return [(max(1, int(rounds * keep * keep)), 1), (max(1, int(rounds * keep)), min(2, folds)), (rounds, folds)]


#: Rows that one task of a fit reads.
TASK_ROWS = 50_000


def fit_layout(rows: int, cores: int, least: int = 4) -> tuple[int, int]:
    """(tasks per job of a fit, fits at once) for fits on ``rows`` rows.

    A fit is hundreds of jobs, one per level of each tree, which on a small table cost more to start than to
    run: few tasks per job, and so many fits side by side that the cores have work while others start theirs.
    Large tables keep all cores busy with ``least`` fits.
    """
    tasks = max(1, -(-rows // TASK_ROWS))
    return tasks, max(least, 2 * cores // tasks)


def search(train: DataFrame, key: str, n_trials: int = 50, folds: int = 5, rounds: int = 60, batch: int = 10,
           keep: float = 1 / 3, parallelism: int | None = None, seed: int = 42, space=SPACE) -> tuple[dict, DataFrame]:
    """(best parameters, trials) by mean absolute error over keyed folds.

    ``train`` has ``features`` and ``label``.  A trial's error on a rung is the mean over its folds of the best
    prefix, found by MLlib's one-pass staged evaluation, so the number of trees is not a parameter of its own.
    Proposals learn from the first rung; all trials start there and the best ``keep`` of them go on.
    ``parallelism`` is the number of fits at once (None: by :func:`fit_layout`).  Trials: trial, rung (last one
    reached), trees, mae and the parameters, one row per trial.
    """
    from pyspark.ml.regression import GBTRegressor
    from ..functions.expr import keyed_uniform
    from ..session import materialize
    rows = materialize(train.select("features", "label", F.floor(keyed_uniform(key, "fold", seed) * folds).cast("int").alias("fold")),
                       "search-rows")
    tasks, at_once = fit_layout(rows.count(), rows.sparkSession.sparkContext.defaultParallelism)
    parts = [tuple(rows.where(side).drop("fold").coalesce(tasks).persist() for side in (F.col("fold") != k, F.col("fold") == k))
             for k in range(folds)]

    def error(job):
        point, trees, k = job
        params = {**point, "featureSubsetStrategy": str(point["featureSubsetStrategy"])}
        fit, held = parts[k]
        model = GBTRegressor(featuresCol="features", labelCol="label", maxIter=trees, seed=seed, **params).fit(fit)
        errors = model.evaluateEachIteration(held, "absolute")
        best = min(range(len(errors)), key=errors.__getitem__)
        return errors[best], best + 1

    def rung(trials, trees, n, pool):
        jobs = [(t["point"], trees, k) for t in trials for k in range(n)]
        found = list(pool.map(error, jobs))
        for i, t in enumerate(trials):
            own = found[i * n:(i + 1) * n]
            t["mae"], t["trees"] = sum(e for e, _ in own) / n, round(sum(b for _, b in own) / n)

    sampler, trials = ParzenSampler(space, seed=seed), []
    plan = rung_plan(rounds, folds, keep)
    try:
        with ThreadPoolExecutor(parallelism or at_once) as pool:
            while len(trials) < n_trials:
                new = [{"trial": len(trials) + i, "point": p, "rung": 0}
                       for i, p in enumerate(sampler.ask(min(batch, n_trials - len(trials))))]
                rung(new, *plan[0], pool)
                for t in new:
                    sampler.tell(t["point"], t["mae"])
                trials += new
            left = trials
            for level, (trees, n) in enumerate(plan[1:], 1):
                left = sorted(left, key=lambda t: (t["mae"], t["trial"]))[:max(1, math.ceil(len(left) * keep))]
                for t in left:
                    t["rung"] = level
                rung(left, trees, n, pool)
    finally:
        for fit, held in parts:
            fit.unpersist()
            held.unpersist()
    best = min(left, key=lambda t: (t["mae"], t["trial"]))
    names = [d.name for d in space]
    schema = "trial int, rung int, trees int, mae double, " + ", ".join(f"{n} double" for n in names)
    table = [(t["trial"], t["rung"], t["trees"], float(t["mae"]), *(float(t["point"][n]) for n in names)) for t in trials]
    point = {**best["point"], "featureSubsetStrategy": str(best["point"]["featureSubsetStrategy"])}
    return {**point, "maxIter": best["trees"]}, rows.sparkSession.createDataFrame(table, schema)
