"""Boosted trees as data: staged errors, monotone projection, Shapley values and the search, against brute force."""
import math
import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from riskframe.operators import model as MD
from riskframe.operators import trees as T
from riskframe.operators.search import Dimension, ParzenSampler, rung_plan, search

NAMES = ("a", "b", "c")


def random_tree(rng, depth, features=3, cover=64.0):
    if depth == 0 or rng.random() < .15:
        return T.Node(cover, rng.uniform(-2, 2))
    share = rng.uniform(.2, .8)
    return T.Node(cover, 0.0, rng.randrange(features), rng.choice([-1.0, 0.0, 0.5, 1.0]),
                  random_tree(rng, depth - 1, features, cover * share), random_tree(rng, depth - 1, features, cover * (1 - share)))


def predict(node, x):
    while node.left is not None:
        node = node.left if x[node.feature] <= node.threshold else node.right
    return node.value


GRID = list(product([-2.0, -.5, .2, .7, 3.0], repeat=3))


@pytest.fixture(scope="module")
def grid(spark):
    rows = [(i, *x) for i, x in enumerate(GRID)] + [(1000, float("nan"), 0.2, None), (1001, None, None, None)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double").coalesce(1)


def as_row(r):
    return [math.inf if v is None or v != v else v for v in (r.a, r.b, r.c)]


def test_expressions_score_like_the_trees(grid):
    rng = random.Random(2)
    model = T.Ensemble(tuple((rng.uniform(0, 1), random_tree(rng, 3)) for _ in range(5)), NAMES)
    for r in model.score(grid).collect():
        assert r.prediction == pytest.approx(sum(w * predict(t, as_row(r)) for w, t in model.trees))
    assert all(r.prediction == 0 for r in model.prefix(0).score(grid).collect())


def test_terms_are_one_text_per_tree(grid, monkeypatch):
    values = [1e-320, -5e-324, 1.7976931348623157e308, -0.1, 1 / 3, 1e-5, -0.0, math.inf, -math.inf, math.nan]
    model = T.Ensemble(tuple((1.0, T.Node(2.0, 0.0, 0, t, T.Node(1.0, v), T.Node(1.0, 7.0)))
                             for v in values for t in (3.0, math.inf, -1e-320)), NAMES)
    calls, when, expr = [], F.when, F.expr
    monkeypatch.setattr(T.F, "when", lambda *a: calls.append("when") or when(*a))
    monkeypatch.setattr(T.F, "expr", lambda *a: calls.append("expr") or expr(*a))
    terms = model.terms()
    assert calls == ["expr"] * len(model.trees)
    for r in grid.where("id = 0 or id = 124").select("id", F.array(*terms).alias("v")).collect():  # a is -2.0 and 3.0
        want = [predict(t, [-2.0 if r.id == 0 else 3.0, 0.0, 0.0]) for _, t in model.trees]
        assert list(map(repr, r.v)) == list(map(repr, want))


def test_projection_is_monotone_and_leaves_monotone_trees_alone():
    rng = random.Random(5)
    for _ in range(200):
        signs = [rng.choice([-1, 0, 1]) for _ in range(3)]
        tree = random_tree(rng, 4)
        done = T.monotone(tree, signs)
        for x in GRID:
            for f, v in product(range(3), (-2.0, -.5, .2, .7, 3.0)):
                if signs[f] and v > x[f]:
                    y = [*x[:f], v, *x[f + 1:]]
                    assert (predict(done, y) - predict(done, x)) * signs[f] >= 0
        assert T.monotone(done, signs) == done
        assert T.monotone(tree, [0, 0, 0]) == tree


def test_pooled_level_costs_least():
    rng = random.Random(8)
    for _ in range(100):
        low, high = ([T.Node(rng.choice([1.0, 2.0, 5.0]), rng.uniform(-1, 1)) for _ in range(rng.randint(1, 4))] for _ in range(2))

        def cost(m):
            return (sum(x.cover * max(0.0, x.value - m) ** 2 for x in low) + sum(x.cover * max(0.0, m - x.value) ** 2 for x in high))
        best = min(cost(-1 + i / 1000) for i in range(2001))
        assert cost(T.pooled_level(low, high)) <= best + 1e-9


def conditional(node, x, known):
    """Mean prediction when only ``known`` features are known: others follow the training rows."""
    if node.left is None:
        return node.value
    if node.feature in known:
        return conditional(node.left if x[node.feature] <= node.threshold else node.right, x, known)
    return sum(c.cover * conditional(c, x, known) for c in (node.left, node.right)) / node.cover


def shapley_by_subsets(tree, x, n=3):
    out = []
    for f in range(n):
        rest, total = [g for g in range(n) if g != f], 0.0
        for k in range(n):
            w = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
            for s in combinations(rest, k):
                total += w * (conditional(tree, x, {*s, f}) - conditional(tree, x, set(s)))
        out.append(total)
    return out


@pytest.mark.parametrize("bits", [8, 2])
def test_shapley_equals_subset_enumeration(grid, monkeypatch, bits):
    monkeypatch.setattr(T, "TABLE_BITS", bits)
    rng = random.Random(11)
    model = T.Ensemble(tuple((rng.uniform(.1, 1), random_tree(rng, d)) for d in (0, 1, 2, 3, 4, 4)), NAMES)
    base = model.expected()
    for r in T.with_shapley(model.score(grid), model).collect():
        x, phi = as_row(r), [r._phi_a, r._phi_b, r._phi_c]
        want = [sum(w * v for (w, _), v in zip(model.trees, vs)) for vs in zip(*(shapley_by_subsets(t, x) for _, t in model.trees))]
        assert phi == pytest.approx(want, abs=1e-9)
        assert sum(phi) == pytest.approx(r.prediction - base, abs=1e-9)


def test_shapley_tables_are_one_text_each(grid, monkeypatch):
    rng = random.Random(12)
    model = T.Ensemble(tuple((1.0, random_tree(rng, 3)) for _ in range(6)), NAMES)
    calls, split = [], F.split
    monkeypatch.setattr(T.F, "split", lambda *a: calls.append(a) or split(*a))
    monkeypatch.setattr(T.F, "get", lambda *a: calls.append(a))
    T.with_shapley(grid, model)
    assert not calls


def test_drivers_are_worked_out_once_a_row(grid):
    from riskframe.operators.scoring import tree_drivers
    rng = random.Random(13)
    model = T.Ensemble(tuple((1.0, random_tree(rng, 3, features=2)) for _ in range(4)), NAMES)  # c has no values: ties at zero
    out = tree_drivers(grid, "id", model, 2)
    assert "Filter" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in out.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r["rank"], r.feature, repr(r.value), r.shap_value, r.direction))
    for r in T.with_shapley(grid, model).collect():
        top = sorted(NAMES, key=lambda f: (-abs(r[f"_phi_{f}"]), NAMES.index(f)))[:2]
        assert got[r.id] == [(i + 1, f, repr(r[f]), r[f"_phi_{f}"], "increases risk" if r[f"_phi_{f}"] > 0 else "reduces risk")
                             for i, f in enumerate(top)]
    assert len(got) == len(GRID) + 2


@pytest.fixture(scope="module")
def learnable(spark):
    """A target that three features explain, one of them against its sign in noise."""
    feats = MD.FEATURE_COLUMNS
    d = spark.range(600, numPartitions=2).withColumn("k", F.concat(F.lit("k"), F.col("id")))
    from riskframe.functions.expr import keyed_uniform
    d = d.withColumns({f: keyed_uniform("k", f, 1) for f in feats})
    y = 2 * F.col("age") + F.col("bmi") * F.col("smoker") - F.col("avg_daily_steps") + 0.3 * keyed_uniform("k", "noise", 1)
    return d.withColumn(MD.TARGET_LOG, y).coalesce(1).cache()


def test_growth_with_patience(learnable):
    model, errors = T.boost(learnable, "k", {"maxDepth": 2, "stepSize": 0.3}, rounds=40, patience=10, signs=MD.MONOTONE_SIGNS)
    assert 1 < len(model.trees) == errors.index(min(errors)) <= 40
    assert len(errors) <= 41
    from riskframe.functions.expr import keyed_uniform
    held = learnable.where(keyed_uniform("k", "validation", 42) >= 0.9)
    for n in (0, 1, len(model.trees) // 2, len(model.trees)):  # the staged errors are those of each prefix
        mae = model.prefix(n).score(held).agg(F.avg(F.abs(F.col(MD.TARGET_LOG) - F.col("prediction")))).first()[0]
        assert mae == pytest.approx(errors[n])
    assert errors[len(model.trees)] < 0.5 * errors[0]
    audit = MD.monotone_audit(model, learnable, delta=0.2).collect()
    assert len(audit) == sum(s != 0 for s in MD.MONOTONE_SIGNS) and all(r.violations == 0 for r in audit)


def test_a_fit_reads_its_rows_from_the_cache(learnable, monkeypatch):
    from pyspark.ml.regression import GBTRegressor
    seen, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, d: seen.append((d, d.is_cached)) or fit(self, d))
    T.boost(learnable, "k", {"maxDepth": 1}, rounds=4, patience=2)
    assert len(seen) == 2 and all(cached for _, cached in seen)
    assert not any(d.is_cached for d, _ in seen)  # nothing stays


def test_a_split_is_read_in_one_pass(learnable):
    split = MD.stratified_split(MD.quartile_strata(learnable), "k")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Aggregate", "Window", "Sort"))
    rows = split.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert {(r.n, r.t) for r in rows} == {(150, 30)} and len(rows) == 4


def test_best_prefix_stops_after_patience():
    def brute(errors, patience):
        for n in range(len(errors)):
            best = errors.index(min(errors[:n + 1]))
            if n - best >= patience:
                return best, True
        return errors.index(min(errors)), False
    rng = random.Random(3)
    for _ in range(300):
        errors = [rng.choice([.1, .2, .3, .4]) for _ in range(rng.randint(1, 12))]
        assert T.best_prefix(errors, 3) == brute(errors, 3)


def test_mllib_trees_are_read_whole(learnable):
    from pyspark.ml.regression import GBTRegressor
    data = MD._assembled(learnable)
    fitted = GBTRegressor(featuresCol="features", labelCol="label", maxIter=4, maxDepth=3, seed=1).fit(data)
    model = T.from_mllib(fitted)
    rows = model.score(fitted.transform(data).withColumnRenamed("prediction", "theirs")).collect()
    assert all(r.prediction == pytest.approx(r.theirs) for r in rows)
    assert all(t.cover == 600 for _, t in model.trees)


def test_sampler_moves_towards_good_points():
    space = (Dimension("x", 0.001, 1.0, log=True), Dimension("n", 1, 9, whole=True))
    s = ParzenSampler(space, warm=10, seed=4)
    loss = lambda p: (math.log10(p["x"]) + 2) ** 2 + (p["n"] - 7) ** 2 / 10
    for _ in range(12):
        for p in s.ask(5):
            assert 0.001 <= p["x"] <= 1 and p["n"] in range(1, 10)
            s.tell(p, loss(p))
    losses = [v for _, v in s.seen]
    assert sum(losses[-20:]) / 20 < sum(losses[:10]) / 10
    assert min(losses) < 0.1
    assert rung_plan(36, 5, 1 / 3) == [(4, 1), (12, 2), (36, 5)]


def test_search_sends_the_better_trials_on(learnable):
    best, table = search(MD._assembled(learnable), "k", n_trials=6, folds=2, rounds=4, batch=3, parallelism=2,
                         space=(Dimension("maxDepth", 1, 3, whole=True), Dimension("stepSize", 0.01, 0.35, log=True),
                                Dimension("featureSubsetStrategy", 0.5, 1.0)))
    rows = table.orderBy("trial").collect()
    assert [r.trial for r in rows] == list(range(6)) and sorted(r.rung for r in rows) == [0, 0, 0, 0, 1, 2]
    top = min((r for r in rows if r.rung == 2), key=lambda r: r.mae)
    assert best["maxDepth"] == top.maxDepth and best["maxIter"] == top.trees


def test_search_on_few_rows_starts_few_tasks(learnable, monkeypatch):
    from pyspark.ml.regression import GBTRegressor
    from riskframe.operators.search import TASK_ROWS, fit_layout
    assert fit_layout(600, 12) == (1, 24) and fit_layout(0, 2) == (1, 4)
    assert fit_layout(72_000, 12) == (2, 12) and fit_layout(100 * TASK_ROWS, 12) == (100, 4)
    seen, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, d: seen.append((d.rdd.getNumPartitions(), d.count())) or fit(self, d))
    data = MD._assembled(learnable.repartition(8))
    search(data, "k", n_trials=2, folds=2, rounds=1, batch=2, space=(Dimension("maxDepth", 1, 2, whole=True),
           Dimension("stepSize", 0.01, 0.35, log=True), Dimension("featureSubsetStrategy", 0.5, 1.0)))
    assert {n for n, _ in seen} == {1} and len({rows for _, rows in seen}) <= 2 and sum({rows for _, rows in seen}) == 600
