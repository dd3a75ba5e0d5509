"""Model fitting and evaluation (MOD1-MOD8) and the linear scorecard.

The reference fits gradient-boosted trees with monotone constraints.  The
default model here is a sign-constrained linear scorecard on the 31 ordered
features.  The challenger (``fit_gbt``) is an ensemble of MLlib trees that
``operators.trees`` grows with patience and makes monotone; both score as
column expressions and have exact explanations.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import FEATURE_COLUMNS, MONOTONE_SIGNS, TARGET_LOG


@dataclass
class Scorecard:
    """Linear model ``log1p(LR) = intercept + sum(w_f * x_f)``; at most one weight per feature."""
    weights: dict
    intercept: float
    features: list = field(default_factory=lambda: list(FEATURE_COLUMNS))

    def expr(self) -> F.Column:
        e = F.lit(float(self.intercept))
        for f in self.features:
            w = float(self.weights.get(f, 0.0))
            if w != 0.0:
                e = e + F.lit(w) * F.col(f).cast("double")
        return e

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(f, float(self.weights.get(f, 0.0)), i) for i, f in enumerate(self.features)]
        rows.append(("(intercept)", float(self.intercept), len(self.features)))
        return spark.createDataFrame(rows, "feature string, weight double, position int")


# The shipped default scorecard: hand-set weights whose signs follow the
# monotone contract (MONOTONE_SIGNS).  It plays the role of the reference's
# pickled model artifact; ``fit_scorecard`` refits it from data.
DEFAULT_SCORECARD = Scorecard(
    weights={
        "age": 0.004, "bmi": 0.006, "chronic_count": 0.05, "smoker": 0.08, "diabetic": 0.10,
        "hypertension": 0.07, "avg_daily_steps": -0.00002, "avg_resting_hr": 0.004, "hr_trend": 0.02,
        "avg_active_mins": -0.001, "avg_spo2": -0.01, "visit_count": 0.03, "hospitalized_count": 0.08,
        "activity_score": -0.002, "health_composite": 0.003, "smoker_diabetic": 0.05,
        "bmi_age_risk": 0.02, "clinical_burden": 0.01,
        "lab_heart_flag": 0.06, "lab_inflammation_flag": 0.03, "lab_diabetes_flag": 0.06,
        "lab_kidney_flag": 0.05, "lab_liver_flag": 0.04, "lab_iron_flag": 0.02,
        "lab_thyroid_flag": 0.02, "lab_bone_flag": 0.02, "lab_vitamin_flag": 0.02,
        "lab_domain_count": 0.01, "lab_risk_score": 0.10,
    },
    intercept=0.4,
)


def apply_scorecard(df: DataFrame, model: Scorecard = DEFAULT_SCORECARD, out: str = "log_pred") -> DataFrame:
    """Predicted log1p(loss ratio) as one projection."""
    return df.withColumn(out, model.expr())


def monotone_signs(spark: SparkSession) -> DataFrame:
    """MOD5: the 31-sign monotone contract as a table."""
    return spark.createDataFrame([(f, s, i) for i, (f, s) in enumerate(zip(FEATURE_COLUMNS, MONOTONE_SIGNS))],
                                 "feature string, sign int, position int")


# ---- MOD1-MOD2: strata and split -------------------------------------------------------------

def quartile_strata(df: DataFrame, y: str = TARGET_LOG, out: str = "stratum") -> DataFrame:
    """MOD1: target quartile strata with deduplicated edges (qcut semantics: right-closed,
    lowest edge included).  Quartiles equal to the minimum merge with it, so a target with many
    equal smallest values has fewer strata.  Edges are one exact selection, stored and joined back as one
    row, so that readers of the result do not repeat the selection."""
    from ..functions.stats import exact_percentiles
    from ..session import materialize
    e = exact_percentiles(df, y, {"_q0": 0.0, "_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    edges = e.select(F.array_except(F.array("_q1", "_q2", "_q3"), F.array("_q0")).alias("_edges"))
    d = df.crossJoin(F.broadcast(materialize(edges, "edges")))
    label = F.size(F.filter("_edges", lambda x: x < F.col(y)))
    return d.withColumn(out, label).drop("_edges")


def stratified_split(df: DataFrame, key: str, strata: str = "stratum", test_frac: float = 0.2, seed: int = 42,
                     out: str = "is_test") -> DataFrame:
    """MOD2: seeded split with an exact share of every stratum in the test set.

    ceil(test_frac * n) test rows are shared out over the strata in proportion to their sizes, the
    rows left by rounding down going to the largest remainders.  Inside a stratum the rows with the
    smallest keyed draws are taken: only (stratum, draw, key) is ranked, across range partitions, to
    find one cut per stratum, and every row is compared with its cut.  ``key`` identifies a row; rows
    with equal keys fall on the same side.  ``df`` is read three times, so it should be a stored table;
    the cuts are stored (one row per stratum), so reading the result is one pass over ``df``.
    """
    from pyspark.sql import Window
    from ..functions.expr import keyed_uniform
    from ..functions.ranks import rank_within
    from ..session import materialize
    d = df.withColumn("_u", keyed_uniform(key, "split", seed))
    sizes = d.groupBy(strata).agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy()  # one row per stratum
    total = F.sum("_n").over(every)
    test = F.ceil(total * F.lit(test_frac))
    share = F.col("_n").cast("decimal(18,0)") * F.col("_test").cast("decimal(18,0)")
    quota = (sizes.withColumn("_total", total).withColumn("_test", test)
                  .withColumn("_left", share % F.col("_total"))
                  .withColumn("_base", ((share - F.col("_left")) / F.col("_total")).cast("long"))
                  .withColumn("_more", F.row_number().over(Window.orderBy(F.desc("_left"), F.asc(strata)))
                              <= F.col("_test") - F.sum("_base").over(every))
                  .select(strata, (F.col("_base") + F.col("_more").cast("long")).alias("_quota")))
    ranked = rank_within(d.select(strata, "_u", F.col(key).alias("_row_key")), strata, ["_u", "_row_key"])
    cuts = ranked.join(F.broadcast(quota), strata).where("_rank = _quota - 1") \
                 .select(strata, F.col("_u").alias("_cut"), F.col("_row_key").alias("_cut_key"))
    inside = (F.col("_u") < F.col("_cut")) | ((F.col("_u") == F.col("_cut")) & (F.col(key) <= F.col("_cut_key")))
    return (d.join(F.broadcast(materialize(cuts, "cuts")), strata, "left").withColumn(out, F.coalesce(inside, F.lit(False)))
             .select(*df.columns, out))


# ---- MOD3-MOD5: fitting -----------------------------------------------------------------------

def _assembled(df: DataFrame, features=FEATURE_COLUMNS, label: str = TARGET_LOG) -> DataFrame:
    from .features import feature_matrix
    return feature_matrix(df, features).withColumn("label", F.col(label).cast("double"))


def tune(train: DataFrame, key: str, n_trials: int = 50, folds: int = 5, seed: int = 42, **limits):
    """MOD3: hyper-parameters of the boosted trees by Parzen search with rungs, minimising k-fold MAE.

    Returns (best parameters, DataFrame of trials); see :func:`operators.search.search`.
    """
    from .search import search
    return search(_assembled(train), key, n_trials, folds, seed=seed, **limits)


def fit_gbt(train: DataFrame, key: str, params: dict | None = None, rounds: int = 2000, patience: int = 50,
            monotone: bool = True, seed: int = 42):
    """MOD4 + MOD5: the boosted challenger, grown until ``patience`` trees bring no better error on the 10 % of
    rows with the largest keyed draws, every batch of trees obeying the monotone contract.

    Returns an :class:`operators.trees.Ensemble` and the validation error of every prefix.
    """
    from .trees import boost
    return boost(train, key, params, rounds, patience, MONOTONE_SIGNS if monotone else None, seed=seed)


def fit_scorecard(train: DataFrame, features=FEATURE_COLUMNS, label: str = TARGET_LOG, reg: float = 0.0) -> Scorecard:
    """Sign-constrained linear scorecard (MOD5 default model).

    Ordinary least squares on the 31 features; any feature whose weight has the
    wrong sign for the monotone contract (or is unconstrained-but-noisy) is
    dropped and the model refitted, until every weight agrees with its sign.
    The fit itself is a distributed normal-equation solve in MLlib.
    """
    from pyspark.ml.regression import LinearRegression
    signs = dict(zip(FEATURE_COLUMNS, MONOTONE_SIGNS))
    active = list(features)
    d = _assembled(train, features, label)
    while True:
        from pyspark.ml.feature import VectorAssembler
        va = VectorAssembler(inputCols=active, outputCol="_x", handleInvalid="keep")
        lr = LinearRegression(featuresCol="_x", labelCol="label", regParam=reg, solver="normal")
        m = lr.fit(va.transform(d.drop("features")))
        w = dict(zip(active, m.coefficients.toArray().tolist()))
        bad = [f for f, v in w.items() if signs.get(f, 0) != 0 and v * signs[f] < 0]
        if not bad:
            return Scorecard({f: float(v) for f, v in w.items()}, float(m.intercept), list(features))
        active = [f for f in active if f not in bad]


def scorecard_audit(model: Scorecard, spark: SparkSession) -> DataFrame:
    """MOD5 (scorecard): per feature weight, expected sign and whether it violates the contract."""
    rows = []
    for f, s in zip(FEATURE_COLUMNS, MONOTONE_SIGNS):
        w = float(model.weights.get(f, 0.0))
        rows.append((f, s, w, bool(s != 0 and w * s < 0)))
    return spark.createDataFrame(rows, "feature string, sign int, weight double, violation boolean")


def monotone_audit(model, df: DataFrame, delta: float = 1.0, features=FEATURE_COLUMNS) -> DataFrame:
    """MOD5 (GBT): perturb each constrained feature by +delta per row and count rows whose
    prediction moves against the feature's sign.  ``model`` is an ``operators.trees.Ensemble`` or an MLlib
    model.  Rows are predicted once as they are and carry that prediction through the unpivot, so nothing
    is joined back."""
    predict = model.score if hasattr(model, "score") else lambda d: model.transform(_assembled(d, features))
    signs = dict(zip(FEATURE_COLUMNS, MONOTONE_SIGNS))
    cons = [f for f in features if signs.get(f, 0) != 0]
    base = predict(df).select(*df.columns, F.col("prediction").alias("_p0"))
    pert = base.withColumn("_feat", F.explode(F.array(*[F.lit(f) for f in cons])))
    for f in cons:
        pert = pert.withColumn(f, F.when(F.col("_feat") == f, F.col(f).cast("double") + delta).otherwise(F.col(f).cast("double")))
    p = predict(pert).select("_p0", "_feat", F.col("prediction").alias("_p1"))
    sign = F.create_map(*[x for f in cons for x in (F.lit(f), F.lit(signs[f]))])
    j = p.withColumn("_s", F.element_at(sign, F.col("_feat")))
    viol = ((F.col("_p1") - F.col("_p0")) * F.col("_s")) < -1e-12
    return j.groupBy(F.col("_feat").alias("feature")).agg(F.first("_s").alias("sign"),
                                                          F.count_if(viol).alias("violations"),
                                                          F.count(F.lit(1)).alias("rows"))


# ---- MOD6-MOD8: evaluation ----------------------------------------------------------------------

def regression_metrics(df: DataFrame, y: str = TARGET_LOG, pred: str = "log_pred", split: str | None = "is_test") -> DataFrame:
    """MOD6: MAE, RMSE and R^2 (1 - SSE/SST) per split, in one aggregate pass (plus one for the mean)."""
    keys = [split] if split else []
    means = df.groupBy(*keys).agg(F.avg(y).alias("_ybar"))
    d = df.join(F.broadcast(means), keys) if keys else df.crossJoin(F.broadcast(means))
    e = F.col(y) - F.col(pred)
    a = d.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                             (F.lit(1.0) - F.sum(e * e) / F.sum((F.col(y) - F.col("_ybar")) ** 2)).alias("r2"),
                             F.count(F.lit(1)).alias("rows"))
    if split:
        a = a.withColumn("split", F.when(F.col(split), "test").otherwise("train")).drop(split)
    return a


def sanity_sample(scored: DataFrame, key: str, n: int = 5, split: str = "is_test") -> DataFrame:
    """MOD7: first n test rows (by key) with predicted vs actual LR, HRS and band."""
    from .scoring import risk_band
    d = scored.where(F.col(split)) if split in scored.columns else scored
    return d.orderBy(key).limit(n).select(
        key, F.expm1("log_pred").alias("predicted_lr"), F.col("loss_ratio").alias("actual_lr"), "hrs",
        risk_band("hrs").alias("risk_band"))


def run_record(spark: SparkSession, mode: str, metrics: DataFrame, scorer: DataFrame, source_rows: DataFrame,
               n_features: int = len(FEATURE_COLUMNS)) -> DataFrame:
    """MOD8: one run row: feature count, data mode, rows per source (as JSON, sources in order), metrics,
    calibration bounds."""
    m = metrics.groupBy().pivot("split", ["train", "test"]).agg(F.first("mae").alias("mae"), F.first("rmse").alias("rmse"),
                                                                F.first("r2").alias("r2"))
    src = source_rows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "rows")))))
                           .alias("rows_per_source"))
    return (m.crossJoin(scorer.select("p05", "p95")).crossJoin(src)
             .select(F.lit(n_features).alias("n_features"), F.lit(mode).alias("dataset_mode"), "*",
                     F.current_timestamp().alias("recorded_at")))


def append_run(record: DataFrame, path: str) -> DataFrame:
    """MOD8: append one run to the runs table at ``path`` and return the table; a run's number is its place in time."""
    from pyspark.sql import Window
    record.write.mode("append").parquet(path)
    runs = record.sparkSession.read.parquet(path)
    return runs.withColumn("run", F.row_number().over(Window.orderBy("recorded_at")).cast("int"))
