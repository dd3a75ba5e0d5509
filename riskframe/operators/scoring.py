"""Scoring and explanation (SCO1-SCO11).

The model is a linear scorecard over the 31 ordered features (see
``operators.model``), so scoring is one projection inside whole-stage codegen
and per-feature contributions are exact Shapley values ``w * (x - mean(x))``.
Calibration is a one-row aggregate joined back by a broadcast cross join of
exactly one row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FEATURE_COLUMNS
from ..functions.expr import round_even
from ..functions.stats import exact_percentiles


# ---- SCO1-SCO4: calibration and bands -------------------------------------------

def fit_scorer(df: DataFrame, col: str = "log_pred", materialized: bool = False) -> DataFrame:
    """SCO1: 5th and 95th percentile (linear interpolation) of log predictions -> 1-row (p05, p95).

    Exact, by distributed selection (``functions.stats.exact_percentiles``): a
    few bucket-count passes instead of one task holding every distinct value.
    """
    return exact_percentiles(df, col, {"p05": 0.05, "p95": 0.95}, materialize_input=not materialized)


def hrs_expr(x, p05="p05", p95="p95") -> F.Column:
    """SCO2 core: clip((x - p05) / (p95 - p05) * 100, 0, 100); 50 on a degenerate scale."""
    x = F.col(x) if isinstance(x, str) else x
    scale = F.col(p95) - F.col(p05)
    degenerate = scale.isNull() | F.isnan(scale) | (F.abs(scale) < 1e-12)
    raw = F.least(F.greatest((x - F.col(p05)) / scale * 100.0, F.lit(0.0)), F.lit(100.0))
    return F.when(degenerate, F.lit(50.0)).otherwise(raw)


def score_hrs(df: DataFrame, scorer: DataFrame, col: str = "log_pred", out: str = "hrs",
              batch: bool = True) -> DataFrame:
    """SCO2: Health Risk Score.  The batch path rounds to 1 dp, the single-row path does not."""
    s = scorer.select("p05", "p95")
    h = hrs_expr(col)
    return (df.crossJoin(F.broadcast(s))
              .withColumn(out, round_even(h, 1) if batch else h)
              .drop("p05", "p95"))


def risk_band(c) -> F.Column:
    """SCO3: <30 Low, <60 Moderate, <80 High, else Critical."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.when(c < 30, "Low").when(c < 60, "Moderate").when(c < 80, "High").otherwise("Critical"))


def scorer_state(scorer: DataFrame) -> DataFrame:
    """SCO4: the scorer's persisted state as one row (p05, p95, fitted)."""
    return scorer.select("p05", "p95", F.lit(True).alias("fitted"))


def restore_scorer(state: DataFrame) -> DataFrame:
    """SCO4: the scorer of a saved state; a state that was never fitted has no bounds, so every score is 50."""
    fitted = F.coalesce(F.col("fitted"), F.lit(False))
    return state.select(*[F.when(fitted, F.col(c).cast("double")).alias(c) for c in ("p05", "p95")])


# ---- SCO5-SCO7: employee and company results -----------------------------------------

def predict_employees(scored: DataFrame, scorer: DataFrame, col: str = "log_pred", weights: dict | None = None,
                      means: DataFrame | None = None, n: int = 5) -> DataFrame:
    """SCO5: per employee: expm1 loss ratio (4 dp), HRS (1 dp; band from the unrounded value).

    With ``weights`` and ``means`` also ``top_drivers``: the n drivers of :func:`top_drivers` as an
    array, ranked inside the row.
    """
    s = scorer.select("p05", "p95")
    h = hrs_expr(col)
    out = (scored.crossJoin(F.broadcast(s))
                 .withColumn("_hrs", h)
                 .withColumn("predicted_loss_ratio", round_even(F.expm1(F.col(col)), 4))
                 .withColumn("health_risk_score", round_even(F.col("_hrs"), 1))
                 .withColumn("risk_band", risk_band("_hrs"))
                 .drop("p05", "p95", "_hrs"))
    if weights is None:
        return out
    out = with_contributions(out, weights, means)
    return out.withColumn("top_drivers", _ranked_drivers(n)).drop(*[f"_phi_{f}" for f in FEATURE_COLUMNS])


def predict_companies(scored: DataFrame, group: str = "company_id", hrs: str = "hrs",
                      col: str = "log_pred") -> DataFrame:
    """SCO6 + SCO7: company aggregate and band mix in one partial+final aggregate.

    employee_count, mean expm1 loss ratio (4 dp), mean of the 1-dp HRS (1 dp; band
    from the unrounded mean), and the four band percentages (1 dp).  The list of
    all scores is a table of its own (:func:`hrs_distribution`), as it grows with the company;
    :func:`company_result` adds the drivers.
    """
    h = F.col(hrs)
    pct = lambda cond: round_even(F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100.0, 1)
    agg = scored.groupBy(group).agg(
        F.count(F.lit(1)).alias("employee_count"),
        F.avg(F.expm1(F.col(col))).alias("_mlr"),
        F.avg(h).alias("_mhrs"),
        pct(h < 30).alias("low_risk_pct"),
        pct((h >= 30) & (h < 60)).alias("moderate_risk_pct"),
        pct((h >= 60) & (h < 80)).alias("high_risk_pct"),
        pct(h >= 80).alias("critical_risk_pct"),
    )
    return agg.select(
        group, "employee_count",
        round_even(F.col("_mlr"), 4).alias("mean_loss_ratio"),
        round_even(F.col("_mhrs"), 1).alias("mean_hrs"),
        risk_band("_mhrs").alias("risk_band"),
        "low_risk_pct", "moderate_risk_pct", "high_risk_pct", "critical_risk_pct",
    )


def band_mix(scored: DataFrame, group: str = "company_id", hrs: str = "hrs") -> DataFrame:
    """SCO7: four band percentages per group (1 dp)."""
    return predict_companies(scored, group, hrs).select(
        group, "low_risk_pct", "moderate_risk_pct", "high_risk_pct", "critical_risk_pct")


def company_result(companies: DataFrame, importance: DataFrame, group: str = "company_id", n: int = 5) -> DataFrame:
    """SCO6: the company rows with ``top_risk_drivers``: its n features of largest mean |contribution|
    (SCO9) in order, at most n entries per company."""
    drivers = importance.where(F.col("rank") <= n).groupBy(group).agg(F.sort_array(F.collect_list(
        F.struct("rank", "feature", "importance"))).alias("top_risk_drivers"))
    return companies.join(drivers, group, "left")


def hrs_distribution(scored: DataFrame, group: str = "company_id", hrs: str = "hrs", chunk: int = 10_000) -> DataFrame:
    """SCO6: all scores of every group in ascending order, ``chunk`` scores a row.

    Scores are ranked by :func:`functions.ranks.rank_within`, which spreads a large group over many
    tasks, and collected by (group, rank // chunk): no task holds more than ``chunk`` scores of a row.
    """
    from ..functions.ranks import rank_within
    r = rank_within(scored.select(group, F.col(hrs).alias("_hrs")), group, ["_hrs"])
    part = F.floor(F.col("_rank") / chunk).cast("long")
    return r.groupBy(group, part.alias("chunk")).agg(F.sort_array(F.collect_list("_hrs")).alias("hrs_distribution"))


# ---- SCO8-SCO10: explanations --------------------------------------------------------

def feature_means(df: DataFrame, features=FEATURE_COLUMNS) -> DataFrame:
    """Background means for the linear Shapley values (one row)."""
    return df.agg(*[F.avg(F.col(f).cast("double")).alias(f"_m_{f}") for f in features])


def with_contributions(df: DataFrame, weights: dict, means: DataFrame,
                       features=FEATURE_COLUMNS) -> DataFrame:
    """Exact linear Shapley contribution per feature: ``phi_f = w_f * (x_f - mean_f)``."""
    out = df.crossJoin(F.broadcast(means))
    for f in features:
        out = out.withColumn(f"_phi_{f}", F.lit(float(weights.get(f, 0.0))) * (F.col(f).cast("double") - F.col(f"_m_{f}")))
    return out.drop(*[f"_m_{f}" for f in features])


def top_drivers(df: DataFrame, key: str, weights: dict, means: DataFrame, n: int = 5,
                features=FEATURE_COLUMNS) -> DataFrame:
    """SCO8: top-n drivers per row by |contribution| with direction, as long rows.

    The ranking happens inside each row (sort an array of 31 structs, slice n),
    so there is no shuffle and no window.  Ties on |contribution| keep feature order.
    """
    c = with_contributions(df, weights, means, features)
    return driver_rows(c.select(key, _ranked_drivers(n, features).alias("top_drivers")), key)


def tree_drivers(df: DataFrame, key: str, model, n: int = 5) -> DataFrame:
    """SCO8 for boosted trees: top-n drivers per row by |Shapley value| of an ``operators.trees.Ensemble``.

    The array goes to the generator as an expression: for a column Spark puts a filter on its size in front,
    pushes it down to the scan and so works out all Shapley values there once more per use.
    """
    from .trees import with_shapley
    c = with_shapley(df.select(key, *model.features), model)
    return driver_rows(c, key, drivers=_largest_drivers(n, model.features))


def _ranked_drivers(n: int, features=FEATURE_COLUMNS) -> F.Column:
    """The n largest contributions of a row as an array of (feature, value, shap_value, direction)."""
    structs = [F.struct(F.abs(F.col(f"_phi_{f}")).alias("a"), F.lit(i).alias("i"), F.lit(f).alias("feature"),
                        F.col(f).cast("double").alias("value"), F.col(f"_phi_{f}").alias("shap_value"))
               for i, f in enumerate(features)]
    ranked = F.slice(F.array_sort(F.array(*structs), lambda x, y: F.when(x["a"] > y["a"], -1).when(x["a"] < y["a"], 1)
                                  .otherwise(x["i"] - y["i"])), 1, n)
    return F.transform(ranked, lambda d: F.struct(
        d["feature"].alias("feature"), d["value"].alias("value"), d["shap_value"].alias("shap_value"),
        F.when(d["shap_value"] > 0, "increases risk").otherwise("reduces risk").alias("direction")))


def _largest_drivers(n: int, features) -> F.Column:
    """:func:`_ranked_drivers` for contributions that are never null.

    Structs are sorted in their own order (largest first, then by position): a comparison written as a lambda is
    interpreted, some hundred times a row.
    """
    structs = [F.struct((-F.abs(F.col(f"_phi_{f}"))).alias("a"), F.lit(i).alias("i"), F.lit(f).alias("feature"),
                        F.col(f).cast("double").alias("value"), F.col(f"_phi_{f}").alias("shap_value"))
               for i, f in enumerate(features)]
    return F.transform(F.slice(F.sort_array(F.array(*structs)), 1, n), lambda d: F.struct(
        d["feature"].alias("feature"), d["value"].alias("value"), d["shap_value"].alias("shap_value"),
        F.when(d["shap_value"] > 0, "increases risk").otherwise("reduces risk").alias("direction")))


def driver_rows(df: DataFrame, *keep: str, drivers: str | F.Column = "top_drivers") -> DataFrame:
    """A driver array as rows: the columns to keep, rank from 1, feature, value, shap_value, direction."""
    return df.select(*keep, F.posexplode(drivers).alias("_pos", "_d")).select(
        *keep, (F.col("_pos") + 1).alias("rank"), "_d.*")


def global_importance(df: DataFrame, weights: dict, means: DataFrame, group: str | None = "company_id",
                      n: int = 5, features=FEATURE_COLUMNS) -> DataFrame:
    """SCO9: mean |contribution| per feature (per group), descending, top n.

    Aggregates wide first (31 partial+final averages per group), then unpivots
    the small per-group result and ranks it: the 31x row blow-up never happens
    on the employee-level data.
    """
    return mean_contributions(with_contributions(df, weights, means, features), group, n, features)


def tree_importance(df: DataFrame, model, group: str | None = "company_id", n: int = 5) -> DataFrame:
    """SCO9 for boosted trees: mean |Shapley value| of an ``operators.trees.Ensemble`` per feature, top n."""
    from .trees import with_shapley
    return mean_contributions(with_shapley(df, model), group, n, model.features)


def mean_contributions(c: DataFrame, group: str | None, n: int, features) -> DataFrame:
    """Mean |contribution| per feature of the ``_phi_`` columns of ``c``: feature, importance and rank, top n."""
    keys = [group] if group else []
    wide = c.groupBy(*keys).agg(*[F.avg(F.abs(F.col(f"_phi_{f}"))).alias(f) for f in features])
    long = wide.unpivot(keys or None, list(features), "feature", "importance") if keys else \
        wide.unpivot([], list(features), "feature", "importance")
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(F.desc("importance"), F.asc("feature")) if keys else \
        Window.orderBy(F.desc("importance"), F.asc("feature"))
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# ---- SCO11: scoring an upload ---------------------------------------------------------

def score_upload(requests: DataFrame, model, scorer: DataFrame, key: str = "employee_id") -> DataFrame:
    """SCO11: one row per upload row: HRS (1 dp), loss ratio (4 dp) and the band of the unrounded HRS.

    Rows that break a scoring rule (ING11) keep their reasons in ``errors`` and get no score.
    """
    from .features import engineer_features
    from .ingest import validate_scoring_input
    from .model import apply_scorecard
    checked = validate_scoring_input(requests)
    scored = predict_employees(apply_scorecard(engineer_features(checked), model), scorer)
    result = {"hrs": "health_risk_score", "loss_ratio": "predicted_loss_ratio", "risk_band": "risk_band"}
    return scored.select(key, "age", "gender", "bmi", "smoker", "diabetic", "hypertension", "job_category",
                         *[F.when(F.size("errors") == 0, F.col(c)).alias(n) for n, c in result.items()], "errors")


def upload_summary(rows: DataFrame, base_premium: float) -> DataFrame:
    """SCO11: one row for the scored rows of an upload: mean HRS (1 dp) and loss ratio (4 dp), shares of
    the rows' bands, and the band and premium that the unrounded mean HRS gives; nulls if none is scored."""
    from .pricing import adjust_premium
    def pct(band):
        return round_even(F.avg((F.col("risk_band") == band).cast("double")) * 100.0, 1).alias(f"{band.lower()}_risk_pct")
    a = rows.where(F.size("errors") == 0).agg(
        F.count(F.lit(1)).alias("employee_count"), F.avg("hrs").alias("_mean"),
        round_even(F.avg("loss_ratio"), 4).alias("mean_loss_ratio"), *map(pct, ("Low", "Moderate", "High", "Critical")))
    a = adjust_premium(a.withColumn("base_premium", F.lit(float(base_premium))), "base_premium", "_mean")
    return a.withColumn("mean_hrs", round_even(F.col("_mean"), 1)).withColumn(
        "risk_band", F.when(F.col("_mean").isNotNull(), risk_band("_mean"))).drop("_mean")


# Plain-language driver labels, as (feature, format, decimals);
# format None means the text has no number.
DRIVER_TEXT = [
    ("age", "Employee age (%s years)", 0),
    ("bmi", "BMI (%s)", 1),
    ("smoker", "Smoking status", None),
    ("diabetic", "Diabetes diagnosis", None),
    ("hypertension", "Hypertension diagnosis", None),
    ("chronic_count", "Number of chronic conditions (%s)", 0),
    ("avg_daily_steps", "Average daily steps (%s)", 0),
    ("step_volatility", "Irregular activity pattern", None),
    ("avg_resting_hr", "Resting heart rate (%s bpm)", 0),
    ("hr_trend", "Heart rate trend over time", None),
    ("avg_active_mins", "Daily active minutes (%s)", 0),
    ("avg_sleep_hours", "Average sleep (%s hours)", 1),
    ("avg_spo2", "Blood oxygen (%s%%)", 1),
    ("visit_count", "Clinical visits (%s)", 0),
    ("hospitalized_count", "Hospitalizations (%s)", 0),
    ("activity_score", "Overall activity score (%s)", 1),
    ("health_composite", "Combined chronic health burden", None),
]


def driver_text(drivers: DataFrame) -> DataFrame:
    """SCO10: plain-language explanation per driver row (label + direction)."""
    v = F.col("value")
    label = F.col("feature")
    for feat, fmt, dec in reversed(DRIVER_TEXT):
        txt = F.lit(fmt.replace("%%", "%")) if dec is None else \
            F.format_string(fmt.replace("%s", f"%.{dec}f"), round_even(v, dec))
        label = F.when(F.col("feature") == feat, txt).otherwise(label)
    return drivers.withColumn("explanation", F.concat_ws(" ", label, F.col("direction")))
