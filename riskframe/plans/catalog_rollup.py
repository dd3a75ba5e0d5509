"""Registered queries: individual rollups and the lab-derived training rows (AGG1-AGG15)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import LAB_FLAGS
from ..operators import rollup as R
from ..sources.fixtures import fixture
from .catalog_core import _SNAP_FLOATS, core_inputs, snapshot
from .oracle_sql import CORE_FIXTURES, SNAPSHOT_CTES, clip, j_normal, j_uniform, rnd, with_fixtures
from .registry import register

_SNAP = with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES)


@register("agg1_2_telemetry_rollup", oracle=_SNAP + "\nSELECT * FROM or_tele",
          floats=["avg_daily_steps", "step_volatility", "avg_resting_hr", "hr_trend", "avg_active_mins",
                  "avg_sleep_hours", "avg_spo2"])
def q_tele(spark, sf):
    """AGG1 + AGG2: per-employee telemetry means, step std-dev and resting-HR slope (one shuffle)."""
    return R.rollup_telemetry_with_trend(fixture(spark, sf, "fx_telemetry"))


@register("agg2_hr_trend", oracle=_SNAP + "\nSELECT employee_key, hr_trend FROM or_tele", floats=["hr_trend"])
def q_trend(spark, sf):
    """AGG2: least-squares slope of resting HR over the reading index (0 for a single reading)."""
    return R.hr_trend(fixture(spark, sf, "fx_telemetry"))


@register("agg3_claims_rollup", oracle=_SNAP + """
SELECT employee_key, total_claims, CAST(visit_count AS INTEGER) AS visit_count,
       CAST(hospitalized_count AS INTEGER) AS hospitalized_count FROM or_claims""", floats=["total_claims"])
def q_claims(spark, sf):
    """AGG3: claims total, event count and hospitalisations per employee."""
    return R.rollup_claims(fixture(spark, sf, "fx_clinical_events"))


@register("agg5_6_loss_ratio", oracle=_SNAP + """
SELECT employee_key, company_id, premium_share, loss_ratio, high_risk, chronic_count FROM or_snapshot""",
          floats=["premium_share", "loss_ratio"])
def q_lr(spark, sf):
    """AGG4-AGG6: rollups joined to the roster, premium share per head, loss ratio and high-risk flag."""
    emp, comp, tele, clin = core_inputs(spark, sf)
    df = R.join_rollups(emp, R.rollup_telemetry_with_trend(tele), R.rollup_claims(clin))
    df = R.loss_ratio(R.premium_share(df, emp, comp))
    return df.select("employee_key", "company_id", "premium_share", "loss_ratio", "high_risk", "chronic_count")


@register("agg8_lab_risk_counts", oracle=with_fixtures(["fx_lab_results"]) + """
SELECT unique_id, CAST(count(*) FILTER (WHERE risk_level = 'high') AS INTEGER) AS lab_high_count,
       CAST(count(*) FILTER (WHERE risk_level = 'medium') AS INTEGER) AS lab_medium_count,
       CAST(count(*) FILTER (WHERE status = 'outofrange') AS INTEGER) AS lab_oor_count,
       CAST(count(marker_code) AS INTEGER) AS lab_total_tests
FROM fx_lab_results GROUP BY unique_id""")
def q_lab_counts(spark, sf):
    """AGG8: per-user lab risk counts (exact, case-sensitive labels as in the reference)."""
    return R.lab_risk_counts(fixture(spark, sf, "fx_lab_results"))


_ACT_COLS = ["heart_health", "bone_health", "diabetes", "inflammation", "iron", "kidney_health", "liver_health",
             "thyroid_health", "vitamin_deficiency", "step_count", "steps_active_minutes", "distance_in_meters",
             "mindful_min", "total_active_minutes"]
_LATEST = with_fixtures(["fx_activity"]) + """
, latest AS (SELECT user_id, max(year) AS year, """ + ", ".join(
    f"arg_max({c}, year) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in _ACT_COLS) + " FROM fx_activity GROUP BY user_id)"


@register("agg9_latest_non_null", oracle=_LATEST + "\nSELECT * FROM latest",
          floats=["step_count", "steps_active_minutes", "distance_in_meters", "mindful_min", "total_active_minutes"])
def q_latest(spark, sf):
    """AGG9: latest value per user *per column*, skipping nulls (groupby-last semantics), by year."""
    return R.latest_non_null(fixture(spark, sf, "fx_activity"), "user_id", "year")


_FLAGMAP = R.ACTIVITY_FLAG_COLUMNS
_DAILY = _LATEST + """
, daily AS (SELECT user_id, """ + ", ".join(
    f"coalesce(CAST({c} = 'outofrange' AS INTEGER), 0) AS {f}" for c, f in _FLAGMAP.items()) + f""",
  greatest({rnd('coalesce(step_count, 0e0) / 365', 0)}, 0e0) AS avg_daily_steps,
  greatest({rnd('coalesce(total_active_minutes, 0e0) / 365', 1)}, 0e0) AS avg_active_mins,
  {rnd(clip('coalesce(mindful_min, 0e0) / 365 * 120 + 400', 100, 3000), 0)} AS step_volatility
  FROM latest)"""


@register("agg10_11_daily_metrics", oracle=_DAILY + "\nSELECT * FROM daily",
          floats=["avg_daily_steps", "avg_active_mins", "step_volatility"])
def q_daily(spark, sf):
    """AGG10 + AGG11: domain statuses -> 0/1 flags; yearly totals -> daily steps, active minutes, volatility."""
    d = R.annual_to_daily(R.domain_flags(R.latest_non_null(fixture(spark, sf, "fx_activity"), "user_id", "year"),
                                         _FLAGMAP))
    return d.select("user_id", *_FLAGMAP.values(), "avg_daily_steps", "avg_active_mins", "step_volatility")


def _poisson_sql(lam: str, u: str, kmax: int = 15) -> str:
    term = f"exp(-({lam}))"
    cdf = term
    parts = [f"CAST({u} > {cdf} AS INTEGER)"]
    for k in range(1, kmax):
        term = f"({term} * ({lam}) / {k})"
        cdf = f"({cdf} + {term})"
        parts.append(f"CAST({u} > {cdf} AS INTEGER)")
    return "(" + " + ".join(parts) + ")"


def _lab_rows_sql():
    k = "user_id"
    N = lambda name, m, s: j_normal(k, name, s, 42, "'0'", m)
    U = lambda name: j_uniform(k, name)
    n = "lab_domain_count"
    weights = {"lab_diabetes_flag": 0.25, "lab_heart_flag": 0.20, "lab_kidney_flag": 0.18, "lab_liver_flag": 0.12,
               "lab_inflammation_flag": 0.10, "lab_iron_flag": 0.05, "lab_bone_flag": 0.04, "lab_thyroid_flag": 0.03,
               "lab_vitamin_flag": 0.03}
    from ..functions.constants import LAB_WEIGHTS
    score = "0e0" + "".join(f" + {LAB_WEIGHTS[f]!r} * {f}" for f in LAB_FLAGS)
    return f"""
, l1 AS (SELECT *, CAST({" + ".join(LAB_FLAGS)} AS INTEGER) AS lab_domain_count FROM daily),
l2 AS (SELECT *, CAST(trunc({clip(f"{N('age', 34, 7)} + {n} * 1.8", 22, 62)}) AS INTEGER) AS age,
              {rnd(clip(f"{N('bmi', 23.5, 3.2)} + lab_heart_flag * 2.5 + lab_diabetes_flag * 3.0", 16, 42), 1)} AS bmi,
              CAST({U('smoker')} < {clip('0.08 + lab_inflammation_flag * 0.14 + lab_heart_flag * 0.1 + lab_liver_flag * 0.08', 0, 0.85)} AS INTEGER) AS smoker,
              lab_diabetes_flag AS diabetic, lab_heart_flag AS hypertension,
              CAST(lab_diabetes_flag + lab_heart_flag AS INTEGER) AS chronic_count FROM l1),
l3 AS (SELECT *, {rnd(clip(f"{N('avg_resting_hr', 70, 7)} + lab_heart_flag * 5 + smoker * 3 - avg_daily_steps / 3500", 55, 102), 1)} AS avg_resting_hr,
              {N('hr_trend', 0, 0.15)} AS hr_trend,
              {rnd(clip(N('avg_sleep_hours', 6.8, 0.75), 4.5, 9.5), 1)} AS avg_sleep_hours,
              {rnd(clip(f"{N('avg_spo2', 97.5, 0.5)} - smoker * 1.2", 90, 100), 1)} AS avg_spo2,
              least({_poisson_sql(f'1.5e0 + {n} * 0.55', U('visit_count'))}, 15) AS visit_count,
              CAST({U('hospitalized_count')} < {n} * 0.04 AS INTEGER) AS hospitalized_count,
              {rnd(score, 4)} AS lab_risk_score,
              {rnd(f"4500e0 + {U('premium_share')} * 7500e0", 0)} AS premium_share FROM l2),
l4 AS (SELECT *, greatest({rnd(f"expm1_x * premium_share * 0.16 * (0.65e0 + {U('noise')} * 0.75)", 2)}, 0e0) AS total_claims
       FROM (SELECT *, exp(lab_risk_score * 3.0 + {clip('1e0 - avg_daily_steps / 10000', 0, 1)} + smoker * 0.45 + chronic_count * 0.35) - 1e0 AS expm1_x FROM l3)),
lab_rows AS (SELECT 'REAL_' || CAST(user_id AS VARCHAR) AS employee_id, 'REAL_DATA' AS company_id, age,
                    CASE WHEN {U('gender')} < 0.54 THEN 'M' ELSE 'F' END AS gender, bmi, smoker, diabetic, hypertension,
                    CASE WHEN {U('job_category')} < 0.4 THEN 'desk' WHEN {U('job_category')} < 0.75 THEN 'field' ELSE 'manual' END AS job_category,
                    avg_daily_steps, step_volatility, avg_resting_hr, hr_trend, avg_active_mins, avg_sleep_hours, avg_spo2,
                    total_claims, visit_count, hospitalized_count, premium_share,
                    {clip(rnd('total_claims / premium_share', 4), 0, 120)} AS loss_ratio,
                    CAST({clip(rnd('total_claims / premium_share', 4), 0, 120)} > 1.2 AS INTEGER) AS high_risk, chronic_count,
                    lab_bone_flag, lab_diabetes_flag, lab_heart_flag, lab_inflammation_flag, lab_iron_flag, lab_kidney_flag,
                    lab_liver_flag, lab_thyroid_flag, lab_vitamin_flag, lab_domain_count, lab_risk_score FROM l4)"""


_LAB_ROWS = _DAILY + _lab_rows_sql()
_LAB_FLOATS = ["bmi", "avg_daily_steps", "step_volatility", "avg_resting_hr", "hr_trend", "avg_active_mins",
               "avg_sleep_hours", "avg_spo2", "total_claims", "premium_share", "loss_ratio", "lab_risk_score"]


@register("agg12_lab_training_rows", oracle=_LAB_ROWS + "\nSELECT * FROM lab_rows", floats=_LAB_FLOATS)
def q_lab_rows(spark, sf):
    """AGG12 (+AGG9-AGG11, AGG13): activity/lab users -> training rows with keyed jitter and Poisson visits."""
    return R.lab_training_rows(fixture(spark, sf, "fx_activity"))


_BODY = _LAB_ROWS[len(with_fixtures(["fx_activity"])):]


_REST = [c for c in R.SNAPSHOT_COLUMNS if c != "employee_key"]


@register("agg14_extend_training", oracle=with_fixtures(list(CORE_FIXTURES) + ["fx_activity"], SNAPSHOT_CTES) + _BODY
          + f"""
SELECT employee_key AS employee_id, {", ".join(_REST)} FROM or_snapshot
UNION ALL SELECT employee_id, {", ".join(_REST)} FROM lab_rows""",
          floats=[*_SNAP_FLOATS])
def q_extend(spark, sf):
    """AGG14: the snapshot extended with lab-derived rows, aligned to its columns."""
    base = snapshot(spark, sf).withColumnRenamed("employee_key", "employee_id")
    return R.extend_training(base, R.lab_training_rows(fixture(spark, sf, "fx_activity")))


@register("agg15_snapshot_summary", oracle=_SNAP + """
SELECT min(loss_ratio) AS lr_min, max(loss_ratio) AS lr_max, avg(loss_ratio) AS lr_mean,
       avg(CAST(high_risk AS DOUBLE)) * 100 AS high_risk_pct, avg(avg_daily_steps) AS mean_steps,
       avg(avg_resting_hr) AS mean_resting_hr, avg(CAST(diabetic AS DOUBLE)) * 100 AS diabetic_pct, count(*) AS rows
FROM or_snapshot""", floats=["lr_min", "lr_max", "lr_mean", "high_risk_pct", "mean_steps", "mean_resting_hr", "diabetic_pct"])
def q_summary(spark, sf):
    """AGG15: one-row sanity summary of the training snapshot."""
    return R.snapshot_summary(snapshot(spark, sf))
