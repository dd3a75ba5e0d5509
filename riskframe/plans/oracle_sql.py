"""Independent DuckDB SQL for the oracle checks (shared CTE building blocks).

Written directly in SQL from the operator semantics; only model parameters
(scorecard weights) are taken from the Python side.
"""
from __future__ import annotations

from ..operators.model import DEFAULT_SCORECARD
from ..sources.fixtures import oracle_ctes


def rnd(x: str, d: int) -> str:
    """Half-even rounding of the double's shortest decimal form, as Spark's ``bround`` does.

    DuckDB's ``round_even`` on DOUBLE scales by 10^d first, which can create or
    break ties; rounding the exact decimal text avoids that.
    """
    return f"CAST(round_even(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)), {d}) AS DOUBLE)"


def _lit(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


SNAPSHOT_CTES = """
or_tele AS (
  SELECT employee_key,
         avg(avg_daily_steps) AS avg_daily_steps,
         stddev_samp(avg_daily_steps) AS step_volatility,
         avg(resting_hr) AS avg_resting_hr,
         CASE WHEN count(*) < 2 THEN 0e0 ELSE regr_slope(CAST(resting_hr AS DOUBLE), CAST(i AS DOUBLE)) END AS hr_trend,
         avg(active_minutes) AS avg_active_mins,
         avg(sleep_hours) AS avg_sleep_hours,
         avg(spo2) AS avg_spo2
  FROM (SELECT *, row_number() OVER (PARTITION BY employee_key ORDER BY month_no, ts, event_id) - 1 AS i
        FROM fx_telemetry) t
  GROUP BY employee_key),
or_claims AS (
  SELECT employee_key, sum(claim_amount) AS total_claims, count(event_id) AS visit_count,
         sum(hospitalized) AS hospitalized_count
  FROM fx_clinical_events GROUP BY employee_key),
or_counts AS (SELECT company_id, count(*) AS n FROM fx_employees GROUP BY company_id),
or_snap0 AS (
  SELECT e.employee_key, e.company_id, e.age, e.gender, e.bmi, e.smoker, e.diabetic, e.hypertension,
         e.job_category, t.avg_daily_steps, coalesce(t.step_volatility, 0e0) AS step_volatility,
         t.avg_resting_hr, coalesce(t.hr_trend, 0e0) AS hr_trend, t.avg_active_mins, t.avg_sleep_hours,
         t.avg_spo2, coalesce(c.total_claims, 0e0) AS total_claims,
         CAST(coalesce(c.visit_count, 0) AS INTEGER) AS visit_count,
         CAST(coalesce(c.hospitalized_count, 0) AS INTEGER) AS hospitalized_count,
         co.base_premium / k.n AS premium_share
  FROM fx_employees e
  LEFT JOIN or_tele t ON t.employee_key = e.employee_key
  LEFT JOIN or_claims c ON c.employee_key = e.employee_key
  LEFT JOIN fx_companies co ON co.company_id = e.company_id
  JOIN or_counts k ON k.company_id = e.company_id),
or_snapshot AS (
  SELECT employee_key, company_id, age, gender, bmi, smoker, diabetic, hypertension, job_category,
         avg_daily_steps, step_volatility, avg_resting_hr, hr_trend, avg_active_mins, avg_sleep_hours,
         avg_spo2, total_claims, visit_count, hospitalized_count, premium_share,
         round_even(total_claims / premium_share, 4) AS loss_ratio,
         CASE WHEN round_even(total_claims / premium_share, 4) > 1.2 THEN 1 ELSE 0 END AS high_risk,
         CAST(diabetic + hypertension AS INTEGER) AS chronic_count
  FROM or_snap0)
"""

FEATURES_CTES = """
or_f1 AS (
  SELECT employee_key, company_id, age, gender, job_category, total_claims, premium_share, loss_ratio, high_risk,
         CAST(least(greatest(coalesce(CAST(chronic_count AS DOUBLE), 0e0), 0e0), 4e0) AS INTEGER) AS chronic_count,
         CASE WHEN bmi IS NULL THEN NULL ELSE greatest(15e0, least(50e0, bmi)) END AS bmi,
         coalesce(CAST(gender = 'M' AS INTEGER), 0) AS gender_male,
         CAST(smoker AS INTEGER) AS smoker, CAST(diabetic AS INTEGER) AS diabetic,
         CAST(hypertension AS INTEGER) AS hypertension,
         coalesce(avg_daily_steps, 5000e0) AS avg_daily_steps,
         coalesce(step_volatility, 0e0) AS step_volatility,
         coalesce(avg_resting_hr, 72e0) AS avg_resting_hr,
         coalesce(hr_trend, 0e0) AS hr_trend,
         coalesce(avg_active_mins, 30e0) AS avg_active_mins,
         coalesce(avg_sleep_hours, 7e0) AS avg_sleep_hours,
         coalesce(avg_spo2, 97e0) AS avg_spo2,
         coalesce(visit_count, 0) AS visit_count,
         coalesce(hospitalized_count, 0) AS hospitalized_count,
         0 AS lab_heart_flag, 0 AS lab_inflammation_flag, 0 AS lab_diabetes_flag, 0 AS lab_kidney_flag,
         0 AS lab_liver_flag, 0 AS lab_iron_flag, 0 AS lab_thyroid_flag, 0 AS lab_bone_flag, 0 AS lab_vitamin_flag
  FROM or_snapshot),
or_features AS (
  SELECT *,
         round_even((greatest(0e0, least(1.2e0, avg_daily_steps / 10000e0))
                     + greatest(0e0, least(1e0, (80e0 - avg_resting_hr) / 30e0))
                     + greatest(0e0, least(1e0, 1e0 - abs(avg_sleep_hours - 7.5e0) / 3e0))) / 3e0 * 100e0, 2)
           AS activity_score,
         round_even(smoker * 15 + diabetic * 20 + hypertension * 15
                    + CASE WHEN bmi IS NULL THEN NULL ELSE greatest(0e0, least(20e0, bmi - 25e0)) END * 1.5e0
                    + (age / 60e0) * 10, 2) AS health_composite,
         CAST(smoker * diabetic AS INTEGER) AS smoker_diabetic,
         (bmi / 25e0) * (age / 40e0) AS bmi_age_risk,
         visit_count * (1 + hospitalized_count) AS clinical_burden,
         CAST(lab_heart_flag + lab_inflammation_flag + lab_diabetes_flag + lab_kidney_flag + lab_liver_flag
              + lab_iron_flag + lab_thyroid_flag + lab_bone_flag + lab_vitamin_flag AS INTEGER) AS lab_domain_count,
         round_even(0.25e0 * lab_diabetes_flag + 0.20e0 * lab_heart_flag + 0.18e0 * lab_kidney_flag
                    + 0.12e0 * lab_liver_flag + 0.10e0 * lab_inflammation_flag + 0.05e0 * lab_iron_flag
                    + 0.04e0 * lab_bone_flag + 0.03e0 * lab_thyroid_flag + 0.03e0 * lab_vitamin_flag, 4)
           AS lab_risk_score,
         ln(1e0 + loss_ratio) AS loss_ratio_log
  FROM or_f1)
"""


def scorecard_sql(model=DEFAULT_SCORECARD) -> str:
    e = _lit(model.intercept)
    for f in model.features:
        w = float(model.weights.get(f, 0.0))
        if w != 0.0:
            e = f"({e} + {_lit(w)} * CAST({f} AS DOUBLE))"
    return e


def scored_ctes(model=DEFAULT_SCORECARD) -> str:
    return f"""
or_pred AS (SELECT *, {scorecard_sql(model)} AS log_pred FROM or_features),
or_scorer AS (SELECT quantile_cont(log_pred, 0.05) AS p05, quantile_cont(log_pred, 0.95) AS p95 FROM or_pred),
or_scored AS (
  SELECT p.*,
         round_even(CASE WHEN s.p95 - s.p05 IS NULL OR isnan(s.p95 - s.p05) OR abs(s.p95 - s.p05) < 1e-12 THEN 50e0
                         ELSE least(greatest((p.log_pred - s.p05) / (s.p95 - s.p05) * 100e0, 0e0), 100e0) END, 1)
           AS hrs
  FROM or_pred p CROSS JOIN or_scorer s),
or_companies AS (
  SELECT company_id, count(*) AS employee_count,
         round_even(avg(exp(log_pred) - 1e0), 4) AS mean_loss_ratio,
         round_even(avg(hrs), 1) AS mean_hrs,
         CASE WHEN avg(hrs) < 30 THEN 'Low' WHEN avg(hrs) < 60 THEN 'Moderate'
              WHEN avg(hrs) < 80 THEN 'High' ELSE 'Critical' END AS risk_band,
         round_even(avg(CASE WHEN hrs < 30 THEN 1e0 ELSE 0e0 END) * 100e0, 1) AS low_risk_pct,
         round_even(avg(CASE WHEN hrs >= 30 AND hrs < 60 THEN 1e0 ELSE 0e0 END) * 100e0, 1) AS moderate_risk_pct,
         round_even(avg(CASE WHEN hrs >= 60 AND hrs < 80 THEN 1e0 ELSE 0e0 END) * 100e0, 1) AS high_risk_pct,
         round_even(avg(CASE WHEN hrs >= 80 THEN 1e0 ELSE 0e0 END) * 100e0, 1) AS critical_risk_pct
  FROM or_scored GROUP BY company_id)
"""


def band_sql(x: str) -> str:
    return (f"CASE WHEN {x} < 30 THEN 'Low' WHEN {x} < 60 THEN 'Moderate' "
            f"WHEN {x} < 80 THEN 'High' ELSE 'Critical' END")


def premium_sql(base: str, h: str, mult: str = "1e0") -> dict:
    eff = f"(CAST({base} AS DOUBLE) * {mult})"
    disc = f"((40e0 - {h}) / 40e0 * 0.15e0)"
    load = f"(({h} - 60e0) / 40e0 * 0.3e0)"
    return {
        "adjusted_premium": f"CASE WHEN {h} <= 40 THEN round_even({eff} * (1e0 - {disc}), 2) "
                            f"WHEN {h} <= 60 THEN round_even({eff}, 2) ELSE round_even({eff} * (1e0 + {load}), 2) END",
        "adjustment_pct": f"CASE WHEN {h} <= 40 THEN round_even(-{disc} * 100e0, 2) "
                          f"WHEN {h} <= 60 THEN round_even(({mult} - 1e0) * 100e0, 2) ELSE round_even({load} * 100e0, 2) END",
        "zone": f"CASE WHEN {h} <= 40 THEN 'discount' WHEN {h} <= 60 THEN 'standard' ELSE 'loading' END",
    }


def with_fixtures(fixture_names, *ctes: str) -> str:
    """``WITH`` clause: fixture CTEs followed by oracle CTE blocks."""
    head = oracle_ctes(*fixture_names)
    extra = ",\n".join(c.strip() for c in ctes if c.strip())
    return head + (",\n" + extra if extra else "")


CORE_FIXTURES = ("fx_employees", "fx_companies", "fx_telemetry", "fx_clinical_events")


def portfolio_cte() -> str:
    p = premium_sql("co.base_premium", "r.mean_hrs")
    return f"""
or_pf AS (
  SELECT r.company_id, co.company_name, co.industry, r.employee_count AS employees, r.mean_hrs, r.risk_band,
         CAST(co.base_premium AS DOUBLE) AS base_premium,
         {p['adjusted_premium']} AS adjusted, {p['adjustment_pct']} AS adjustment_pct, {p['zone']} AS zone
  FROM or_companies r JOIN fx_companies co ON co.company_id = r.company_id)
"""


def importance_ctes(model=DEFAULT_SCORECARD, group: str = "company_id") -> str:
    feats = model.features
    means = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}" for f in feats)
    phis = ", ".join(f"{_lit(model.weights.get(f, 0.0))} * (CAST({f} AS DOUBLE) - m_{f}) AS phi_{f}" for f in feats)
    wide = ", ".join(f"avg(abs(phi_{f})) AS {f}" for f in feats)
    return f"""
or_means AS (SELECT {means} FROM or_pred),
or_phi AS (SELECT {group}, employee_key, {phis} FROM or_pred CROSS JOIN or_means),
or_imp_wide AS (SELECT {group}, {wide} FROM or_phi GROUP BY {group}),
or_imp_long AS (UNPIVOT or_imp_wide ON {", ".join(feats)} INTO NAME feature VALUE importance),
or_importance AS (
  SELECT * FROM (SELECT {group}, feature, importance,
                        CAST(row_number() OVER (PARTITION BY {group} ORDER BY importance DESC, feature) AS INTEGER) AS rank
                 FROM or_imp_long) WHERE rank <= 5)
"""


# ---- keyed jitter twins (JIT1) ----------------------------------------------------------

def j_uniform(key: str, name: str, seed: int = 42, copy: str = "'0'") -> str:
    return (f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{name}', CAST({copy} AS VARCHAR), "
            f"CAST({key} AS VARCHAR))), 1, 8))::BIGINT / 4294967296e0)")


def j_normal(key: str, name: str, sd: float, seed: int = 42, copy: str = "'0'", mean: float = 0.0) -> str:
    import math
    u1 = f"(1e0 - {j_uniform(key, name + '#u1', seed, copy)})"
    u2 = j_uniform(key, name + "#u2", seed, copy)
    return f"({float(mean)!r} + {float(sd)!r} * (sqrt(-2e0 * ln({u1})) * cos({2 * math.pi!r} * {u2})))"


def j_lognormal(key: str, name: str, sigma: float, seed: int = 42, copy: str = "'0'") -> str:
    return f"exp({j_normal(key, name, sigma, seed, copy)})"


def clip(x: str, lo, hi) -> str:
    return f"least(greatest({x}, {float(lo)!r}), {float(hi)!r})"
