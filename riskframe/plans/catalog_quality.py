"""Registered queries: data quality (DQ*), fairness audit (FAI*), environment parity (PAR*)."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.constants import DEFAULT_HASH_SALT, FEATURE_COLUMNS
from ..functions.expr import pseudonymize
from ..operators import quality as Q
from ..operators.features import engineer_features_audit
from ..operators.model import DEFAULT_SCORECARD, apply_scorecard
from ..operators.rollup import SNAPSHOT_COLUMNS, build_snapshot
from ..operators.scoring import predict_companies
from ..sources.fixtures import fixture, fixtures
from .catalog_core import core_inputs, snapshot
from .oracle_sql import (CORE_FIXTURES, FEATURES_CTES, SNAPSHOT_CTES, scorecard_sql, scored_ctes,
                         with_fixtures)
from .registry import register
from .underwriting import score_employees

_SNAP = with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES)
_NUMERIC = ["age", "bmi", "smoker", "diabetic", "hypertension", "avg_daily_steps", "step_volatility",
            "avg_resting_hr", "hr_trend", "avg_active_mins", "avg_sleep_hours", "avg_spo2", "total_claims",
            "visit_count", "hospitalized_count", "premium_share", "loss_ratio", "high_risk", "chronic_count"]


@register("dq1_profile_columns", oracle=_SNAP + "\n" + "\nUNION ALL\n".join(
    f"SELECT {i + 1} AS position, '{c}' AS \"column\", count(*) AS rows, "
    f"count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100 AS null_pct FROM or_snapshot"
    for i, c in enumerate(SNAPSHOT_COLUMNS)), floats=["null_pct"])
def q_profile(spark, sf):
    """DQ1: per-column null percentage of the training snapshot (one aggregate)."""
    return Q.profile_columns(snapshot(spark, sf)).select("position", "column", "rows", "null_pct")


@register("dq2_describe_numeric", oracle=_SNAP + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", stat, value FROM (SELECT "
    f"CAST(count({c}) AS DOUBLE) AS \"count\", avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS \"min\", "
    f"quantile_cont({c}, 0.25) AS \"25%\", quantile_cont({c}, 0.5) AS \"50%\", quantile_cont({c}, 0.75) AS \"75%\", "
    f"CAST(max({c}) AS DOUBLE) AS \"max\" FROM or_snapshot) UNPIVOT (value FOR stat IN "
    f"(\"count\", mean, std, \"min\", \"25%\", \"50%\", \"75%\", \"max\"))"
    for c in _NUMERIC), floats=["value"])
def q_describe(spark, sf):
    """DQ2: describe() of every numeric snapshot column, long form."""
    return Q.describe_numeric(snapshot(spark, sf), _NUMERIC)


@register("dq3_target_summary", oracle=_SNAP + """
SELECT min(loss_ratio) AS "min", quantile_cont(loss_ratio, 0.25) AS q1, avg(loss_ratio) AS mean,
       quantile_cont(loss_ratio, 0.75) AS q3, max(loss_ratio) AS "max" FROM or_snapshot""",
          floats=["min", "q1", "mean", "q3", "max"])
def q_target(spark, sf):
    """DQ3: loss-ratio summary (min, Q1, mean, Q3, max)."""
    return Q.target_summary(snapshot(spark, sf))


@register("dq4_feature_coverage", oracle=_SNAP + "\n" + "\nUNION ALL\n".join(
    f"SELECT {i + 1} AS position, '{c}' AS feature, {str(c in SNAPSHOT_COLUMNS).lower()} AS available, "
    f"count({c if c in SNAPSHOT_COLUMNS else 'NULL'}) AS filled FROM or_snapshot"
    for i, c in enumerate(FEATURE_COLUMNS)))
def q_coverage(spark, sf):
    """DQ4: which of the 31 model features the raw snapshot provides, and in how many rows."""
    return Q.feature_coverage(snapshot(spark, sf))


@register("dq5_completeness", oracle=_SNAP + "\nSELECT (1e0 - (" + " + ".join(
    f"count(*) FILTER (WHERE {c} IS NULL)" for c in SNAPSHOT_COLUMNS) + f") / (count(*) * {len(SNAPSHOT_COLUMNS)})) * 100"
          " AS completeness_pct, " + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in SNAPSHOT_COLUMNS)
          + " AS missing_cells FROM or_snapshot", floats=["completeness_pct"])
def q_completeness(spark, sf):
    """DQ5: cell completeness of the snapshot."""
    return Q.completeness(snapshot(spark, sf))


@register("dq6_duplicate_keys", oracle=with_fixtures(["fx_lab_results"]) + """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, count(*) AS distinct_keys
FROM (SELECT report_id, line_no, count(*) AS n FROM fx_lab_results GROUP BY report_id, line_no)""")
def q_duplicates(spark, sf):
    """DQ6: duplicate (report_id, line_no) rows in the lab lines."""
    return Q.duplicate_count(fixture(spark, sf, "fx_lab_results"), ["report_id", "line_no"]) 


@register("dq7_type_and_range", oracle=_SNAP + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS \"min\", CAST(max({c}) AS DOUBLE) AS \"max\", "
    f"{len(_NUMERIC)} AS n_numeric, {len(SNAPSHOT_COLUMNS) - len(_NUMERIC)} AS n_object, 0 AS n_other FROM or_snapshot"
    for c in _NUMERIC[:5]), floats=["min", "max"])
def q_types(spark, sf):
    """DQ7: column kind counts and ranges of the first five numeric snapshot columns."""
    return Q.type_and_range(snapshot(spark, sf)).select(
        "column", "min", "max", *[F.col(f"column_kinds.{k}").alias(f"n_{k}") for k in ("numeric", "object", "other")])


@register("dq8_assertions", oracle=_SNAP + f"""
, e AS (SELECT count(*) AS n_emp,
               count(*) FILTER (WHERE employee_id IS NULL) + count(*) FILTER (WHERE company_id IS NULL)
               + count(*) FILTER (WHERE age IS NULL) + count(*) FILTER (WHERE bmi IS NULL) AS key_nulls,
               count(*) FILTER (WHERE starts_with(employee_id, 'EMP_')) AS raw_ids
        FROM (SELECT substr(sha256('{DEFAULT_HASH_SALT}' || raw_id), 1, 16) AS employee_id, company_id, age, bmi
              FROM fx_employees)),
s AS (SELECT min(loss_ratio) AS lr_min, count(*) FILTER (WHERE loss_ratio IS NULL) AS lr_nulls,
             quantile_cont(loss_ratio, 0.5) AS lr_median,
             avg(CASE WHEN loss_ratio < 50 THEN 1e0 ELSE 0e0 END) AS pct_normal,
             corr(CAST(avg_daily_steps AS DOUBLE), loss_ratio) AS c FROM or_snapshot)
SELECT * FROM (
  SELECT 'employees_present' AS "check", n_emp > 0 AS passed, CAST(n_emp AS DOUBLE) AS value FROM e
  UNION ALL SELECT 'no_null_keys', key_nulls = 0, CAST(key_nulls AS DOUBLE) FROM e
  UNION ALL SELECT 'loss_ratio_non_negative', lr_min >= 0, lr_min FROM s
  UNION ALL SELECT 'loss_ratio_not_null', lr_nulls = 0, CAST(lr_nulls AS DOUBLE) FROM s
  UNION ALL SELECT 'median_in_range', lr_median > 0 AND lr_median < 10, lr_median FROM s
  UNION ALL SELECT 'share_below_50', pct_normal > 0.9, pct_normal FROM s
  UNION ALL SELECT 'steps_lr_correlation', coalesce(c < -0.1, false), c FROM s
  UNION ALL SELECT 'ids_pseudonymised', raw_ids = 0, CAST(raw_ids AS DOUBLE) FROM e)""", floats=["value"])
def q_assertions(spark, sf):
    """DQ8 (+ING1): data assertions over the pseudonymised roster and the snapshot."""
    emp = fixture(spark, sf, "fx_employees")
    e = emp.withColumn("employee_id", pseudonymize("raw_id", DEFAULT_HASH_SALT))
    return Q.assertions(snapshot(spark, sf), e)


# ---- fairness audit --------------------------------------------------------------------

def _clip_sql(x, lo, hi):
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE greatest({lo}, least({hi}, {x})) END)"


_AUDIT_FEATS = {
    "activity_score": f"({_clip_sql('avg_daily_steps', '0e0', '20000e0')} / 20000e0 * 40 + "
                      f"{_clip_sql('avg_active_mins', '0e0', '120e0')} / 120e0 * 30 + "
                      f"({_clip_sql('avg_spo2', '85e0', '100e0')} - 85e0) / 15e0 * 30)",
    "health_composite": f"(smoker * 30 + diabetic * 25 + hypertension * 20 + ({_clip_sql('bmi', '18e0', '50e0')} - 18e0)"
                        f" / 32e0 * 15 + {_clip_sql('CAST(chronic_count AS DOUBLE)', '0e0', '5e0')} / 5e0 * 10)",
    "smoker_diabetic": "smoker * diabetic",
    "bmi_age_risk": f"(({_clip_sql('bmi', '18e0', '50e0')} - 18e0) * (age - 18) / 1664e0)",
    "clinical_burden": "(visit_count + hospitalized_count * 3)",
    "lab_domain_count": "0",
    "lab_risk_score": "0",
}


def _audit_ctes():
    avail = set(SNAPSHOT_COLUMNS) | set(_AUDIT_FEATS)
    raw = ", ".join(f"coalesce(CAST({_AUDIT_FEATS.get(f, f) if f in avail else '0'} AS DOUBLE), 0e0) AS {f}"
                    for f in FEATURE_COLUMNS)
    return f"""
or_aj AS (SELECT s.* EXCLUDE (gender), e.gender FROM or_snapshot s JOIN fx_employees e ON e.employee_key = s.employee_key),
or_aligned AS (SELECT employee_key, company_id, gender, age AS age_years, {raw} FROM or_aj),
or_audit AS (
  SELECT a.*, least(greatest({scorecard_sql()}, s.p05), s.p95) AS _c, s.p05, s.p95 FROM or_aligned a CROSS JOIN or_scorer s),
or_audit_hrs AS (SELECT employee_key, company_id, gender, age_years AS age,
                        (_c - p05) / greatest(p95 - p05, 1e-6) * 100 AS hrs FROM or_audit)
"""


_AUDIT = with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES, FEATURES_CTES, scored_ctes(), _audit_ctes())


def audit_scores(spark, sf):
    """FAI6 -> FEA11 -> FAI5 -> scorecard -> FAI1 (calibrated by the production scorer, SCO1)."""
    from ..session import materialize
    emp, comp, tele, clin = core_inputs(spark, sf)
    snap = materialize(build_snapshot(emp, tele, clin, comp), "snapshot")  # read by scorer and audit paths
    _, scorer = score_employees(snap)
    df = Q.join_gender(snap, emp)
    aligned = Q.align_features(engineer_features_audit(df).withColumnRenamed("age", "age_years")
                               .withColumn("age", F.col("age_years")))
    pred = apply_scorecard(aligned, DEFAULT_SCORECARD)
    return Q.score_hrs_audit(pred, scorer).select("employee_key", "company_id", "gender",
                                                 F.col("age_years").alias("age"), "hrs")


@register("fai1_audit_hrs", oracle=_AUDIT + "\nSELECT * FROM or_audit_hrs", floats=["hrs"])
def q_audit_hrs(spark, sf):
    """FAI1 + FAI5 + FAI6 + FEA11: audit-variant HRS per employee."""
    return audit_scores(spark, sf)


_FAIR = """
SELECT gender, count(*) AS n, avg(hrs) AS mean_hrs, quantile_cont(hrs, 0.5) AS median_hrs, stddev_samp(hrs) AS std_hrs,
       avg(CASE WHEN hrs < 40 THEN 1e0 ELSE 0e0 END) * 100 AS pct_low,
       avg(CASE WHEN hrs >= 40 AND hrs < 60 THEN 1e0 ELSE 0e0 END) * 100 AS pct_moderate,
       avg(CASE WHEN hrs >= 60 AND hrs < 80 THEN 1e0 ELSE 0e0 END) * 100 AS pct_high,
       avg(CASE WHEN hrs >= 80 THEN 1e0 ELSE 0e0 END) * 100 AS pct_critical
FROM or_audit_hrs GROUP BY gender"""


@register("fai2_fairness_report", oracle=_AUDIT + _FAIR,
          floats=["mean_hrs", "median_hrs", "std_hrs", "pct_low", "pct_moderate", "pct_high", "pct_critical"])
def q_fairness(spark, sf):
    """FAI2: HRS by gender with the audit's band edges."""
    return Q.fairness_report(audit_scores(spark, sf), "gender")


@register("fai3_parity_gap", oracle=_AUDIT + ", r AS (" + _FAIR + """)
SELECT max(mean_hrs) - min(mean_hrs) AS max_gap, max(mean_hrs) - min(mean_hrs) <= 5 AS passed FROM r""",
          floats=["max_gap"])
def q_parity_gap(spark, sf):
    """FAI3: largest gender gap in mean HRS, pass if <= 5 points."""
    return Q.parity_gap(Q.fairness_report(audit_scores(spark, sf), "gender"))


@register("fai4_age_report", oracle=_AUDIT + """
, r AS (SELECT CASE WHEN age > 17 AND age <= 29 THEN '18-29' WHEN age > 29 AND age <= 39 THEN '30-39'
                    WHEN age > 39 AND age <= 49 THEN '40-49' WHEN age > 49 AND age <= 59 THEN '50-59'
                    WHEN age > 59 AND age <= 70 THEN '60-70' END AS age_bucket, hrs FROM or_audit_hrs),
g AS (SELECT age_bucket, count(*) AS n, round_even(avg(hrs), 1) AS mean_hrs, round_even(stddev_samp(hrs), 1) AS std_hrs
      FROM r WHERE age_bucket IS NOT NULL GROUP BY age_bucket)
SELECT *, coalesce(mean_hrs >= lag(mean_hrs) OVER (ORDER BY age_bucket), true) AS non_decreasing FROM g""",
          floats=["mean_hrs", "std_hrs"])
def q_age_report(spark, sf):
    """FAI4: HRS by age decade with the monotone check."""
    return Q.age_report(audit_scores(spark, sf))


# ---- environment parity ---------------------------------------------------------------

def _environments(spark, sf):
    """Scored employees of both environments.  They differ in their roster alone, so the rollups of telemetry and
    claims are stored once and both rosters are joined to them."""
    from ..operators.rollup import rollup_claims, rollup_telemetry_with_trend, snapshot_of
    from ..session import materialize
    a, b, comp, tele, clin = fixtures(spark, sf, "fx_employees", "fx_employees_b", "fx_companies", "fx_telemetry",
                                      "fx_clinical_events")
    tele = materialize(rollup_telemetry_with_trend(tele, "employee_key"), "telemetry-rollup")
    claims = materialize(rollup_claims(clin, "employee_key"), "claims-rollup")
    return [score_employees(snapshot_of(roster, tele, claims, comp))[0] for roster in (a, b)]


def _env_b_sql():
    body = (SNAPSHOT_CTES + "," + FEATURES_CTES + "," + scored_ctes()).replace("fx_employees", "fx_employees_b")
    return re.sub(r"\bor_(\w+)", r"orb_\1", body)


_ENV = with_fixtures(list(CORE_FIXTURES) + ["fx_employees_b"], SNAPSHOT_CTES, FEATURES_CTES, scored_ctes(),
                     _env_b_sql())


@register("par1_key_parity", oracle=_ENV + """
SELECT coalesce(a.company_id, b.company_id) AS company_id,
       CASE WHEN a.company_id IS NOT NULL AND b.company_id IS NOT NULL THEN 'both'
            WHEN a.company_id IS NOT NULL THEN 'only_left' ELSE 'only_right' END AS presence
FROM (SELECT DISTINCT company_id FROM or_companies) a FULL OUTER JOIN (SELECT DISTINCT company_id FROM orb_companies) b
  ON a.company_id = b.company_id""")
def q_key_parity(spark, sf):
    """PAR1: company key sets of two environments (left = current roster, right = changed roster)."""
    return Q.key_parity(*_environments(spark, sf))


@register("par2_count_parity", oracle=_ENV + """
SELECT coalesce(a.company_id, b.company_id) AS company_id, a.n AS left_count, b.n AS right_count,
       coalesce(a.n = b.n, false) AS "match"
FROM (SELECT company_id, count(*) AS n FROM or_scored GROUP BY 1) a
FULL OUTER JOIN (SELECT company_id, count(*) AS n FROM orb_scored GROUP BY 1) b ON a.company_id = b.company_id""")
def q_count_parity(spark, sf):
    """PAR2: employees per company in each environment and whether they match."""
    return Q.count_parity(*_environments(spark, sf))


@register("par3_score_parity", oracle=_ENV + """
, j AS (SELECT a.company_id, a.mean_hrs AS left_score, a.risk_band AS left_band, b.mean_hrs AS right_score,
               b.risk_band AS right_band, abs(a.mean_hrs - b.mean_hrs) AS abs_delta, a.risk_band = b.risk_band AS band_match
        FROM or_companies a JOIN orb_companies b ON a.company_id = b.company_id)
SELECT j.*, m.mean_abs_delta FROM j CROSS JOIN (SELECT avg(abs_delta) AS mean_abs_delta FROM j) m""",
          floats=["left_score", "right_score", "abs_delta", "mean_abs_delta"])
def q_score_parity(spark, sf):
    """PAR3: per-company mean HRS in both environments, |delta|, band match, mean |delta|."""
    return Q.score_parity(*map(predict_companies, _environments(spark, sf)))
