"""Registered queries: rollups, features, scoring, pricing and the flagship portfolio."""
from __future__ import annotations

from ..functions.constants import FEATURE_COLUMNS
from ..operators.features import engineer_features
from ..operators.model import DEFAULT_SCORECARD, apply_scorecard
from ..operators.rollup import build_snapshot
from ..operators.scoring import fit_scorer, predict_companies
from ..sources.fixtures import fixtures
from .oracle_sql import (CORE_FIXTURES, FEATURES_CTES, SNAPSHOT_CTES, premium_sql, scored_ctes,
                         with_fixtures)
from .registry import register
from .underwriting import price_employers, score_employees


def core_inputs(spark, sf):
    return fixtures(spark, sf, *CORE_FIXTURES)


def snapshot(spark, sf):
    emp, comp, tele, clin = core_inputs(spark, sf)
    return build_snapshot(emp, tele, clin, comp)


def scored(spark, sf):
    return score_employees(snapshot(spark, sf))


_SNAP_FLOATS = ["bmi", "avg_daily_steps", "step_volatility", "avg_resting_hr", "hr_trend", "avg_active_mins",
                "avg_sleep_hours", "avg_spo2", "total_claims", "premium_share", "loss_ratio"]


@register("agg7_snapshot",
          oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES) + "\nSELECT * FROM or_snapshot",
          floats=_SNAP_FLOATS)
def q_snapshot(spark, sf):
    """AGG1-AGG7: telemetry + claims rollups joined to the roster, premium share, loss ratio."""
    return snapshot(spark, sf)


_FEAT_OUT = ["employee_key", "company_id"] + FEATURE_COLUMNS + ["gender_male", "loss_ratio_log"]
_FEAT_FLOATS = ["bmi", "avg_daily_steps", "step_volatility", "avg_resting_hr", "hr_trend", "avg_active_mins",
                "avg_sleep_hours", "avg_spo2", "activity_score", "health_composite", "bmi_age_risk",
                "lab_risk_score", "loss_ratio_log"]


@register("fea9_features",
          oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES, FEATURES_CTES)
          + "\nSELECT " + ", ".join(_FEAT_OUT) + " FROM or_features",
          floats=_FEAT_FLOATS)
def q_features(spark, sf):
    """FEA1-FEA9 + AGG13 over the snapshot: the 31 model features in order."""
    return engineer_features(snapshot(spark, sf)).select(*_FEAT_OUT)


@register("sco1_fit_scorer",
          oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES, FEATURES_CTES, scored_ctes())
          + "\nSELECT p05, p95 FROM or_scorer",
          floats=["p05", "p95"])
def q_scorer(spark, sf):
    """SCO1: calibration bounds (5th/95th percentile of log predictions)."""
    feats = apply_scorecard(engineer_features(snapshot(spark, sf)), DEFAULT_SCORECARD)
    return fit_scorer(feats)


@register("sco2_employee_hrs",
          oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES, FEATURES_CTES, scored_ctes())
          + """
SELECT employee_key, company_id, log_pred, hrs,
       CASE WHEN hrs < 30 THEN 'Low' WHEN hrs < 60 THEN 'Moderate' WHEN hrs < 80 THEN 'High' ELSE 'Critical' END AS risk_band
FROM or_scored""",
          floats=["log_pred", "hrs"])
def q_employee_hrs(spark, sf):
    """SCO2 + SCO3: batch HRS (1 dp) and risk band per employee."""
    s, _ = scored(spark, sf)
    return s.select("employee_key", "company_id", "log_pred", "hrs", "risk_band")


@register("sco6_company_risk",
          oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES, FEATURES_CTES, scored_ctes())
          + "\nSELECT * FROM or_companies",
          floats=["mean_loss_ratio", "mean_hrs", "low_risk_pct", "moderate_risk_pct", "high_risk_pct",
                  "critical_risk_pct"])
def q_company_risk(spark, sf):
    """SCO6 + SCO7: per-company head-count, mean LR, mean HRS, band and band mix."""
    s, _ = scored(spark, sf)
    return predict_companies(s)


_P = premium_sql("co.base_premium", "r.mean_hrs")
_PORTFOLIO_SQL = (with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES, FEATURES_CTES, scored_ctes()) + f"""
SELECT r.company_id, co.company_name, co.industry, r.employee_count AS employees, r.mean_hrs, r.risk_band,
       CAST(co.base_premium AS DOUBLE) AS base_premium,
       {_P['adjusted_premium']} AS adjusted, {_P['adjustment_pct']} AS adjustment_pct, {_P['zone']} AS zone
FROM or_companies r JOIN fx_companies co ON co.company_id = r.company_id""")


@register("prt3_portfolio", oracle=_PORTFOLIO_SQL,
          floats=["mean_hrs", "base_premium", "adjusted", "adjustment_pct"])
def q_portfolio(spark, sf):
    """Flagship: price every employer by its workforce risk (AGG7 -> FEA9 -> SCO1-7 -> PRC3 -> PRT3)."""
    emp, comp, tele, clin = core_inputs(spark, sf)
    return price_employers(emp, tele, clin, comp)


@register("fea10_feature_matrix", oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES, FEATURES_CTES) + "\nSELECT employee_key, "
          + ", ".join(f"coalesce(CAST({f} AS DOUBLE), CAST('nan' AS DOUBLE)) AS {f}" for f in FEATURE_COLUMNS)
          + ", loss_ratio_log FROM or_features", floats=[*FEATURE_COLUMNS, "loss_ratio_log"])
def q_feature_matrix(spark, sf):
    """FEA10: the ordered 31-feature vector (contract-checked), an element per column, with the log target."""
    from pyspark.ml.functions import vector_to_array
    from ..operators.features import feature_matrix
    m = feature_matrix(engineer_features(snapshot(spark, sf)))
    m = m.select("employee_key", vector_to_array("features").alias("v"), "loss_ratio_log")
    return m.select("employee_key", *[m.v[i].alias(f) for i, f in enumerate(FEATURE_COLUMNS)], "loss_ratio_log")
