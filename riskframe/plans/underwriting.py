"""End-to-end underwriting jobs built from the operators.

``price_employers`` is the flagship: raw roster + telemetry + claims ->
snapshot -> features -> scorecard -> calibrated HRS -> company risk -> premium.
The per-employee rollups are partial+final aggregates on ``employee_key``;
the per-employee feature table is materialised once (shared checkpoint folder); calibration is an exact
distributed selection over it (one row of bounds, broadcast); the company step
is one more partial+final aggregate on ``company_id``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.features import engineer_features
from ..operators.model import DEFAULT_SCORECARD, Scorecard, apply_scorecard
from ..operators.portfolio import portfolio
from ..operators.rollup import build_snapshot
from ..operators.scoring import fit_scorer, predict_companies, risk_band, score_hrs


def score_employees(snapshot: DataFrame, model: Scorecard = DEFAULT_SCORECARD,
                    scorer: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Features -> log prediction -> HRS (1 dp) and band, per employee.  Returns (scored, scorer).

    The per-employee feature table is materialised once in the shared
    checkpoint folder because calibration and scoring both read it: the
    telemetry/claims rollups run once.
    """
    from ..session import materialize
    feats = materialize(apply_scorecard(engineer_features(snapshot), model), "features")
    scorer = fit_scorer(feats, materialized=True) if scorer is None else scorer
    scored = score_hrs(feats, scorer)
    return scored.withColumn("risk_band", risk_band("hrs")), scorer


def price_employers(employees: DataFrame, telemetry: DataFrame, clinical: DataFrame,
                    companies: DataFrame, model: Scorecard = DEFAULT_SCORECARD) -> DataFrame:
    """Flagship: price every employer by its workforce risk (PRT3 over AGG7 -> FEA9 -> SCO1-7)."""
    snap = build_snapshot(employees, telemetry, clinical, companies)
    scored, _ = score_employees(snap, model)
    return portfolio(companies, predict_companies(scored))
