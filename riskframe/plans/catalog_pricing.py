"""Registered queries: pricing (PRC*) and portfolio analytics (PRT*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import CURRENCIES, INDUSTRY_RISK_MULTIPLIERS, REGION_MULTIPLIERS
from ..operators import portfolio as P
from ..operators import pricing as R
from ..operators.model import DEFAULT_SCORECARD
from ..operators.scoring import feature_means, global_importance, predict_companies
from ..sources.fixtures import fixture
from .catalog_core import scored, snapshot
from .oracle_sql import (CORE_FIXTURES, FEATURES_CTES, SNAPSHOT_CTES, importance_ctes, portfolio_cte,
                         premium_sql, rnd, scored_ctes, with_fixtures)
from .registry import register

_BASE = with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES, FEATURES_CTES, scored_ctes(), portfolio_cte())
_BASE_IMP = with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES, FEATURES_CTES, scored_ctes(), portfolio_cte(),
                          importance_ctes())


def _pf(spark, sf):
    s, _ = scored(spark, sf)
    comp = fixture(spark, sf, "fx_companies")
    risk = predict_companies(s)
    return P.portfolio(comp, risk), risk, s


def _importance(s):
    return global_importance(s, DEFAULT_SCORECARD.weights, feature_means(s), "company_id")


def _map_sql(d: dict, key: str) -> str:
    whens = " ".join(f"WHEN {key} = '{k}' THEN CAST({v!r} AS DOUBLE)" for k, v in d.items())
    return f"coalesce(CASE {whens} END, 1e0)"


def _band_sql(x: str) -> str:
    return f"CASE WHEN {x} <= 3 THEN '1-3L' WHEN {x} <= 7 THEN '4-7L' WHEN {x} <= 15 THEN '8-15L' ELSE '15L+' END"


_MULT_SQL = (f"({_map_sql(INDUSTRY_RISK_MULTIPLIERS, 'industry')} * {_map_sql(REGION_MULTIPLIERS, 'region')}"
             f" * CASE {_band_sql('coalesce(sum_assured_lakhs, 5e0)')} WHEN '1-3L' THEN 0.944e0 WHEN '8-15L' THEN 1.202e0"
             f" ELSE 1e0 END)")


@register("prc2_market_multiplier",
          oracle=with_fixtures(["fx_companies"]) + f"""
SELECT company_id, {_band_sql('coalesce(sum_assured_lakhs, 5e0)')} AS sum_assured_band,
       (1e0 * {_map_sql(INDUSTRY_RISK_MULTIPLIERS, 'industry')}) * {_map_sql(REGION_MULTIPLIERS, 'region')}
       * CASE {_band_sql('coalesce(sum_assured_lakhs, 5e0)')} WHEN '1-3L' THEN 0.944e0 WHEN '4-7L' THEN 1e0
              WHEN '8-15L' THEN 1.202e0 ELSE 1e0 END AS multiplier
FROM fx_companies""", floats=["multiplier"])
def q_market_multiplier(spark, sf):
    """PRC1 + PRC2: sum-assured band and industry x region x band multiplier per company."""
    c = fixture(spark, sf, "fx_companies")
    return c.select("company_id", R.sum_assured_band(F.coalesce("sum_assured_lakhs", F.lit(5.0))).alias("sum_assured_band"),
                    R.market_multiplier("industry", "region", "sum_assured_lakhs").alias("multiplier"))


_PM = premium_sql("co.base_premium", "r.mean_hrs",
                  "((1e0 * " + _map_sql(INDUSTRY_RISK_MULTIPLIERS, "co.industry") + ") * "
                  + _map_sql(REGION_MULTIPLIERS, "co.region") + " * CASE "
                  + _band_sql("coalesce(co.sum_assured_lakhs, 5e0)")
                  + " WHEN '1-3L' THEN 0.944e0 WHEN '4-7L' THEN 1e0 WHEN '8-15L' THEN 1.202e0 ELSE 1e0 END)")


@register("prc3_market_premium", oracle=_BASE + f"""
SELECT r.company_id, r.mean_hrs, {_PM['adjusted_premium']} AS adjusted_premium,
       {_PM['adjustment_pct']} AS adjustment_pct, {_PM['zone']} AS zone
FROM or_companies r JOIN fx_companies co ON co.company_id = r.company_id""",
          floats=["mean_hrs", "adjusted_premium", "adjustment_pct"])
def q_market_premium(spark, sf):
    """PRC3: HRS-zone premium adjustment with the company's market multiplier."""
    s, _ = scored(spark, sf)
    comp = fixture(spark, sf, "fx_companies")
    df = predict_companies(s).join(comp, "company_id")
    mult = R.market_multiplier("industry", "region", "sum_assured_lakhs")
    return R.adjust_premium(df, "base_premium", "mean_hrs", mult).select(
        "company_id", "mean_hrs", "adjusted_premium", "adjustment_pct", "zone")


def _roi_sql(h_cur, h_new):
    a, b = premium_sql("base_premium", h_cur), premium_sql("base_premium", h_new)
    return (f"{a['adjusted_premium']} AS current_premium, {b['adjusted_premium']} AS projected_premium, "
            f"round_even(({a['adjusted_premium']}) - ({b['adjusted_premium']}), 2) AS annual_savings, "
            f"round_even({h_cur} - {h_new}, 1) AS hrs_improvement, {a['zone']} AS current_zone, "
            f"{b['zone']} AS projected_zone")


@register("prc4_wellness_roi", oracle=_BASE + f"""
SELECT company_id, {_roi_sql('mean_hrs', 'greatest(0e0, mean_hrs - 10e0)')}
FROM or_pf""", floats=["current_premium", "projected_premium", "annual_savings", "hrs_improvement"])
def q_wellness_roi(spark, sf):
    """PRC4: premium now vs after a 10-point wellness improvement, per company."""
    pf, _, _ = _pf(spark, sf)
    df = pf.withColumn("projected_hrs", F.greatest(F.lit(0.0), F.col("mean_hrs") - 10.0))
    return R.wellness_roi(df, "base_premium", "mean_hrs", "projected_hrs").select(
        "company_id", "current_premium", "projected_premium", "annual_savings", "hrs_improvement",
        "current_zone", "projected_zone")


@register("prc5_roi_grid", oracle=_BASE + f"""
SELECT company_id, improvement, {_roi_sql('mean_hrs', 'greatest(0e0, mean_hrs - improvement)')}
FROM or_pf CROSS JOIN range(0, 41) AS g(improvement)""",
          floats=["current_premium", "projected_premium", "annual_savings", "hrs_improvement"])
def q_roi_grid(spark, sf):
    """PRC5: ROI grid for improvements 0..40 points per company."""
    pf, _, _ = _pf(spark, sf)
    return R.roi_grid(pf, "base_premium", "mean_hrs").select(
        "company_id", F.col("improvement").cast("bigint").alias("improvement"), "current_premium",
        "projected_premium", "annual_savings", "hrs_improvement", "current_zone", "projected_zone")


_Q = with_fixtures(["fx_quotes"])


@register("prc6_industry_multipliers", oracle=_Q + """
SELECT industry AS key, round_even(quantile_cont(estimated_annual_premium_per_employee_inr, 0.5)
       / (SELECT quantile_cont(estimated_annual_premium_per_employee_inr, 0.5) FROM fx_quotes), 3) AS multiplier
FROM fx_quotes GROUP BY industry""", floats=["multiplier"])
def q_industry_multipliers(spark, sf):
    """PRC6: industry multipliers = group median premium / overall median."""
    return R.industry_multipliers(fixture(spark, sf, "fx_quotes"))


@register("prc7_market_multipliers", oracle=_Q + """
SELECT CASE WHEN g = 1 THEN 'industry' ELSE 'region' END AS kind, key, multiplier FROM (
  SELECT 1 AS g, industry AS key, round_even(quantile_cont(estimated_annual_premium_per_employee_inr, 0.5)
         / (SELECT quantile_cont(estimated_annual_premium_per_employee_inr, 0.5) FROM fx_quotes), 3) AS multiplier
  FROM fx_quotes GROUP BY industry
  UNION ALL
  SELECT 2, region, round_even(quantile_cont(estimated_annual_premium_per_employee_inr, 0.5)
         / (SELECT quantile_cont(estimated_annual_premium_per_employee_inr, 0.5) FROM fx_quotes), 3)
  FROM fx_quotes GROUP BY region)""", floats=["multiplier"])
def q_market_multipliers(spark, sf):
    """PRC6 + PRC7 fused: industry and region multipliers from one GROUPING SETS job."""
    return R.market_multipliers(fixture(spark, sf, "fx_quotes"))


@register("prc8_band_multipliers", oracle=_Q + """
, b AS (
  SELECT CASE WHEN sum_assured_lakhs > 0 AND sum_assured_lakhs <= 3 THEN '1-3L'
              WHEN sum_assured_lakhs > 3 AND sum_assured_lakhs <= 7 THEN '4-7L'
              WHEN sum_assured_lakhs > 7 AND sum_assured_lakhs <= 15 THEN '8-15L'
              WHEN sum_assured_lakhs > 15 AND sum_assured_lakhs <= 10000 THEN '15L+' END AS band,
         estimated_annual_premium_per_employee_inr AS p FROM fx_quotes),
m AS (SELECT band, quantile_cont(p, 0.5) AS med FROM b WHERE band IS NOT NULL GROUP BY band),
base AS (SELECT coalesce(max(CASE WHEN band = '4-7L' THEN med END), quantile_cont(med, 0.5)) AS base FROM m),
labels AS (SELECT * FROM (VALUES ('1-3L', 0), ('4-7L', 1), ('8-15L', 2), ('15L+', 3)) AS t(band, position))
SELECT l.band, l.position, coalesce(round_even(m.med / base.base, 3), 1e0) AS multiplier
FROM labels l LEFT JOIN m ON m.band = l.band CROSS JOIN base""", floats=["multiplier"])
def q_band_multipliers(spark, sf):
    """PRC8: sum-assured band multipliers normalised to the 4-7L band; missing bands 1.0."""
    return R.band_multipliers(fixture(spark, sf, "fx_quotes"))


_CODES = list(CURRENCIES)


def _fx_values_sql():
    rows = ", ".join(f"('{c}', CAST({CURRENCIES[c][2]!r} AS DOUBLE))" for c in _CODES)
    return f"(VALUES {rows}) AS fx(code, rate)"


@register("prc9_currency", oracle=_BASE + f"""
SELECT company_id, code, base_premium * rate AS base_premium_fx, adjusted * rate AS adjusted_fx
FROM or_pf CROSS JOIN {_fx_values_sql()}""", floats=["base_premium_fx", "adjusted_fx"])
def q_currency(spark, sf):
    """PRC9: portfolio premiums converted to every supported currency (rates are literals)."""
    pf, _, _ = _pf(spark, sf)
    rates = F.create_map(*[x for c in _CODES for x in (F.lit(c), F.lit(CURRENCIES[c][2]))])
    ex = pf.select("company_id", "base_premium", "adjusted", F.explode(rates).alias("code", "rate"))
    return ex.select("company_id", "code", (F.col("base_premium") * F.col("rate")).alias("base_premium_fx"),
                     (F.col("adjusted") * F.col("rate")).alias("adjusted_fx"))


def _money_sql(x, code):
    sym, _, rate = CURRENCIES[code]
    v = f"({x} * CAST({float(rate)!r} AS DOUBLE))" if code != "INR" else x
    whole = f"format('{{:,.0f}}', {rnd(v, 0)})"
    body = whole if code == "JPY" else f"CASE WHEN {v} < 1000 THEN format('{{:,.2f}}', {rnd(v, 2)}) ELSE {whole} END"
    return f"'{sym}' || {body}"


def _total_sql(x, code):
    sym, _, rate = CURRENCIES[code]
    v = f"({x} * CAST({float(rate)!r} AS DOUBLE))"
    part = lambda by, unit: f"'{sym}' || printf('%.2f', {rnd(f'{v} / {by}', 2)}) || '\u00a0{unit}'"
    if code in ("INR", "JPY"):
        return part("1e7", "Cr") if code == "INR" else part("1e8", "Bn")
    return (f"CASE WHEN {v} >= 1e9 THEN {part('1e9', 'Bn')} WHEN {v} >= 1e6 THEN {part('1e6', 'M')} "
            f"ELSE '{sym}' || format('{{:,.0f}}', {rnd(v, 0)}) END")


@register("prc10_11_money_format", oracle=_BASE + "\nSELECT company_id, " + ", ".join(
    f"{_money_sql('adjusted', c)} AS {c.lower()}" for c in ("USD", "JPY", "INR")) + " FROM or_pf\nUNION ALL SELECT '__TOTAL__', " + ", ".join(
    _total_sql("t", c) for c in ("USD", "JPY", "INR")) + " FROM (SELECT sum(adjusted) AS t FROM or_pf)")
def q_money_format(spark, sf):
    """PRC10 + PRC11: formatted premium per company in USD, JPY and INR, and formatted totals."""
    pf, _, _ = _pf(spark, sf)
    tot = pf.agg(F.sum("adjusted").alias("total"))
    per = pf.select("company_id", R.format_money(F.col("adjusted") * CURRENCIES["USD"][2], "USD").alias("usd"),
                    R.format_money(F.col("adjusted") * CURRENCIES["JPY"][2], "JPY").alias("jpy"),
                    R.format_money("adjusted", "INR").alias("inr"))
    t = tot.select(F.lit("__TOTAL__").alias("company_id"), R.format_total("total", "USD").alias("usd"),
                   R.format_total("total", "JPY").alias("jpy"), R.format_total("total", "INR").alias("inr"))
    return per.unionByName(t)


@register("prc12_estimated_claims", oracle=_BASE + """
SELECT r.company_id, r.mean_loss_ratio * pf.adjusted AS estimated_claims
FROM or_companies r JOIN or_pf pf ON pf.company_id = r.company_id""", floats=["estimated_claims"])
def q_estimated_claims(spark, sf):
    """PRC12: estimated annual claims = mean loss ratio x adjusted premium."""
    pf, risk, _ = _pf(spark, sf)
    df = risk.select("company_id", "mean_loss_ratio").join(pf.select("company_id", "adjusted"), "company_id")
    return R.estimated_claims(df, "mean_loss_ratio", "adjusted").select("company_id", "estimated_claims")


def _playbook_sql():
    rows = ", ".join(f"('{k}', '{a}', '{i}', CAST({m!r} AS DOUBLE))" for k, (a, i, m) in R.INTERVENTIONS.items())
    return f"(VALUES {rows}) AS pb(feature, action, impact, hrs_mid)"


@register("prc13_interventions", oracle=_BASE_IMP + f"""
SELECT i.company_id, i.rank, i.feature, pb.action, pb.impact, pb.hrs_mid / 100 * pf.adjusted * 0.8 AS estimated_savings
FROM or_importance i JOIN {_playbook_sql()} ON pb.feature = i.feature
JOIN or_pf pf ON pf.company_id = i.company_id WHERE i.rank <= 4""", floats=["estimated_savings"])
def q_interventions(spark, sf):
    """PRC13: recommended interventions from each company's top-4 drivers, with modelled savings."""
    pf, _, s = _pf(spark, sf)
    return R.recommend_interventions(_importance(s), pf)


# ---- portfolio ---------------------------------------------------------------------

@register("prt1_list_companies_hr_admin", oracle=with_fixtures(["fx_companies"]) + """
SELECT company_id, company_name, industry FROM fx_companies WHERE company_id = 'COMP_003'""")
def q_list_companies(spark, sf):
    """PRT1 + ING19: companies visible to an hr_admin of COMP_003 (row policy), by name."""
    c = fixture(spark, sf, "fx_companies")
    return P.list_companies(c, "hr_admin", "COMP_003").select("company_id", "company_name", "industry")


@register("prt1_list_companies_underwriter", oracle=with_fixtures(["fx_companies"]) + """
SELECT company_id, company_name, industry FROM fx_companies""")
def q_list_companies_uw(spark, sf):
    """PRT1 + ING19: an underwriter sees every company."""
    c = fixture(spark, sf, "fx_companies")
    return P.list_companies(c, "underwriter").select("company_id", "company_name", "industry")


@register("ing19_access_decisions", oracle=with_fixtures(["fx_principals", "fx_access_requests"]) + """
SELECT r.*, p.role, why IS NULL AS allowed, why AS reason
FROM fx_access_requests r LEFT JOIN fx_principals p ON p.principal = r.principal CROSS JOIN LATERAL (
  SELECT CASE WHEN p.role IS NULL THEN 'unknown principal' WHEN p.role = 'underwriter' THEN NULL
              WHEN p.role <> 'hr_admin' THEN 'role without access'
              WHEN p.company_id IS NULL THEN 'hr_admin account has no company_id configured'
              WHEN r.company_id <> p.company_id THEN 'Access denied for this company' END AS why)""")
def q_access_decisions(spark, sf):
    """ING19: every access request judged by the table of principals, denials with their reasons."""
    return P.access_decisions(fixture(spark, sf, "fx_access_requests"), fixture(spark, sf, "fx_principals"))


@register("ing19_visible_rows", oracle=with_fixtures(["fx_principals", "fx_companies"]) + """
SELECT c.company_id, c.company_name FROM fx_companies c JOIN fx_principals p ON p.principal = 'user_3' AND p.company_id = c.company_id""")
def q_visible_rows(spark, sf):
    """ING19: the companies that one principal of the table, an hr_admin, may see."""
    return P.visible_rows(fixture(spark, sf, "fx_companies"), fixture(spark, sf, "fx_principals"), "user_3") \
            .select("company_id", "company_name")


@register("prt2_company_employees", oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES) + """
SELECT s.company_id, s.employee_key, s.age, e.gender, s.bmi, s.smoker, s.diabetic, s.hypertension, s.chronic_count,
       e.job_category, s.avg_daily_steps, s.avg_resting_hr, s.avg_sleep_hours, s.visit_count, s.hospitalized_count,
       s.loss_ratio, s.high_risk
FROM or_snapshot s JOIN fx_employees e ON e.employee_key = s.employee_key""",
          floats=["bmi", "avg_daily_steps", "avg_resting_hr", "avg_sleep_hours", "loss_ratio"])
def q_company_employees(spark, sf):
    """PRT2: snapshot joined to the roster, the 16-column employee listing for every company."""
    emp = fixture(spark, sf, "fx_employees")
    return P.company_employees(snapshot(spark, sf), emp)


@register("prt4_portfolio_kpis", oracle=_BASE + """
SELECT count(*) AS companies, count(*) FILTER (WHERE risk_band IN ('High', 'Critical')) AS need_review,
       CAST(sum(employees) AS BIGINT) AS total_employees, avg(mean_hrs) AS avg_hrs, avg(mean_hrs) - 50e0 AS hrs_vs_benchmark,
       sum(adjusted) AS adjusted_total, sum(adjusted) - sum(base_premium) AS premium_delta
FROM or_pf""", floats=["avg_hrs", "hrs_vs_benchmark", "adjusted_total", "premium_delta"])
def q_kpis(spark, sf):
    """PRT4: portfolio KPIs."""
    pf, _, _ = _pf(spark, sf)
    return P.portfolio_kpis(pf)


@register("prt5_portfolio_alerts", oracle=_BASE + """
, a AS (
  SELECT count(*) FILTER (WHERE risk_band = 'Critical') AS n_crit,
         min(company_name) FILTER (WHERE risk_band = 'Critical') AS name1,
         count(*) FILTER (WHERE risk_band = 'High') AS n_high,
         count(*) FILTER (WHERE adjustment_pct > 10) AS n_adj, avg(mean_hrs) AS avg_hrs,
         count(*) FILTER (WHERE risk_band = 'Low') AS n_low FROM or_pf),
b AS (SELECT max(company_name) FILTER (WHERE place = 2) AS name2
      FROM (SELECT company_name, row_number() OVER (ORDER BY company_name) AS place FROM or_pf WHERE risk_band = 'Critical')),
al AS (
  SELECT 1 AS ord, n_crit > 0 AS "on", 'high' AS severity,
         concat(CASE WHEN name2 IS NULL THEN name1 ELSE name1 || ', ' || name2 END,
                CASE WHEN n_crit > 2 THEN ' +' || CAST(n_crit - 2 AS VARCHAR) || ' more' ELSE '' END,
                ' — immediate underwriting review required') AS message, 'Critical' AS band FROM a CROSS JOIN b
  UNION ALL SELECT 2, n_high > 1, 'med', CAST(n_high AS VARCHAR) || ' companies in High risk band — elevated claims exposure', 'High' FROM a
  UNION ALL SELECT 3, n_adj > 0, 'info', CAST(n_adj AS VARCHAR) || ' companies flagged for >10% premium adjustment at renewal', 'Moderate' FROM a
  UNION ALL SELECT 4, avg_hrs > 50, 'info', 'Portfolio avg HRS ' || printf('%.1f', round_even(avg_hrs, 1)) || ' — exceeds 50-point industry benchmark', 'Moderate' FROM a
  UNION ALL SELECT 5, n_low > 0, 'ok', CAST(n_low AS VARCHAR) || ' companies in Low risk band — favourable renewal terms available', 'Low' FROM a)
SELECT CAST(row_number() OVER (ORDER BY ord) AS INTEGER) AS position, severity, message, band
FROM al WHERE "on" QUALIFY row_number() OVER (ORDER BY ord) <= 4""")
def q_alerts(spark, sf):
    """PRT5: up to four portfolio alerts in fixed order."""
    pf, _, _ = _pf(spark, sf)
    return P.portfolio_alerts(pf)


@register("prt6_filter_portfolio", oracle=_BASE + f"""
SELECT company_id, company_name, mean_hrs, risk_band, base_premium * CAST({CURRENCIES['EUR'][2]!r} AS DOUBLE) AS base_premium_fx,
       adjusted * CAST({CURRENCIES['EUR'][2]!r} AS DOUBLE) AS adjusted_fx
FROM or_pf WHERE risk_band <> 'Low' AND lower(company_name) LIKE '%a%'""",
          floats=["mean_hrs", "base_premium_fx", "adjusted_fx"])
def q_filter_portfolio(spark, sf):
    """PRT6: band filter + name search + FX projection (non-Low companies whose name contains 'a', in EUR)."""
    pf, _, _ = _pf(spark, sf)
    df = pf.where(F.col("risk_band") != "Low")
    return P.filter_portfolio(df, None, "A", "EUR").select(
        "company_id", "company_name", "mean_hrs", "risk_band", "base_premium_fx", "adjusted_fx")


@register("prt7_spotlight", oracle=_BASE + """
SELECT company_id, company_name, mean_hrs FROM or_pf ORDER BY mean_hrs DESC, company_id LIMIT 1""",
          floats=["mean_hrs"])
def q_spotlight(spark, sf):
    """PRT7: the highest-risk company."""
    pf, _, _ = _pf(spark, sf)
    return P.spotlight(pf).select("company_id", "company_name", "mean_hrs")


@register("prt8_hrs_histogram", oracle=_BASE + """
, cnt AS (SELECT company_id, CAST(least(floor(hrs / 5e0), 19) AS INTEGER) AS bin, count(*) AS employees
          FROM or_scored GROUP BY ALL),
grid AS (SELECT DISTINCT company_id, CAST(b AS INTEGER) AS bin FROM or_scored CROSS JOIN range(0, 20) AS r(b))
SELECT g.company_id, g.bin, g.bin * 5e0 AS bin_lo, (g.bin + 1) * 5e0 AS bin_hi, coalesce(c.employees, 0) AS employees
FROM grid g LEFT JOIN cnt c ON c.company_id = g.company_id AND c.bin = g.bin""", floats=["bin_lo", "bin_hi"])
def q_histogram(spark, sf):
    """PRT8: 20-bin HRS histogram per company, empty bins included."""
    s, _ = scored(spark, sf)
    return P.hrs_histogram(s, "company_id")


@register("prt9_industry_profile", oracle=_BASE + """
SELECT industry, avg(mean_hrs) AS mean_hrs, CAST(sum(employees) AS BIGINT) AS employees, count(*) AS companies FROM or_pf GROUP BY industry""",
          floats=["mean_hrs"])
def q_industry_profile(spark, sf):
    """PRT9: industry rollup of the portfolio."""
    pf, _, _ = _pf(spark, sf)
    return P.industry_profile(pf)


@register("prt10_workstyle", oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES) + """
SELECT company_id, job_category, count(*) AS employees, least(avg(loss_ratio), 1e0) AS score,
       CAST(round_even(least(avg(loss_ratio), 1e0) * 100, 0) AS INTEGER) AS pct,
       CASE WHEN least(avg(loss_ratio), 1e0) >= 0.8 THEN '#ef4444' WHEN least(avg(loss_ratio), 1e0) >= 0.6 THEN '#f97316'
            WHEN least(avg(loss_ratio), 1e0) >= 0.3 THEN '#eab308' ELSE '#22c55e' END AS colour
FROM or_snapshot WHERE job_category IN ('desk', 'field', 'manual') GROUP BY company_id, job_category""",
          floats=["score"])
def q_workstyle(spark, sf):
    """PRT10: workstyle breakdown per company and job category."""
    return P.workstyle(snapshot(spark, sf))


@register("prt11_band_headcounts", oracle=_BASE + """
SELECT company_id, CAST(floor(employee_count * low_risk_pct / 100e0) AS INTEGER) AS Low,
       CAST(floor(employee_count * moderate_risk_pct / 100e0) AS INTEGER) AS Moderate,
       CAST(floor(employee_count * high_risk_pct / 100e0) AS INTEGER) AS High,
       CAST(floor(employee_count * critical_risk_pct / 100e0) AS INTEGER) AS Critical
FROM or_companies""")
def q_band_headcounts(spark, sf):
    """PRT11: head-count per band (truncated)."""
    _, risk, _ = _pf(spark, sf)
    return P.band_headcounts(risk)


@register("prt12_driver_shares", oracle=_BASE_IMP + """
SELECT company_id, rank, feature, importance,
       CAST(CASE WHEN max(importance) OVER (PARTITION BY company_id) > 0
                 THEN round_even(importance / max(importance) OVER (PARTITION BY company_id) * 100, 0) ELSE 0 END AS INTEGER) AS pct_of_max
FROM or_importance""", floats=["importance"])
def q_driver_shares(spark, sf):
    """PRT12 (+SCO9): top-5 driver bars as percent of the top driver, per company."""
    _, _, s = _pf(spark, sf)
    return P.driver_shares(_importance(s))


@register("prt13_workforce_metrics", oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES) + """
SELECT company_id, avg(avg_daily_steps) AS avg_daily_steps, avg(avg_resting_hr) AS avg_resting_hr,
       sum(smoker) / count(*) * 100 AS smoker_pct, count(*) FILTER (WHERE chronic_count > 0) / count(*) * 100 AS chronic_pct
FROM or_snapshot GROUP BY company_id""", floats=["avg_daily_steps", "avg_resting_hr", "smoker_pct", "chronic_pct"])
def q_workforce(spark, sf):
    """PRT13: workforce metrics per company."""
    return P.workforce_metrics(snapshot(spark, sf))


@register("prt14_cohort", oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES) + """
SELECT company_id, CAST(floor(age / 10) * 10 AS INTEGER) AS age_decade, chronic_count, count(*) AS employees,
       avg(loss_ratio) AS mean_loss_ratio, min(age) AS min_age, max(age) AS max_age
FROM or_snapshot GROUP BY ALL""", floats=["mean_loss_ratio"])
def q_cohort(spark, sf):
    """PRT14: age-decade x chronic-count cohort cells per company."""
    return P.cohort_points(snapshot(spark, sf))


@register("prt14_cohort_points", oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES) + """
SELECT company_id, employee_key, age, loss_ratio, chronic_count FROM or_snapshot""", floats=["loss_ratio"])
def q_cohort_points(spark, sf):
    """PRT14: the cohort's points, one row per person."""
    return P.cohort_rows(snapshot(spark, sf))


@register("prt15_band_distribution", oracle=_BASE + """
SELECT company_id, band, pct FROM (
  SELECT company_id, 'Low' AS band, low_risk_pct AS pct FROM or_companies
  UNION ALL SELECT company_id, 'Moderate', moderate_risk_pct FROM or_companies
  UNION ALL SELECT company_id, 'High', high_risk_pct FROM or_companies
  UNION ALL SELECT company_id, 'Critical', critical_risk_pct FROM or_companies) WHERE pct > 0""", floats=["pct"])
def q_band_distribution(spark, sf):
    """PRT15: long-form band distribution without empty bands."""
    _, risk, _ = _pf(spark, sf)
    return P.band_distribution(risk)


@register("prt16_scored_roster_high", oracle=_BASE + """
SELECT employee_key, company_id, hrs FROM or_scored WHERE hrs >= 60 AND hrs < 80""", floats=["hrs"])
def q_scored_roster(spark, sf):
    """PRT16: scored roster filtered to the High band, highest HRS first."""
    s, _ = scored(spark, sf)
    return P.scored_roster(s, "High").select("employee_key", "company_id", "hrs")


_USD = f"CAST({float(CURRENCIES['USD'][2])!r} AS DOUBLE)"


@register("prt17_report_rows", oracle=_BASE_IMP + f"""
, dv AS (SELECT company_id, string_agg(CAST(rank AS VARCHAR) || ':' || feature, ',' ORDER BY rank) AS drivers FROM or_importance GROUP BY company_id)
SELECT p.company_id, p.company_name, p.industry, p.employees, p.mean_hrs, p.risk_band, c.mean_loss_ratio, c.low_risk_pct,
       c.moderate_risk_pct, c.high_risk_pct, c.critical_risk_pct, 'USD' AS currency, p.base_premium * {_USD} AS base,
       p.adjusted * {_USD} AS adjusted, p.adjustment_pct, p.zone, dv.drivers
FROM or_pf p JOIN or_companies c ON c.company_id = p.company_id LEFT JOIN dv ON dv.company_id = p.company_id""",
          floats=["mean_hrs", "mean_loss_ratio", "low_risk_pct", "moderate_risk_pct", "high_risk_pct", "critical_risk_pct",
                  "base", "adjusted", "adjustment_pct"])
def q_report_rows(spark, sf):
    """PRT17: one underwriting-report record per company (profile, risk, premium in USD, drivers), flattened."""
    pf, risk, s = _pf(spark, sf)
    r = P.report_rows(pf, risk, _importance(s), "USD")
    drivers = F.array_join(F.transform("drivers", lambda d: F.concat(d["rank"].cast("string"), F.lit(":"), d["feature"])), ",")
    return r.select("company_id", "profile.*", "risk.*", "premium.*", drivers.alias("drivers"))
