"""Registered queries: external-schema mappers, replication, alignment, union (MAP*, JIT1)."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import functions as F

from ..functions.expr import keyed_lognormal, keyed_normal, keyed_uniform
from ..operators import mappers as M
from ..operators import notes as N
from ..sources.fixtures import fixture
from .oracle_sql import clip, j_lognormal, j_normal, j_uniform, with_fixtures
from .registry import register

_FEATS = ["age", "gender", "bmi", "smoker", "diabetic", "hypertension", "chronic_count", "avg_daily_steps",
          "step_volatility", "avg_resting_hr", "hr_trend", "avg_active_mins", "avg_sleep_hours", "avg_spo2",
          "visit_count", "hospitalized_count", "lab_heart_flag", "lab_diabetes_flag", "lab_kidney_flag",
          "lab_liver_flag", "lab_inflammation_flag", "lab_iron_flag", "lab_thyroid_flag", "lab_bone_flag",
          "lab_vitamin_flag", "loss_ratio"]
_FLOATS = ["age", "bmi", "chronic_count", "avg_daily_steps", "step_volatility", "avg_resting_hr", "hr_trend",
           "avg_active_mins", "avg_sleep_hours", "avg_spo2", "visit_count", "hospitalized_count", "loss_ratio"]
# integer-valued in some mappers (counts and clamped int sums)
_FLOATS_INT_COUNTS = [c for c in _FLOATS if c not in ("chronic_count", "hospitalized_count")]
_FLOATS_INT_HOSP = [c for c in _FLOATS if c != "hospitalized_count"]


def _sel(df, key):
    return df.select(key, *[F.col(c) for c in _FEATS])


@register("jit1_keyed_jitter", oracle=f"""
SELECT c_custkey, {j_uniform('c_custkey', 'u')} AS u, {j_normal('c_custkey', 'z', 1.0)} AS z,
       {j_lognormal('c_custkey', 'l', 0.35)} AS l FROM customer""", floats=["u", "z", "l"])
def q_jitter(spark, sf):
    """JIT1: keyed uniform / gaussian / lognormal draws per customer key (partition-independent)."""
    from ..sources.tables import read_table
    c = read_table(spark, sf, "customer")
    return c.select("c_custkey", keyed_uniform("c_custkey", "u").alias("u"), keyed_normal("c_custkey", "z").alias("z"),
                    keyed_lognormal("c_custkey", "l", 0.35).alias("l"))


# ---- MAP2 underwriting --------------------------------------------------------------------

def _uw_sql():
    k = "row_key"
    n = lambda name, sd: j_normal(k, name, sd)
    u = lambda name: j_uniform(k, name)
    return f"""
, st AS (SELECT quantile_cont(CASE WHEN coverage_amount = 0 THEN NULL ELSE premium_calculated / CAST(coverage_amount AS DOUBLE) END, 0.5) AS med,
                max(greatest(CAST(previous_claims_count AS DOUBLE), 0e0)) AS cmax FROM fx_underwriting),
a AS (SELECT row_key, CAST(applicant_age AS DOUBLE) AS age, gender, CAST(bmi AS DOUBLE) AS bmi, CAST(smoker AS INTEGER) AS smoker,
             {clip('health_score / 100e0', 0, 1)} AS h, greatest(CAST(previous_claims_count AS DOUBLE), 0e0) AS c,
             coalesce(CASE occupation_risk WHEN 'Low' THEN 0e0 WHEN 'Medium' THEN 1e0 WHEN 'High' THEN 2e0 END, 1e0) AS o,
             CASE WHEN coverage_amount = 0 THEN NULL ELSE premium_calculated / CAST(coverage_amount AS DOUBLE) END AS rate, med, cmax
      FROM fx_underwriting CROSS JOIN st),
b AS (SELECT *, CAST(o >= 1 AND h < 0.58 AS INTEGER) AS diabetic, CAST(o >= 1 OR age >= 50 AS INTEGER) AS hypertension,
             {clip(f'h * 9500 + 1200 + {n("avg_daily_steps", 450)}', 1500, 15000)} AS avg_daily_steps FROM a),
m AS (SELECT row_key, age, gender, bmi, smoker, diabetic, hypertension,
             CAST(least(greatest(diabetic + hypertension + CAST(c >= 3 AS INTEGER), 0), 4) AS INTEGER) AS chronic_count,
             avg_daily_steps,
             {clip(f'(1e0 - h) * 1400 + 150 + {n("step_volatility", 120)}', 50, 3000)} AS step_volatility,
             {clip(f'(1e0 - h) * 24 + 60 + {n("avg_resting_hr", 2.5)}', 45, 105)} AS avg_resting_hr,
             {clip(f'c / greatest(cmax, 1e0) * 2.5 + {n("hr_trend", 0.8)} - 1e0', -5, 5)} AS hr_trend,
             {clip(f'h * 55 + 8 + {n("avg_active_mins", 7)}', 0, 90)} AS avg_active_mins,
             {clip(f'h * 1.8 + 6e0 + {n("avg_sleep_hours", 0.4)}', 4, 9.5)} AS avg_sleep_hours,
             {clip(f'h * 2.5 + 95.5 + {n("avg_spo2", 0.35)}', 90, 100)} AS avg_spo2,
             {clip('c', 0, 10)} AS visit_count,
             CAST(c >= 4 OR (o >= 1 AND h < 0.42) AS INTEGER) AS hospitalized_count,
             CAST(h < 0.55 AND (o >= 1 OR age >= 55) AS INTEGER) AS lab_heart_flag, diabetic AS lab_diabetes_flag,
             CAST(h < 0.55 AND (bmi > 29 OR c >= 3) AS INTEGER) AS lab_kidney_flag,
             CAST(h < 0.55 AND (smoker = 1 OR bmi > 31) AS INTEGER) AS lab_liver_flag,
             CAST(o >= 1 AND h < 0.5 AS INTEGER) AS lab_inflammation_flag,
             CAST({u('lab_iron_flag')} > 0.82 AS INTEGER) AS lab_iron_flag,
             CAST({u('lab_thyroid_flag')} > 0.88 OR (gender = 'F' AND age > 45) AS INTEGER) AS lab_thyroid_flag,
             CAST(age > 58 AS INTEGER) AS lab_bone_flag,
             CAST({u('lab_vitamin_flag')} > 0.72 OR avg_daily_steps < 3500 AS INTEGER) AS lab_vitamin_flag,
             {clip(f'''(0.18e0 + (1e0 - h) * 0.95 + o * 0.18 + c * 0.11 + smoker * 0.10 + {clip('bmi - 27', 0, 12)} * 0.025
                     + ({clip('coalesce(rate, CASE WHEN med IS NOT NULL AND NOT isnan(med) THEN med ELSE 0.02 END) / CASE WHEN med IS NOT NULL AND NOT isnan(med) AND med > 0 THEN med WHEN med IS NULL THEN 0.02 ELSE 1e0 END', 0.5, 3)} - 1e0) * 0.35)
                     * {j_lognormal(k, "loss_ratio", 0.18)}''', 0.1, 6)} AS loss_ratio
      FROM b)"""


@register("map2_underwriting", oracle=with_fixtures(["fx_underwriting"]) + _uw_sql()
          + "\nSELECT row_key, " + ", ".join(_FEATS) + " FROM m", floats=_FLOATS_INT_COUNTS)
def q_underwriting(spark, sf):
    """MAP2: underwriting applicants mapped to the training feature schema (keyed jitter)."""
    return _sel(M.map_underwriting(fixture(spark, sf, "fx_underwriting")), "row_key")


# ---- MAP3 insurance charges -------------------------------------------------------------------

def _ch_sql():
    k = "row_key"
    n = lambda name, sd: j_normal(k, name, sd)
    rr = ("coalesce(CASE region_l WHEN 'southeast' THEN 1.0e0 WHEN 'southwest' THEN 0.82e0 WHEN 'northeast' THEN 0.64e0 "
          "WHEN 'northwest' THEN 0.56e0 END, 0.7e0)")
    return f"""
, st AS (SELECT quantile_cont(CASE WHEN greatest(prediction, 0e0) > 0 THEN greatest(prediction, 0e0) END, 0.5) AS scale FROM fx_charges),
a AS (SELECT row_key, CAST(age AS DOUBLE) AS age,
             coalesce(CASE lower(trim(sex)) WHEN 'male' THEN 'M' WHEN 'm' THEN 'M' WHEN 'female' THEN 'F' WHEN 'f' THEN 'F' END, 'M') AS gender,
             CAST(bmi AS DOUBLE) AS bmi, CAST(coalesce(lower(trim(smoker)) IN ('yes', 'true', '1', 'y'), false) AS INTEGER) AS smoker,
             greatest(coalesce(CAST(children AS DOUBLE), 0e0), 0e0) AS ch, lower(trim(region)) AS region_l,
             greatest(prediction, 0e0) AS charges, scale FROM fx_charges CROSS JOIN st),
b AS (SELECT *, {rr} AS rr, {clip('(bmi - 25e0) / 15e0', 0, 1.5)} AS bmi_r, {clip('(age - 18e0) / 50e0', 0, 1.4)} AS age_r FROM a),
c AS (SELECT *, {clip('smoker * 0.55 + bmi_r * 0.3 + age_r * 0.2', 0, 1.6)} AS life,
             CAST(bmi >= 31 OR (age >= 52 AND smoker = 1) AS INTEGER) AS diabetic,
             CAST(age >= 45 OR bmi >= 30 OR smoker = 1 AS INTEGER) AS hypertension FROM b),
d AS (SELECT *, CAST(least(greatest(diabetic + hypertension + CAST(bmi >= 35 AS INTEGER), 0), 4) AS INTEGER) AS chronic_count,
             {clip(f'10000e0 - life * 3800 - ch * 180 + {n("avg_daily_steps", 550)}', 1500, 15000)} AS avg_daily_steps FROM c),
m AS (SELECT row_key, age, gender, bmi, smoker, diabetic, hypertension, chronic_count, avg_daily_steps,
             {clip(f'240e0 + life * 950 + rr * 140 + abs({n("step_volatility", 140)})', 50, 3000)} AS step_volatility,
             {clip(f'58e0 + life * 22 + rr * 1.5 + {n("avg_resting_hr", 3)}', 45, 110)} AS avg_resting_hr,
             {clip(f'life * 2.6 - 0.8 + {n("hr_trend", 0.75)}', -5, 5)} AS hr_trend,
             {clip(f'62e0 - life * 24 - ch * 1.8 + {n("avg_active_mins", 6)}', 0, 90)} AS avg_active_mins,
             {clip(f'7.6e0 - smoker * 0.35 - bmi_r * 0.65 + {n("avg_sleep_hours", 0.35)}', 4, 9.5)} AS avg_sleep_hours,
             {clip(f'98.4e0 - smoker * 1.2 - bmi_r * 0.7 + {n("avg_spo2", 0.25)}', 90, 100)} AS avg_spo2,
             CAST(round_even(CAST(CAST({clip(f'1e0 + age_r * 2.2 + bmi_r * 1.7 + smoker * 1.1 + ch * 0.2 + {n("visit_count", 0.55)}', 0, 10)} AS VARCHAR) AS DECIMAL(38,20)), 0) AS DOUBLE) AS visit_count,
             CAST(smoker = 1 AND (bmi >= 34 OR age >= 58) AS INTEGER) AS hospitalized_count,
             CAST(age >= 55 OR (smoker = 1 AND bmi >= 30) AS INTEGER) AS lab_heart_flag, diabetic AS lab_diabetes_flag,
             CAST(bmi >= 33 OR chronic_count >= 2 AS INTEGER) AS lab_kidney_flag,
             CAST(smoker = 1 OR bmi >= 32 AS INTEGER) AS lab_liver_flag,
             CAST(smoker = 1 OR ch >= 4 AS INTEGER) AS lab_inflammation_flag,
             CAST(ch >= 3 AND gender = 'F' AS INTEGER) AS lab_iron_flag,
             CAST(gender = 'F' AND age >= 45 AS INTEGER) AS lab_thyroid_flag, CAST(age >= 60 AS INTEGER) AS lab_bone_flag,
             CAST(avg_daily_steps < 4200 OR region_l = 'northeast' AS INTEGER) AS lab_vitamin_flag,
             {clip(f"(0.1e0 + {clip('charges / greatest(coalesce(scale, 1e0), 1e0)', 0.2, 5)} * 0.62 + age_r * 0.18 + bmi_r * 0.18 + smoker * 0.32 + ch * 0.02) * {j_lognormal(k, 'loss_ratio', 0.2)}", 0.1, 6)} AS loss_ratio
      FROM d)"""


@register("map3_charges", oracle=with_fixtures(["fx_charges"]) + _ch_sql()
          + "\nSELECT row_key, " + ", ".join(_FEATS) + " FROM m", floats=_FLOATS_INT_COUNTS)
def q_charges(spark, sf):
    """MAP3: insurance-charge rows mapped to the training feature schema (keyed jitter)."""
    return _sel(M.map_charges(fixture(spark, sf, "fx_charges")), "row_key")


# ---- MAP4/MAP5 market --------------------------------------------------------------------------

def _mk_sql():
    k = "employee_id"
    n = lambda name, sd: j_normal(k, name, sd)
    return f"""
, mk_j AS (SELECT e.*, p.weight_based_premium_inr FROM fx_market e JOIN fx_market_premium p ON p.employee_id = e.employee_id),
mk_a AS (SELECT employee_id, CAST(age AS DOUBLE) AS age,
             coalesce(CASE trim(gender) WHEN 'Male' THEN 'M' WHEN 'Female' THEN 'F' WHEN 'male' THEN 'M' WHEN 'female' THEN 'F' END, 'M') AS gender,
             CAST(bmi AS DOUBLE) AS bmi, CAST(avg_daily_steps AS DOUBLE) AS avg_daily_steps, CAST(avg_sleep_hours AS DOUBLE) AS avg_sleep_hours,
             {clip('coalesce(CAST(chronic_conditions AS DOUBLE), 0e0)', 0, 4)} AS chronic_count,
             CAST(systolic_bp >= 130 OR diastolic_bp >= 80 AS INTEGER) AS hypertension,
             CAST(diabetes_risk_score > 50 AS INTEGER) AS diabetic,
             CAST({j_uniform(k, 'smoker')} < {clip(f"0.06e0 + stress_score / 100e0 * 0.14 + {clip('(CAST(bmi AS DOUBLE) - 22) / 18', 0, 1)} * 0.06", 0, 0.28)} AS INTEGER) AS smoker,
             wellness_engagement_score / 100e0 AS w, wellness_engagement_score AS w100,
             coalesce(CASE activity_level WHEN 'High' THEN 0.85e0 WHEN 'Moderate' THEN 0.5e0 WHEN 'Low' THEN 0.2e0 END, 0.5e0) AS act,
             coalesce(CAST(historical_claims_inr AS DOUBLE), 0e0) AS claims, systolic_bp AS sbp, diastolic_bp AS dbp,
             CASE WHEN weight_based_premium_inr = 0 THEN NULL ELSE CAST(weight_based_premium_inr AS DOUBLE) END AS prem FROM mk_j),
mk_m AS (SELECT employee_id, age, gender, bmi, smoker, diabetic, hypertension, chronic_count, avg_daily_steps,
             {clip(f'(1e0 - w) * 1200 + 100 + {n("step_volatility", 150)}', 50, 3000)} AS step_volatility,
             {clip(f'72e0 - w * 18 + {n("avg_resting_hr", 3)}', 45, 110)} AS avg_resting_hr,
             {clip(f'(1e0 - w) * 2.2 - 0.8 + {n("hr_trend", 0.5)}', -5, 5)} AS hr_trend,
             {clip(f'act * 70 + {n("avg_active_mins", 8)}', 0, 90)} AS avg_active_mins, avg_sleep_hours,
             {clip(f'96e0 + w * 2.5 + {n("avg_spo2", 0.3)}', 90, 100)} AS avg_spo2,
             CAST(round_even(CAST(CAST({clip('1e0 + chronic_count * 1.5 + CAST(claims > 0 AS DOUBLE) * 1.5', 0, 10)} AS VARCHAR) AS DECIMAL(38,20)), 0) AS DOUBLE) AS visit_count,
             CAST(claims > 50000 AS INTEGER) AS hospitalized_count,
             CAST(age >= 55 OR sbp >= 140 OR (diabetic = 1 AND age >= 45) AS INTEGER) AS lab_heart_flag, diabetic AS lab_diabetes_flag,
             CAST(bmi >= 33 OR chronic_count >= 2 OR dbp >= 90 AS INTEGER) AS lab_kidney_flag,
             CAST(bmi >= 32 OR smoker = 1 AS INTEGER) AS lab_liver_flag,
             CAST(sbp >= 140 OR chronic_count >= 2 AS INTEGER) AS lab_inflammation_flag,
             CAST(gender = 'F' AND age >= 30 AND w100 < 50 AS INTEGER) AS lab_iron_flag,
             CAST(gender = 'F' AND age >= 45 AS INTEGER) AS lab_thyroid_flag, CAST(age >= 60 AS INTEGER) AS lab_bone_flag,
             CAST(avg_daily_steps < 4000 OR w100 < 40 AS INTEGER) AS lab_vitamin_flag,
             {clip(f"CASE WHEN claims / prem IS NULL OR claims / prem < 0.05 THEN {clip(f'exp({math.log(0.09)!r} + {j_normal(k, 'loss_ratio_fill', 0.6, 55)})', 0.05, 0.35)} ELSE claims / prem END", 0.05, 6)} AS loss_ratio
      FROM mk_a)"""


_MK = with_fixtures(["fx_market", "fx_market_premium"]) + _mk_sql()


def market_rows(spark, sf):
    j = M.join_market(fixture(spark, sf, "fx_market"), fixture(spark, sf, "fx_market_premium"))
    return M.map_market(j)


@register("map4_market", oracle=_MK + "\nSELECT employee_id, " + ", ".join(_FEATS) + " FROM mk_m",
          floats=_FLOATS_INT_HOSP)
def q_market(spark, sf):
    """MAP4 + MAP5: market employee file joined to the premium file, mapped to features with the observed LR."""
    return _sel(market_rows(spark, sf), "employee_id")


@register("map5_join_market", oracle=with_fixtures(["fx_market", "fx_market_premium"]) + """
SELECT e.employee_id, e.age, p.weight_based_premium_inr FROM fx_market e JOIN fx_market_premium p ON p.employee_id = e.employee_id""",
          floats=["age", "weight_based_premium_inr"])
def q_join_market(spark, sf):
    """MAP5: inner join of the two market files (unmatched employees drop out)."""
    j = M.join_market(fixture(spark, sf, "fx_market"), fixture(spark, sf, "fx_market_premium"))
    return j.select("employee_id", "age", "weight_based_premium_inr")


def _rep_sql(src: str, key: str, n: int):
    cols = []
    for c, (sd, lo, hi) in M.REPLICATION_NOISE.items():
        cols.append(f"CASE WHEN copy = 0 THEN CAST({c} AS DOUBLE) ELSE "
                    f"{clip(f'CAST({c} AS DOUBLE) + {j_normal(key, c, sd, 49, copy)}', lo, hi)} END AS {c}")
    cols.append(f"CASE WHEN copy = 0 THEN loss_ratio ELSE "
                f"{clip(f'loss_ratio * {j_lognormal(key, 'loss_ratio', 0.35, 49, copy)}', 0.05, 6)} END AS loss_ratio")
    return f", rep AS (SELECT {key}, copy, {', '.join(cols)} FROM {src} CROSS JOIN range(0, {n + 1}) AS r(copy))"


copy = "copy"


@register("map7_replicate_market", oracle=_MK + _rep_sql("mk_m", "employee_id", 8)
          + "\nSELECT employee_id, CAST(copy AS INTEGER) AS copy, " + ", ".join(list(M.REPLICATION_NOISE) + ["loss_ratio"]) + " FROM rep",
          floats=list(M.REPLICATION_NOISE) + ["loss_ratio"])
def q_replicate_market(spark, sf):
    """MAP6 + MAP7: market rows x 9 with noisy copies (copy 0 unchanged)."""
    r = M.replicate_market(market_rows(spark, sf))
    return r.select("employee_id", "copy", *M.REPLICATION_NOISE, "loss_ratio")


# ---- MAP8 lab reports -----------------------------------------------------------------------

def _lab_sql():
    k = "patient_name"
    n = lambda name, sd: j_normal(k, name, sd, 55)
    flags = []
    for flag, kws in M.LAB_KEYWORDS.items():
        hit = " OR ".join(f"contains(lower(test_name), '{kw}')" for kw in kws)
        flags.append(f"max(CAST(coalesce(abnormal, false) AND ({hit}) AS INTEGER)) AS {flag}")
    return f"""
, lb_g AS (SELECT patient_name, {", ".join(flags)},
               CAST(arg_min(age, row(report_id, line_no, age)) AS DOUBLE) AS age,
               arg_min(sex, row(report_id, line_no, sex)) AS sex0
        FROM fx_lab_reports GROUP BY patient_name),
lb_h AS (SELECT *, CASE WHEN starts_with(lower(trim(sex0)), 'f') THEN 'F' ELSE 'M' END AS gender,
             CAST(age >= 60 AS INTEGER) AS lab_bone_flag, lab_diabetes_flag AS diabetic,
             CAST((lab_kidney_flag = 1 OR lab_heart_flag = 1) AND age > 50 AS INTEGER) AS hypertension FROM lb_g),
lb_i AS (SELECT *, lab_heart_flag + lab_inflammation_flag + lab_diabetes_flag + lab_kidney_flag + lab_liver_flag + lab_iron_flag
                + lab_thyroid_flag + lab_bone_flag + lab_vitamin_flag AS nf FROM lb_h),
lb_j AS (SELECT *, greatest(0e0, 1e0 - nf * 0.12) AS hh FROM lb_i),
lb_m AS (SELECT patient_name, age, gender, {clip(f'23.5e0 + (1e0 - hh) * 5e0 + {n("bmi", 1.5)}', 17, 42)} AS bmi,
             CAST({j_uniform(k, 'smoker', 55)} < 0.08e0 + (1e0 - hh) * 0.12 AS INTEGER) AS smoker, diabetic, hypertension,
             CAST(least(nf, 4) AS DOUBLE) AS chronic_count,
             {clip(f'hh * 8000e0 + 1000e0 + {n("avg_daily_steps", 600)}', 1000, 15000)} AS avg_daily_steps,
             {clip(f'(1e0 - hh) * 1000e0 + 150e0 + {n("step_volatility", 120)}', 50, 3000)} AS step_volatility,
             {clip(f'(1e0 - hh) * 18e0 + 68e0 + {n("avg_resting_hr", 3)}', 45, 110)} AS avg_resting_hr,
             {clip(f'(1e0 - hh) * 2e0 - 0.5 + {n("hr_trend", 0.4)}', -5, 5)} AS hr_trend,
             {clip(f'hh * 55e0 + 5e0 + {n("avg_active_mins", 7)}', 0, 90)} AS avg_active_mins,
             {clip(f'hh * 1.8 + 6e0 + {n("avg_sleep_hours", 0.4)}', 4, 9.5)} AS avg_sleep_hours,
             {clip(f'hh * 2e0 + 96e0 + {n("avg_spo2", 0.3)}', 90, 100)} AS avg_spo2,
             {clip(f'1e0 + nf * 1.2 + {n("visit_count", 0.5)}', 0, 10)} AS visit_count,
             CAST(nf >= 3 OR diabetic = 1 AS INTEGER) AS hospitalized_count,
             lab_heart_flag, lab_diabetes_flag, lab_kidney_flag, lab_liver_flag, lab_inflammation_flag, lab_iron_flag,
             lab_thyroid_flag, lab_bone_flag, lab_vitamin_flag,
             {clip(f"(0.12e0 + greatest(age - 25e0, 0e0) / 60e0 * 0.25 + nf * 0.09) * {j_lognormal(k, 'loss_ratio', 0.18, 55)}", 0.05, 6)} AS loss_ratio
      FROM lb_j)"""


_LAB = with_fixtures(["fx_lab_reports"]) + _lab_sql()


@register("map8_lab_reports", oracle=_LAB + "\nSELECT patient_name, " + ", ".join(_FEATS) + " FROM lb_m",
          floats=_FLOATS_INT_HOSP)
def q_lab_reports(spark, sf):
    """MAP8: lab report lines -> one training row per patient (keyword flags on abnormal tests)."""
    return _sel(M.map_lab_reports(fixture(spark, sf, "fx_lab_reports")), "patient_name")


@register("map7_replicate_lab_reports", oracle=_LAB + _rep_sql("lb_m", "patient_name", 4)
          + "\nSELECT patient_name, CAST(copy AS INTEGER) AS copy, " + ", ".join(list(M.REPLICATION_NOISE) + ["loss_ratio"]) + " FROM rep",
          floats=list(M.REPLICATION_NOISE) + ["loss_ratio"])
def q_replicate_labs(spark, sf):
    """MAP6 + MAP7: lab-report rows x 5 with noisy copies."""
    r = M.replicate_lab_reports(M.map_lab_reports(fixture(spark, sf, "fx_lab_reports")))
    return r.select("patient_name", "copy", *M.REPLICATION_NOISE, "loss_ratio")


# ---- MAP11 distribution alignment -------------------------------------------------------------

@register("map11_align_distribution", oracle=with_fixtures(["fx_lab_reports", "fx_market", "fx_market_premium"])
          + _lab_sql() + _mk_sql() + """
, refv AS (SELECT loss_ratio AS v, row_number() OVER (ORDER BY loss_ratio) - 1 AS idx FROM mk_m),
mm AS (SELECT count(*) AS m FROM refv), nn AS (SELECT count(*) AS n FROM lb_m),
rk AS (SELECT patient_name, row_number() OVER (ORDER BY loss_ratio, patient_name) - 1 AS r FROM lb_m),
p AS (SELECT patient_name, least(greatest((r + 0.5) / n, 0e0), 1e0) * (mm.m - 1) AS pos, mm.m FROM rk CROSS JOIN nn CROSS JOIN mm),
q AS (SELECT patient_name, pos, CAST(floor(pos) AS BIGINT) AS lo, least(CAST(floor(pos) AS BIGINT) + 1, m - 1) AS hi FROM p)
SELECT q.patient_name, a.v + (q.pos - q.lo) * (b.v - a.v) AS loss_ratio
FROM q LEFT JOIN refv a ON a.idx = q.lo LEFT JOIN refv b ON b.idx = q.hi""", floats=["loss_ratio"])
def q_align(spark, sf):
    """MAP11: lab-report LRs quantile-mapped onto the market LR distribution (distributed ranks)."""
    labs = M.map_lab_reports(fixture(spark, sf, "fx_lab_reports"))
    ref = market_rows(spark, sf)
    return M.align_distribution(labs, ref, "patient_name").select("patient_name", "loss_ratio")


# ---- MAP9/MAP10 notes -------------------------------------------------------------------------

def _py_to_duck(p):
    return p.replace("'", "''")


def _notes_sql():
    sec = ("CASE WHEN strpos(text, '### Instruction:') > 0 THEN trim(CASE WHEN strpos(text, '### Response:') > 0 "
           "THEN substr(text, strpos(text, '### Instruction:') + 16, greatest(strpos(text, '### Response:') - "
           "(strpos(text, '### Instruction:') + 16), 0)) ELSE substr(text, strpos(text, '### Instruction:') + 16) END, ' ') "
           "ELSE text END")
    age = "NULL"
    for pat in reversed(N.AGE_PATTERNS):
        v = f"TRY_CAST(nullif(regexp_extract(t, '{_py_to_duck(pat)}', 1, 'i'), '') AS INTEGER)"
        age = f"CASE WHEN {v} > 0 AND {v} < 120 THEN CAST({v} AS DOUBLE) ELSE {age} END"
    spo2 = "NULL"
    for pat, grp in reversed(N.SPO2_PATTERNS):
        v = f"TRY_CAST(nullif(regexp_extract(t, '{_py_to_duck(pat)}', {grp}, 'i'), '') AS DOUBLE)"
        spo2 = f"CASE WHEN {v} >= 70 AND {v} <= 100 THEN {v} ELSE {spo2} END"
    bmi_v = f"TRY_CAST(nullif(regexp_extract(t, '{_py_to_duck(N.BMI_PATTERN)}', 1, 'i'), '') AS DOUBLE)"
    conds = ", ".join(
        f"CAST(regexp_matches(t, '{_py_to_duck('|'.join(f'(?:{p})' for p in v))}', 'i') AS INTEGER) AS {k}"
        for k, v in N.CONDITIONS.items())
    cnt = lambda p: f"len(regexp_extract_all(t, '{_py_to_duck(p)}', 0, 'i'))"
    chronic = " + ".join(N.CHRONIC)
    sev = " + ".join(f"{k} * {w}" for k, w in N.SEVERITY_WEIGHTS.items())
    return f"""
, s AS (SELECT note_id, {sec} AS t FROM fx_notes),
p0 AS (SELECT note_id, coalesce({age}, 45e0) AS age,
              CASE WHEN {cnt(N.FEMALE_PATTERN)} > {cnt(N.MALE_PATTERN)} THEN 'F' ELSE 'M' END AS gender,
              CASE WHEN {bmi_v} > 10 AND {bmi_v} < 70 THEN {bmi_v} ELSE 26e0 END AS bmi, {conds},
              coalesce({spo2}, 97e0) AS avg_spo2 FROM s),
p1 AS (SELECT *, CAST({chronic} AS DOUBLE) AS chronic_count FROM p0),
p2 AS (SELECT *, CAST(1 + icu AS DOUBLE) AS hospitalized_count, CAST(least(2 + chronic_count + icu * 2, 10e0) AS DOUBLE) AS visit_count,
              greatest(age - 18, 0e0) / 80 * 0.4 AS age_risk, chronic_count * 0.08 AS cond_risk, (0e0 + {sev}) AS serious FROM p1),
parsed AS (SELECT note_id, age, gender, bmi, smoker, diabetic, hypertension, chronic_count, avg_spo2, visit_count, hospitalized_count,
                  icu, cancer, renal, sepsis,
                  0.2e0 + age_risk + cond_risk + serious + (smoker * 0.1 + greatest(bmi - 30, 0e0) / 10 * 0.1) AS loss_ratio,
                  age_risk + cond_risk + serious AS severity,
                  heart_dis AS lab_heart_flag, diabetic AS lab_diabetes_flag, renal AS lab_kidney_flag, liver_dis AS lab_liver_flag,
                  CAST(sepsis = 1 OR respiratory = 1 AS INTEGER) AS lab_inflammation_flag, anemia AS lab_iron_flag,
                  thyroid_dis AS lab_thyroid_flag, CAST(osteo = 1 OR age > 60 AS INTEGER) AS lab_bone_flag,
                  vitamin_def AS lab_vitamin_flag FROM p2)"""


_NOTES = with_fixtures(["fx_notes"]) + _notes_sql()
_PARSED_COLS = ["age", "gender", "bmi", "smoker", "diabetic", "hypertension", "chronic_count", "avg_spo2", "visit_count",
                "hospitalized_count", "icu", "cancer", "renal", "sepsis", "loss_ratio", "lab_heart_flag",
                "lab_diabetes_flag", "lab_kidney_flag", "lab_liver_flag", "lab_inflammation_flag", "lab_iron_flag",
                "lab_thyroid_flag", "lab_bone_flag", "lab_vitamin_flag"]


@register("map9_parse_notes", oracle=_NOTES + "\nSELECT note_id, " + ", ".join(_PARSED_COLS) + " FROM parsed",
          floats=["age", "bmi", "chronic_count", "avg_spo2", "visit_count", "hospitalized_count", "loss_ratio"])
def q_parse_notes(spark, sf):
    """MAP9: clinical notes parsed with JVM regexes (instruction section only), every note whole."""
    return N.parse_notes(fixture(spark, sf, "fx_notes")).select("note_id", *_PARSED_COLS)


def _map_notes_sql():
    k = "note_id"
    n = lambda name, sd: j_normal(k, name, sd)
    h = f"{clip(f'1e0 - {clip('severity', 0, 1.2)} / 1.2', 0, 1)}"
    return f"""
, mn AS (SELECT note_id, {h} AS hh, * EXCLUDE (note_id) FROM parsed),
m AS (SELECT note_id, age, gender, bmi, smoker, diabetic, hypertension, chronic_count,
             {clip(f'hh * 9000 + 1000 + {n("avg_daily_steps", 600)}', 1000, 15000)} AS avg_daily_steps,
             {clip(f'(1e0 - hh) * 1400 + 100 + {n("step_volatility", 150)}', 50, 3000)} AS step_volatility,
             {clip(f'(1e0 - hh) * 22 + 65 + {n("avg_resting_hr", 3)}', 45, 110)} AS avg_resting_hr,
             ({j_uniform(k, 'hr_trend')} - 0.5) * 6 AS hr_trend,
             {clip(f'hh * 55 + 5 + {n("avg_active_mins", 8)}', 0, 90)} AS avg_active_mins,
             {clip(f'hh * 2e0 + 6e0 + {n("avg_sleep_hours", 0.5)}', 3, 10)} AS avg_sleep_hours,
             {clip(f'avg_spo2 + {n("avg_spo2", 0.3)}', 90, 100)} AS avg_spo2,
             visit_count, hospitalized_count, lab_heart_flag, lab_diabetes_flag, lab_kidney_flag, lab_liver_flag,
             lab_inflammation_flag, lab_iron_flag, lab_thyroid_flag, lab_bone_flag, lab_vitamin_flag,
             {clip(f"loss_ratio * {j_lognormal(k, 'loss_ratio', 0.25)}", 0.1, 6)} AS loss_ratio FROM mn)"""


@register("map10_map_notes", oracle=_NOTES + _map_notes_sql() + "\nSELECT note_id, " + ", ".join(_FEATS) + " FROM m",
          floats=_FLOATS)
def q_map_notes(spark, sf):
    """MAP10 (+MAP9): parsed notes -> training feature rows with keyed jitter."""
    return _sel(N.map_notes(N.parse_notes(fixture(spark, sf, "fx_notes"))), "note_id")


# ---- MAP1, MAP12-MAP15 -------------------------------------------------------------------------

_SOURCES = {"underwriting": "fx_underwriting", "charges": "fx_charges", "notes": "fx_notes"}


def training_sources(spark, sf):
    return {
        "underwriting": M.map_underwriting(fixture(spark, sf, "fx_underwriting")),
        "charges": M.map_charges(fixture(spark, sf, "fx_charges")),
        "excel": market_rows(spark, sf),
        "clinical_lab": M.map_lab_reports(fixture(spark, sf, "fx_lab_reports")),
        "notes": N.map_notes(N.parse_notes(fixture(spark, sf, "fx_notes"))),
    }


@register("map1_infer_schema_kind", oracle=with_fixtures(list(_SOURCES.values())) + """
SELECT 'underwriting' AS dataset, 'underwriting_tabular' AS kind, count(*) AS rows FROM fx_underwriting
UNION ALL SELECT 'charges', 'insurance_charges', count(*) FROM fx_charges
UNION ALL SELECT 'notes', 'clinical_notes', count(*) FROM fx_notes""")
def q_infer_kind(spark, sf):
    """MAP1: schema kind of each external dataset, inferred from its columns, and its rows."""
    tables = {name: fixture(spark, sf, fx) for name, fx in _SOURCES.items()}
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("dataset"), F.lit(M.infer_schema_kind(df)).alias("kind"), "rows")
             for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("map12_14_source_counts", oracle=with_fixtures(["fx_underwriting", "fx_charges", "fx_market", "fx_market_premium",
                                                          "fx_lab_reports", "fx_notes"]) + """
, c AS (SELECT 'underwriting' AS source, count(*) AS rows FROM fx_underwriting
        UNION ALL SELECT 'charges', count(*) FROM fx_charges
        UNION ALL SELECT 'excel', count(*) FROM fx_market e JOIN fx_market_premium p ON p.employee_id = e.employee_id
        UNION ALL SELECT 'clinical_lab', count(DISTINCT patient_name) FROM fx_lab_reports
        UNION ALL SELECT 'notes', count(*) FROM fx_notes)
SELECT source, rows FROM c UNION ALL SELECT 'combined', CAST(sum(rows) AS BIGINT) FROM c""")
def q_source_counts(spark, sf):
    """MAP12 + MAP14: all five mapped sources unioned by name with dataset_source; rows per source + combined."""
    u = M.union_sources(training_sources(spark, sf))
    return M.source_counts(u)


@register("map15_distribution_summary", oracle=_MK + """
SELECT avg(loss_ratio) AS mean, stddev_samp(loss_ratio) AS std, quantile_cont(loss_ratio, 0.05) AS p5,
       quantile_cont(loss_ratio, 0.95) AS p95 FROM mk_m""", floats=["mean", "std", "p5", "p95"])
def q_distribution(spark, sf):
    """MAP15: loss-ratio distribution line (mean, std, p5, p95) of the market source."""
    return M.distribution_summary(market_rows(spark, sf))


@register("map13_tolerant_union", oracle=with_fixtures(["fx_underwriting"]) + """
, c AS (SELECT 'excel' AS source, count(*) AS rows FROM fx_underwriting)
SELECT source, rows FROM c UNION ALL SELECT 'combined', CAST(sum(rows) AS BIGINT) FROM c""")
def q_tolerant_union(spark, sf):
    """MAP13 (+MAP12, MAP14): in a tolerant mode a source that fails to load (here a missing landed
    snapshot) is skipped; the others are unioned and counted."""
    from ..session import scratch_path
    missing = scratch_path(spark, "missing-snapshot-never-written")
    u, _skipped = M.training_data("excel-hf", {
        "excel": lambda: M.map_underwriting(fixture(spark, sf, "fx_underwriting")),
        "hub": lambda: M.map_underwriting(spark.read.parquet(missing)),
    })
    return M.source_counts(u)
