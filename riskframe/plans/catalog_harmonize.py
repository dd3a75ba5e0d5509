"""Registered queries: upload harmonisation and the scoring-tab normaliser (HRM*)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.constants import (ACTIVITY_DOMAIN_COLUMNS, CANONICAL_COLS, LAB_DOMAINS, MARKER_TO_DOMAIN,
                                   OOR_RISK, OOR_STATUS)
from ..operators import harmonize as H
from ..sources.fixtures import fixture
from ..operators.rollup import SNAPSHOT_COLUMNS
from .catalog_core import _SNAP_FLOATS, snapshot
from .oracle_sql import CORE_FIXTURES, SNAPSHOT_CTES, rnd, with_fixtures
from .registry import register

# Upload headers as a customer would send them (fixture columns -> raw header text).
UPLOAD_HEADERS = {"emp_id": "Emp ID", "sex": "SEX", "body_mass_index": "Body Mass Index",
                  "tobacco_use": "Tobacco Use", "lr": "LR", "favourite_colour": "Favourite Colour"}


def upload(spark, sf, name="fx_upload"):
    df = fixture(spark, sf, name)
    return df.select(*[F.col(c).alias(UPLOAD_HEADERS[c]) for c in df.columns])


def _list(xs):
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


_MARKERS = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in MARKER_TO_DOMAIN.items()) + ") AS mk(code, domain)"
_NORM = "regexp_replace(upper(marker_code), '[^\\p{L}\\p{N}]', '', 'g')"
_OOR = (f"(coalesce(lower(trim(status)) IN {_list(OOR_STATUS)}, false) "
        f"OR coalesce(lower(trim(risk_level)) IN {_list(OOR_RISK)}, false))")
_LABS = with_fixtures(["fx_lab_results"]) + f"""
, ld AS (SELECT l.*, mk.domain, {_OOR} AS oor FROM fx_lab_results l LEFT JOIN {_MARKERS} ON mk.code = {_NORM.replace('marker_code', 'l.marker_code')})"""


@register("hrm13_marker_domain", oracle=_LABS + "\nSELECT report_id, line_no, marker_code, domain FROM ld")
def q_marker_domain(spark, sf):
    """HRM13: lab marker codes normalised (upper, alphanumerics) and mapped to a health domain."""
    return H.marker_domain(fixture(spark, sf, "fx_lab_results")).select("report_id", "line_no", "marker_code", "domain")


@register("hrm14_out_of_range", oracle=_LABS + "\nSELECT report_id, line_no, marker_code, oor AS out_of_range FROM ld")
def q_out_of_range(spark, sf):
    """HRM14: out-of-range predicate on lab status / risk level."""
    l = fixture(spark, sf, "fx_lab_results")
    return l.select("report_id", "line_no", "marker_code", H.is_out_of_range("status", "risk_level").alias("out_of_range"))


_PIVOT_FLAGS = ", ".join(f"max(CASE WHEN domain = '{d}' AND oor THEN 1 ELSE 0 END) AS lab_{d}_flag" for d in LAB_DOMAINS)
_PIVOT = _LABS + f"""
, pv0 AS (SELECT CAST(unique_id AS VARCHAR) AS employee_id, {_PIVOT_FLAGS},
                 arg_min(gender, row(report_id, line_no, gender)) FILTER (WHERE gender IS NOT NULL) AS g
          FROM ld GROUP BY 1),
pv AS (SELECT * EXCLUDE (g), CASE WHEN substr(upper(g), 1, 1) IN ('M', 'F', 'O') THEN substr(upper(g), 1, 1) END AS gender
       FROM pv0),
lab_pivot AS (SELECT *, lab_diabetes_flag AS diabetic_inferred,
                 CASE WHEN gender IS NULL THEN lab_heart_flag ELSE 0 END AS hypertension_inferred FROM pv)"""


@register("hrm16_pivot_labs", oracle=_PIVOT + "\nSELECT * FROM lab_pivot")
def q_pivot_labs(spark, sf):
    """HRM16 (+HRM13, HRM14): long lab lines -> one row per subject with nine flags and inferred conditions."""
    return H.pivot_labs(fixture(spark, sf, "fx_lab_results"))


_ACT_COLS = {"boneHealth": "bone_health", "diabetes": "diabetes", "heartHealth": "heart_health",
             "inflammation": "inflammation", "iron": "iron", "kidneyHealth": "kidney_health",
             "liverHealth": "liver_health", "thyroidHealth": "thyroid_health",
             "vitaminDeficiency": "vitamin_deficiency"}


@register("hrm17_map_activity", oracle=with_fixtures(["fx_activity"]) + "\nSELECT CAST(user_id AS VARCHAR) AS employee_id, "
          + ", ".join(f"CAST(coalesce(lower(trim({_ACT_COLS[s]})) IN {_list(OOR_STATUS)}, false) AS INTEGER) AS lab_{d}_flag"
                      for s, d in ACTIVITY_DOMAIN_COLUMNS.items())
          + """, step_count AS avg_daily_steps,
       CASE WHEN total_active_minutes = 0 THEN steps_active_minutes ELSE total_active_minutes END / 365e0 AS avg_active_mins,
       CAST(coalesce(lower(trim(diabetes)) IN """ + _list(OOR_STATUS) + """, false) AS INTEGER) AS diabetic_inferred,
       CAST(coalesce(lower(trim(heart_health)) IN """ + _list(OOR_STATUS) + """, false) AS INTEGER) AS hypertension_inferred
FROM fx_activity""", floats=["avg_daily_steps", "avg_active_mins"])
def q_map_activity(spark, sf):
    """HRM17: yearly activity rows -> nine flags, steps and active minutes per day."""
    return H.map_activity(fixture(spark, sf, "fx_activity"))


_MODE = lambda c: (f"(SELECT {c} FROM (SELECT {c}, count(*) AS n FROM or_snapshot WHERE {c} IS NOT NULL GROUP BY {c}) "
                   f"ORDER BY n DESC, {c} LIMIT 1)")
_POP = with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES) + f"""
, pop AS (SELECT CAST(trunc(quantile_cont(age, 0.5)) AS INTEGER) AS age, {_MODE('gender')} AS gender,
                 {rnd('quantile_cont(bmi, 0.5)', 1)} AS bmi, {_MODE('smoker')} AS smoker, {_MODE('diabetic')} AS diabetic,
                 {_MODE('hypertension')} AS hypertension, {_MODE('job_category')} AS job_category FROM or_snapshot)"""


@register("hrm15_population_defaults", oracle=_POP + "\nSELECT * FROM pop", floats=["bmi"])
def q_population_defaults(spark, sf):
    """HRM15: population defaults (median age/bmi, modal gender/flags/job) from the training snapshot."""
    return H.population_defaults(snapshot(spark, sf))


#: Date of the snapshots that carry lab flags.
LABS_AS_OF = "1996-06-30"
#: or_snapshot with the lab flags of each person as of that date (needs fx_lab_results).
LAB_SNAPSHOT_CTES = f"""
or_lab_lines AS (
  SELECT l.unique_id, l.report_date, mk.domain, {_OOR} AS oor
  FROM fx_lab_results l JOIN {_MARKERS} ON mk.code = {_NORM.replace('marker_code', 'l.marker_code')}
  WHERE l.report_date <= DATE '{LABS_AS_OF}'),
or_lab_last AS (
  SELECT unique_id, domain, max(CASE WHEN oor THEN 1 ELSE 0 END) AS flag
  FROM (SELECT *, rank() OVER (PARTITION BY unique_id, domain ORDER BY report_date DESC) AS age FROM or_lab_lines)
  WHERE age = 1 GROUP BY unique_id, domain),
or_lab_snapshot AS (
  SELECT s.*, {", ".join(f"CAST(coalesce(max(flag) FILTER (WHERE domain = '{d}'), 0) AS INTEGER) AS lab_{d}_flag" for d in LAB_DOMAINS)}
  FROM or_snapshot s LEFT JOIN or_lab_last l ON l.unique_id = s.employee_key GROUP BY ALL)
"""

LAB_ROWS_SQL = _PIVOT.replace(with_fixtures(["fx_lab_results"]), with_fixtures(["fx_lab_results"] + list(CORE_FIXTURES))
                             + ",\n" + SNAPSHOT_CTES.strip()) + _POP.split("\n, pop AS", 1)[1].join([",\npop AS", ""]) + """,
lab_rows AS (
SELECT employee_id, d.age, coalesce(p.gender, d.gender) AS gender, d.bmi, d.smoker,
       coalesce(p.diabetic_inferred, d.diabetic) AS diabetic, coalesce(p.hypertension_inferred, d.hypertension) AS hypertension,
       d.job_category, coalesce(p.diabetic_inferred, d.diabetic) + coalesce(p.hypertension_inferred, d.hypertension) AS chronic_count,
       6000e0 AS avg_daily_steps, 500e0 AS step_volatility, 72e0 AS avg_resting_hr, 0e0 AS hr_trend, 30e0 AS avg_active_mins,
       7e0 AS avg_sleep_hours, 97e0 AS avg_spo2, 0 AS visit_count, 0 AS hospitalized_count
FROM lab_pivot p CROSS JOIN pop d)"""


def lab_snapshot(spark, sf):
    """The training snapshot with each person's lab flags as of ``LABS_AS_OF``."""
    from ..operators.rollup import attach_lab_flags
    return attach_lab_flags(snapshot(spark, sf), fixture(spark, sf, "fx_lab_results"), LABS_AS_OF)


@register("agg7_snapshot_labs", oracle=with_fixtures([*CORE_FIXTURES, "fx_lab_results"], SNAPSHOT_CTES, LAB_SNAPSHOT_CTES)
          + "\nSELECT employee_key, " + ", ".join(f"lab_{d}_flag" for d in LAB_DOMAINS) + " FROM or_lab_snapshot")
def q_snapshot_labs(spark, sf):
    """AGG7 (+SRC5): the nine lab flags of every person of the snapshot, as of its date."""
    return lab_snapshot(spark, sf).select("employee_key", *[f"lab_{d}_flag" for d in LAB_DOMAINS])


@register("hrm18_feature_rows_lab", oracle=LAB_ROWS_SQL + "\nSELECT * FROM lab_rows",
          floats=["bmi", "avg_daily_steps", "step_volatility", "avg_resting_hr", "hr_trend", "avg_active_mins",
                  "avg_sleep_hours", "avg_spo2"])
def q_feature_rows_lab(spark, sf):
    """HRM18 (+HRM15, HRM16, HRM19): lab upload -> scoring feature rows with population defaults."""
    rows = H.to_feature_rows(H.pivot_labs(fixture(spark, sf, "fx_lab_results")), H.population_defaults(snapshot(spark, sf)))
    return rows.select(*[c for c in rows.columns if not c.startswith("_filled_")])


_TELEMETRY_SQL = ("500e0 AS step_volatility, 72e0 AS avg_resting_hr, 0e0 AS hr_trend, {active} AS avg_active_mins, 7e0 AS avg_sleep_hours, "
                  "97e0 AS avg_spo2, 0 AS visit_count, 0 AS hospitalized_count")
_FEATURE_FLOATS = ["bmi", "avg_daily_steps", "step_volatility", "avg_resting_hr", "hr_trend", "avg_active_mins", "avg_sleep_hours",
                   "avg_spo2"]
_OUT = "IN " + _list(OOR_STATUS)


def _shown(rows):
    return rows.select(*[c for c in rows.columns if not c.startswith("_filled_")])


@register("hrm18_feature_rows_activity", oracle=_POP.replace(with_fixtures(CORE_FIXTURES), with_fixtures([*CORE_FIXTURES, "fx_activity"])) + f"""
, act AS (SELECT *, CAST(coalesce(lower(trim(diabetes)) {_OUT}, false) AS INTEGER) AS dia,
                 CAST(coalesce(lower(trim(heart_health)) {_OUT}, false) AS INTEGER) AS hyp FROM fx_activity)
SELECT CAST(user_id AS VARCHAR) AS employee_id, 38 AS age, d.gender, d.bmi, 1 AS smoker, dia AS diabetic, hyp AS hypertension,
       d.job_category, dia + hyp AS chronic_count, coalesce(step_count, 6000e0) AS avg_daily_steps,
       {_TELEMETRY_SQL.format(active="coalesce(CASE WHEN total_active_minutes = 0 THEN steps_active_minutes ELSE total_active_minutes END / 365e0, 30e0)")}
FROM act CROSS JOIN pop d""", floats=_FEATURE_FLOATS)
def q_feature_rows_activity(spark, sf):
    """HRM18 (+HRM12, HRM15, HRM17): activity upload -> scoring feature rows, with two defaults overridden by the user."""
    defaults = H.population_defaults(snapshot(spark, sf))
    return _shown(H.feature_records(fixture(spark, sf, "fx_activity"), defaults, {"age": 38, "smoker": 1})[0])


@register("hrm18_feature_rows_roster", oracle=_POP.replace(with_fixtures(CORE_FIXTURES), with_fixtures([*CORE_FIXTURES, "fx_roster_payload"])) + f"""
SELECT external_employee_id AS employee_id, CASE WHEN p.age BETWEEN 18 AND 70 THEN p.age ELSE d.age END AS age,
       CASE WHEN p.gender IN ('M', 'F', 'O') THEN p.gender ELSE d.gender END AS gender,
       CASE WHEN p.bmi BETWEEN 10 AND 60 THEN p.bmi ELSE d.bmi END AS bmi,
       CAST(p.smoker AS INTEGER) AS smoker, CAST(p.diabetic AS INTEGER) AS diabetic, CAST(p.hypertension AS INTEGER) AS hypertension,
       CASE WHEN p.job_category IN ('desk', 'field', 'manual') THEN p.job_category ELSE d.job_category END AS job_category,
       CAST(p.diabetic AS INTEGER) + CAST(p.hypertension AS INTEGER) AS chronic_count, 6000e0 AS avg_daily_steps,
       {_TELEMETRY_SQL.format(active="30e0")}
FROM fx_roster_payload p CROSS JOIN pop d""", floats=_FEATURE_FLOATS)
def q_feature_rows_roster(spark, sf):
    """HRM18 (+HRM12, HRM15, HRM19): roster upload with its own spelling of headers -> scoring feature rows."""
    p = fixture(spark, sf, "fx_roster_payload")
    upload = p.select(F.col("external_employee_id").alias("Employee_ID"), F.col("age").alias(" AGE "),
                      *[F.col(c).alias(c.title()) for c in ("gender", "bmi", "smoker", "diabetic", "hypertension", "job_category")])
    return _shown(H.feature_records(upload, H.population_defaults(snapshot(spark, sf)))[0])


@register("hrm20_fill_report", oracle=_PIVOT + """
SELECT 'lab' AS source, count(*) AS rows,
       'age,bmi,diabetic,' || CASE WHEN count(*) FILTER (WHERE gender IS NULL) > 0 THEN 'gender,' ELSE '' END
       || 'hypertension,job_category,smoker' AS filled_with_defaults FROM lab_pivot""")
def q_fill_report(spark, sf):
    """HRM20: which fields were defaulted in any row of the lab upload, and the row count."""
    rows = H.to_feature_rows(H.pivot_labs(fixture(spark, sf, "fx_lab_results")), H.population_defaults(snapshot(spark, sf)))
    return H.fill_report(rows, "lab").withColumn("filled_with_defaults", F.array_join("filled_with_defaults", ","))


@register("hrm21_preview", oracle=_PIVOT + "\nSELECT * FROM lab_pivot ORDER BY employee_id LIMIT 5")
def q_preview(spark, sf):
    """HRM21: first five subjects of the pivoted lab upload by id."""
    return H.preview(H.pivot_labs(fixture(spark, sf, "fx_lab_results")), "employee_id")


# ---- training-set upload path --------------------------------------------------------------

_UPLOAD_CANON = {"emp_id": "employee_id", "sex": "gender", "body_mass_index": "bmi", "tobacco_use": "smoker", "lr": "loss_ratio"}


@register("hrm2_map_columns", oracle=with_fixtures(["fx_upload"]) + "\n" + "\nUNION ALL\n".join(
    f"SELECT {i + 1} AS position, '{h}' AS source, CAST({repr(_UPLOAD_CANON[c]) if c in _UPLOAD_CANON else 'NULL'} AS VARCHAR) "
    f"AS canonical, count({c}) AS filled FROM fx_upload" for i, (c, h) in enumerate(UPLOAD_HEADERS.items())))
def q_map_columns(spark, sf):
    """HRM1 + HRM2: how each upload header maps to a canonical column (unknown headers -> null), and its filled rows."""
    return H.mapping_frame(upload(spark, sf))


_UP = with_fixtures(["fx_upload"]) + """
, up AS (SELECT emp_id AS employee_id, sex AS gender, body_mass_index AS bmi, tobacco_use AS smoker, lr AS loss_ratio,
                favourite_colour AS "Favourite Colour" FROM fx_upload)"""


@register("hrm5_validate_upload", oracle=_UP + """
SELECT true AS loss_ratio_present, count(*) FILTER (WHERE TRY_CAST(loss_ratio AS DOUBLE) IS NULL) AS non_numeric,
       count(*) FILTER (WHERE TRY_CAST(loss_ratio AS DOUBLE) IS NULL OR TRY_CAST(loss_ratio AS DOUBLE) < 0
                        OR TRY_CAST(loss_ratio AS DOUBLE) > 50) AS out_of_range FROM up""")
def q_validate_upload(spark, sf):
    """HRM5 (+HRM2, HRM4): validation report of a dirty upload."""
    mapped, _, _ = H.map_columns(upload(spark, sf))
    return H.validate_upload(H.derive_loss_ratio(mapped)).drop("errors")


_BOOL_T = "('true', 'yes', 'y', '1', '1.0', 't')"
_BOOL_F = "('false', 'no', 'n', '0', '0.0', 'f')"


def _coerce_bool_sql(c):
    s = f"lower(trim({c}))"
    n = f"TRY_CAST({c} AS DOUBLE)"
    return (f"coalesce(CASE WHEN {s} IN {_BOOL_T} THEN 1 WHEN {s} IN {_BOOL_F} THEN 0 END, "
            f"CASE WHEN {n} IS NOT NULL THEN CAST({n} > 0 AS INTEGER) END, 0)")


_NORMV = """SELECT employee_id,
       CASE WHEN substr(upper(coalesce(gender, 'None')), 1, 1) IN ('M', 'F', 'O') THEN substr(upper(coalesce(gender, 'None')), 1, 1) ELSE 'O' END AS gender,
       TRY_CAST(bmi AS DOUBLE) AS bmi, """ + _coerce_bool_sql("smoker") + """ AS smoker,
       TRY_CAST(loss_ratio AS DOUBLE) AS loss_ratio, "Favourite Colour" FROM up"""


@register("hrm6_normalize_values", oracle=_UP + "\n" + _NORMV, floats=["bmi", "loss_ratio"])
def q_normalize_values(spark, sf):
    """HRM6 (+HRM2, HRM3): upload values normalised: gender initial, boolean flags, numbers or null."""
    mapped, _, _ = H.map_columns(upload(spark, sf))
    return H.normalize_values(mapped)


def _median_sql(c):
    return f"quantile_cont({c}, 0.5)"


_REF_NUM = ["age", "bmi", "smoker", "diabetic", "hypertension", "avg_daily_steps", "step_volatility", "avg_resting_hr",
            "hr_trend", "avg_active_mins", "avg_sleep_hours", "avg_spo2", "total_claims", "visit_count",
            "hospitalized_count", "premium_share", "loss_ratio", "high_risk", "chronic_count"]
_SUPPLIED = {"employee_id", "gender", "bmi", "smoker", "loss_ratio"}


def _harm_sql():
    cols = []
    for c in CANONICAL_COLS:
        if c in _SUPPLIED:
            cols.append(f"n.{c}")
        elif c == "company_id":
            cols.append("'UPLOAD' AS company_id")
        elif c == "job_category":
            cols.append(f"{_MODE('job_category')} AS job_category")
        elif c in ("chronic_count", "lab_domain_count", "lab_risk_score", "high_risk"):
            continue
        elif c in _REF_NUM:
            cols.append(f"r.{c} AS {c}")
        else:
            cols.append(f"0 AS {c}")
    meds = ", ".join(f"{_median_sql(c)} AS {c}" for c in _REF_NUM)
    flags = " + ".join(f"lab_{d}_flag" for d in LAB_DOMAINS)
    return (f"""
, up AS (SELECT emp_id AS employee_id, sex AS gender, body_mass_index AS bmi, tobacco_use AS smoker, lr AS loss_ratio,
                favourite_colour AS "Favourite Colour" FROM fx_upload_clean),
n AS ({_NORMV}),
r AS (SELECT {meds} FROM or_snapshot),
f AS (SELECT {", ".join(cols)} FROM n CROSS JOIN r),
g AS (SELECT *, CAST(diabetic AS INTEGER) + CAST(hypertension AS INTEGER) AS chronic_count, {flags} AS lab_domain_count,
             round_even(0e0, 4) AS lab_risk_score, CAST(loss_ratio >= 1.5 AS INTEGER) AS high_risk FROM f)
SELECT {", ".join(CANONICAL_COLS)} FROM g""")


@register("hrm9_harmonize", oracle=with_fixtures(["fx_upload_clean"] + list(CORE_FIXTURES), SNAPSHOT_CTES) + _harm_sql(),
          floats=[c for c in CANONICAL_COLS if (c in _REF_NUM or c == "lab_risk_score")
                  and c not in ("smoker", "high_risk", "chronic_count")])
def q_harmonize(spark, sf):
    """HRM9 (+HRM2-HRM8): a clean upload harmonised to the 34 canonical columns against the snapshot."""
    rows, _, _ = H.harmonize(upload(spark, sf, "fx_upload_clean"), snapshot(spark, sf))
    return rows


@register("hrm9_harmonize_rejected", oracle=with_fixtures(["fx_upload"]) + "\nSELECT * FROM (SELECT 1 AS x) WHERE false")
def q_harmonize_rejected(spark, sf):
    """HRM9: a dirty upload (non-numeric / out-of-range loss ratios) yields no rows."""
    rows, _, _ = H.harmonize(upload(spark, sf), snapshot(spark, sf))
    return rows.select(F.lit(1).alias("x"))


def _aligned(c):
    """DuckDB column of an upload's row: its own, or 0 if uploads have none."""
    own = "employee_id" if c == "employee_key" else c
    if own in CANONICAL_COLS and c in ("age", "smoker", "diabetic", "hypertension", "visit_count", "hospitalized_count"):
        return f"CAST(trunc({own}) AS INTEGER) AS {c}"
    return f"{own} AS {c}" if own in CANONICAL_COLS else f"{repr('0') if c in ('gender', 'job_category') else 0} AS {c}"


@register("hrm10_align_union", oracle=with_fixtures(["fx_upload_clean"] + list(CORE_FIXTURES), SNAPSHOT_CTES)
          + _harm_sql().replace("SELECT " + ", ".join(CANONICAL_COLS) + " FROM g", "") + """
, h AS (SELECT * FROM g)
SELECT * FROM or_snapshot UNION ALL SELECT """ + ", ".join(_aligned(c) for c in SNAPSHOT_COLUMNS) + " FROM h",
          floats=_SNAP_FLOATS)
def q_align_union(spark, sf):
    """HRM10/AGG14: harmonised upload aligned to the snapshot's columns and appended."""
    rows, _, _ = H.harmonize(upload(spark, sf, "fx_upload_clean"), snapshot(spark, sf))
    return H.align_and_union(snapshot(spark, sf), rows.withColumnRenamed("employee_id", "employee_key"))


@register("hrm11_overlap", oracle=with_fixtures(["fx_lab_results", "fx_employees"]) + """
SELECT count(*) AS overlap FROM (SELECT DISTINCT employee_key FROM fx_employees
  INTERSECT SELECT DISTINCT unique_id FROM fx_lab_results)""")
def q_overlap(spark, sf):
    """HRM11: ids present both in the roster and in the lab upload."""
    return H.overlap_count(fixture(spark, sf, "fx_employees"), fixture(spark, sf, "fx_lab_results"),
                           "employee_key", "unique_id")


@register("hrm4_derive_loss_ratio", oracle=with_fixtures(CORE_FIXTURES, SNAPSHOT_CTES) + f"""
SELECT employee_key AS "Member ID", {rnd(
    "least(greatest(coalesce(total_claims / CASE WHEN premium_share = 0 THEN NULL ELSE premium_share END, 0e0), 0e0), 50e0)", 4)}
    AS loss_ratio FROM or_snapshot""", floats=["loss_ratio"])
def q_derive_lr(spark, sf):
    """HRM4 (+HRM2): an upload with claims and premium but no loss ratio gets one derived."""
    s = snapshot(spark, sf).select(F.col("employee_key").alias("Member ID"),
                                   F.col("total_claims").cast("string").alias("Claim Amount"),
                                   F.col("premium_share").cast("string").alias("Annual Premium"))
    mapped, _, _ = H.map_columns(s)
    return H.derive_loss_ratio(mapped).select(F.col("employee_id").alias("Member ID"), "loss_ratio")


@register("hrm12_detect_format", oracle=with_fixtures(["fx_lab_results", "fx_activity", "fx_roster_payload", "fx_upload"]) + """
SELECT 'fx_lab_results' AS upload, 'lab' AS format, count(*) AS rows FROM fx_lab_results
UNION ALL SELECT 'fx_activity', 'activity', count(*) FROM fx_activity
UNION ALL SELECT 'fx_roster', 'roster', count(*) FROM fx_roster_payload
UNION ALL SELECT 'fx_upload', 'unknown', count(*) FROM fx_upload""")
def q_detect_format(spark, sf):
    """HRM12: upload format of each landed upload table (lab / activity / roster / unknown), from its columns, and its rows."""
    cands = {"fx_lab_results": fixture(spark, sf, "fx_lab_results").withColumnRenamed("line_no", "value"),
             "fx_activity": fixture(spark, sf, "fx_activity"),
             "fx_roster": fixture(spark, sf, "fx_roster_payload").withColumnRenamed("external_employee_id", "employee_id"),
             "fx_upload": upload(spark, sf)}
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("upload"), F.lit(H.detect_format(df)).alias("format"), "rows")
             for k, df in cands.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
